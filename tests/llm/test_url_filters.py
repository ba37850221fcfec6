import random
import re

from facetframe.llm import url_filters as u

RULES = [*u.RULES, ("a.example.org/es/x", "allow"), ("com/fr/a/b", "block"), ("org/", "block"), ("", "block"), ("b.a.com/", "allow")]


def expected(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        h, p = (rule.split("/", 1)[0], rule[len(rule.split("/", 1)[0]):])
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(rule), len(h), verdict == "block")
            if best is None or rank > best[0]:
                best = (rank, rule, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' host", "'y' _range", "'z' rule")
    found = u.judge_urls(pages, spark.createDataFrame(rules, "rule string, verdict string"), ranges=7).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}, len(found)


def test_against_every_rule_in_turn(spark):
    r = random.Random(3)
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "xexample.org", "org", "com", "b.a.com", "c.b.a.com", "é.com", "a..com", "", "com:80"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/12", "/fr/a/b/c", "/fr/", "/de/?q#r", "?x=/es/", "#/fr/", "/fr/a"]
    urls = [r.choice(["http://", "https://", "x", ""]) + r.choice(hosts) + r.choice(paths) for _ in range(900)]
    urls += [None, "", "://", "http://org/a://com/fr/"] + ["http://hot.example.org/en/1"] * 600
    got, n = judged(spark, urls, RULES)
    assert n == len(urls)
    for i, url in enumerate(urls):
        assert got[i] == expected(url, RULES), url


def test_nothing_to_do(spark):
    assert judged(spark, [], RULES)[1] == 0
    assert judged(spark, ["http://a.org/"], [])[0] == {0: ("a.org", "/", None, "allow")}
    assert judged(spark, ["http://a.org/"], [(None, "block"), ("org/", None)])[0] == {0: ("a.org", "/", None, "allow")}
