"""URL rules by a sort-merge range join.

A host is written with its labels reversed (``www.example.org`` as ``org.example.www.``),
so the subdomains of a rule's host are one interval of keys. Urls are cut into key
ranges at split points from a sample; a rule goes to every range its interval meets.
In a range, urls and rules are sorted and swept once: a stack holds the rules whose
host interval is open, and within a host a second stack holds the path prefixes that
are open. A url at a split point may go to either side, so a host or url with a large
share of all rows is spread over as many ranges as its share. Every rule table is
joined this way; none is broadcast.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed: the rules of the registered query.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Sampled keys per range, to find the split points; they decide the balance only.
SAMPLED = 20


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels reversed, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def sweep(urls: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    """Match the urls of a key range (key, path) with its rules (key, path, rule, verdict, weight)."""
    by_host: dict[str, list[tuple]] = {}
    for row in rules.sort_values(["key", "path", "verdict"], ascending=[True, True, False]).itertuples(index=False):
        by_host.setdefault(row.key, []).append((row.path, (row.weight, len(row.key), row.verdict == "block"), row.rule, row.verdict))
    opening = sorted(by_host)
    urls = urls.sort_values(["key", "path"], ignore_index=True)
    keys, paths = urls["key"].tolist(), urls["path"].tolist()
    out_rule: list[str | None] = [None] * len(keys)
    out_verdict: list[str | None] = [None] * len(keys)
    hosts: list[str] = []
    upcoming, at = 0, 0
    while at < len(keys):
        key = keys[at]
        while upcoming < len(opening) and opening[upcoming] <= key:
            while hosts and not opening[upcoming].startswith(hosts[-1]):
                hosts.pop()
            hosts.append(opening[upcoming])
            upcoming += 1
        while hosts and not key.startswith(hosts[-1]):
            hosts.pop()
        active = sorted(r for h in hosts for r in by_host[h])
        prefixes: list[tuple[str, tuple]] = []  # each with the best rule from here down the stack
        nearest = 0
        while at < len(keys) and keys[at] == key:
            path = paths[at]
            while nearest < len(active) and active[nearest][0] <= path:
                rule = active[nearest]
                while prefixes and not rule[0].startswith(prefixes[-1][0]):
                    prefixes.pop()
                best = rule if not prefixes else max(rule, prefixes[-1][1], key=lambda r: r[1])
                prefixes.append((rule[0], best))
                nearest += 1
            while prefixes and not path.startswith(prefixes[-1][0]):
                prefixes.pop()
            if prefixes:
                out_rule[at], out_verdict[at] = prefixes[-1][1][2:]
            at += 1
    urls["rule"], urls["verdict"] = out_rule, out_verdict
    return urls


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules`` has ``rule`` (host/path prefix) and ``verdict``. A rule fits its host and
    all subdomains if the url's path starts with the rule's path. The longest rule
    (host and path in characters) wins, then the longer host, then ``block``. Where no
    rule fits, rule is null and the verdict is ``default``. Null urls and urls without
    ``://`` have an empty host and path. Rules that are null are skipped. Repeated rows
    stay repeated; an empty page table gives no rows.
    """
    spark = pages.sparkSession
    ranges = ranges or 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    sort_key = F.concat("key", F.lit("\x00"), "path")
    fraction = min(1.0, SAMPLED * ranges / max(1, pages.count()))
    sample = sorted(r[0] for r in urls.select(sort_key).sample(fraction, seed=11).collect())  # about SAMPLED * ranges keys
    bounds = [sample[i] for i in np.linspace(0, len(sample) - 1, ranges + 1)[1:-1].astype(int)] if sample else []
    shared = spark.sparkContext.broadcast(bounds)

    def to_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, splits = 0, shared.value
        for batch in batches:
            places = []
            for key, path in zip(batch["key"], batch["path"]):
                low, high = bisect_left(splits, f"{key}\x00{path}"), bisect_right(splits, f"{key}\x00{path}")
                places.append(low + count % (high - low + 1))
                count += 1
            yield batch.assign(_range=np.array(places, np.int32))

    def to_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splits = shared.value
        for batch in batches:
            met = [
                range(bisect_left(splits, key), bisect_right(splits, key, key=lambda s, n=len(key): s[:n]) + 1)
                for key in batch["key"]
            ]
            out = batch.loc[batch.index.repeat([len(m) for m in met])].copy()
            out["_range"] = np.array([i for m in met for i in m], np.int32)
            yield out

    kind = pages.schema["page_id"].dataType.simpleString()
    left = urls.mapInPandas(to_range, f"page_id {kind}, host string, path string, key string, _range int")
    host = F.translate(F.regexp_extract("rule", r"^([^/]*)", 1), UPPER, UPPER.lower())
    right = (
        rules.where("rule IS NOT NULL AND verdict IS NOT NULL").select("rule", "verdict")
        .withColumn("key", F.when(host == "", F.lit("")).otherwise(host_key(host)))
        .withColumn("path", F.regexp_extract("rule", r"^[^/]*(.*)$", 1))
        .withColumn("weight", F.length("rule").cast("long"))
        .mapInPandas(to_ranges, "rule string, verdict string, key string, path string, weight long, _range int")
    )

    names = ["page_id", "host", "path", "rule", "verdict"]

    def match(urls: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
        if urls.empty:  # rules of a range that no url lies in
            return pd.DataFrame({name: pd.Series(dtype=object) for name in names})
        found = sweep(urls, rules)
        return found.assign(verdict=[v or default for v in found["verdict"]])[names]

    return left.groupBy("_range").cogroup(right.groupBy("_range")).applyInPandas(
        match, f"page_id {kind}, host string, path string, rule string, verdict string"
    )


ORACLE = """
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), best AS (
  SELECT u.page_id, u.host, u.path, max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) AS hit
  FROM u LEFT JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
  GROUP BY ALL
)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM best
"""
