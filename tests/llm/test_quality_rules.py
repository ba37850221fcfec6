import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from facetframe.llm import quality_rules as q

TEXTS = [
    "one two three four five six seven eight nine ten", "a b c d e f a b c d e x a b c d e", "#x #y\n\n#x #y\n \nline\nline\nline |<>&$%*",
    None, "", " \t\n", "w " * 40, "a b c d e a b c d e a b c d e", "short", "É\x1cé x y\x0bz", "the quick brown fox " * 3 + "jumps over it all once more",
    "A good clean text of many plain words that says a few things only once", "bad### bad*** worse&&& bad### bad*** worst&&& x y z q r s t",
]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("buckets", [64, 16384])
def test_against_brute_force(spark, buckets):
    docs = spark.createDataFrame([*enumerate(TEXTS), (0, TEXTS[0])], "doc_id long, text string").selectExpr("*", "1 n_words", "2 _h", "3 b")
    labels = spark.createDataFrame([(0, 1), (11, 1), (11, 1), (12, 0), (None, 1), (99, 1), (10, None)], "doc_id long, quality int")
    rows = q.judge_quality(docs, labels, buckets=buckets, prior=5.0).collect()
    assert len(rows) == len(TEXTS) + 1

    vocabulary = sorted({w for t in TEXTS for w in words_of(t)})
    hashed = dict(spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w")).collect())
    pairs = sorted({p for t in TEXTS for p in zip(words_of(t), words_of(t)[1:])})
    pair_hash = {
        (r["a"], r["b"]): r["h"] for r in spark.createDataFrame([(*p, hashed[p[0]], hashed[p[1]]) for p in pairs], "a string, b string, x long, y long")
        .select("a", "b", F.xxhash64("x", "y").alias("h")).collect()
    }

    def grams(text):
        words = words_of(text)
        return [hashed[w] % buckets for w in words] + [pair_hash[p] % buckets for p in zip(words, words[1:])]

    raw, target = Counter(), Counter()
    for i, text in [*enumerate(TEXTS), (0, TEXTS[0])]:
        raw.update(grams(text))
        if i in (0, 11):
            target.update(grams(text))
    n, m = sum(raw.values()), sum(target.values())
    for r in rows:
        text = TEXTS[r["doc_id"]]
        expected = base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected, text
        failed = expected[0] < 10 or 100 * expected[4] > 20 * expected[0]
        assert r["base_failed"] == failed
        own = grams(text)
        score = 0.0
        for b in own:
            p = (raw[b] + 1) / (n + buckets)
            score += math.log((target[b] + 5.0 * p) / (m + 5.0) / p)
        score /= max(1, len(own))
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["kept"] == (not failed and r["score"] >= q.THRESHOLD)


def test_nothing_known(spark):
    docs = spark.createDataFrame([(1, TEXTS[0]), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r["doc_id"], r["score"], r["kept"]) for r in q.judge_quality(docs, labels).collect()} == {(1, 0.0, True), (None, 0.0, False)}
    assert q.judge_quality(docs.limit(0), labels).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    plan = q.judge_quality(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_good_label_is_trusted(spark):
    labels = spark.range(250_000).selectExpr("id AS doc_id", "1 AS quality")
    assert q.trusted_documents(labels).count() == 250_000
