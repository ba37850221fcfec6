"""Quality rules from n-gram likelihood ratios, in DataFrame functions only.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials are
counted over them: the raw corpus (every document) and the trusted target (documents
labelled good). A document's score is the mean over its n-grams of the log ratio of the
two; documents below a fixed threshold are rejected. The target is smoothed towards the
raw corpus, so an n-gram nobody has labelled says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import key_filter, whole_text

#: Hash buckets; the model is one number a bucket at any size of the corpus.
BUCKETS = 16384
#: Weight of the raw corpus in the target's smoothing, in n-grams.
PRIOR = 20_000
#: Documents whose mean log ratio is lower are rejected.
THRESHOLD = -0.1
WINDOW = 5
SPACE = r"[\x20\x09-\x0D]+"


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside ``body`` it is a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(hashes: Column, buckets: int) -> Column:
    """Buckets of the words and of neighbouring pairs."""
    pairs = F.zip_with(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"),
    )
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")), pairs)


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows of five that occur at least twice in the text."""

    def covered(order: Column) -> Column:
        # Sorted by window: equal windows are neighbours. Their places, in order, cover up to five words each.
        def repeats(i: Column) -> Column:
            here = F.get(order, i)["h"]
            return ((i > 0) & (F.get(order, F.greatest(i - 1, F.lit(0)))["h"] == here)) | F.coalesce(F.get(order, i + 1)["h"] == here, F.lit(False))

        places = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(order) - 1), repeats), lambda i: F.get(order, i)["i"]))
        return bound(places, lambda at: F.aggregate(
            F.sequence(F.lit(1), F.size(at)), F.lit(0).cast("long"),
            lambda total, k: total + F.least(F.coalesce(F.get(at, k) - F.get(at, k - 1), F.lit(WINDOW)), F.lit(WINDOW)),
        ))

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))),
        )

    def count(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(bound(pairs, covered))

    return F.when(F.size(hashes) < WINDOW, F.lit(0).cast("long")).otherwise(bound(hashes, lambda h: bound(windows(h), count)))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row with ``weights``: the log ratio of target and raw corpus for every bucket."""
    trusted = cut_lineage(trusted_documents(labels).select(F.col("doc_id").alias("_trusted")))
    rows = docs.select(F.col("doc_id").alias("_id"), whole_text().alias("_text"))
    # Only texts that may be trusted are moved to the labels, by one plan at every size.
    may_be = key_filter(trusted, "_trusted")
    good = rows.where(may_be(F.col("_id"))).join(trusted.hint("shuffle_hash"), F.col("_id") == F.col("_trusted"), "left_semi")

    def counted(texts: DataFrame, name: str) -> DataFrame:
        hashes = F.transform(split_words(F.col("_text")), lambda w: F.xxhash64(w))
        found = texts.select(F.explode(bound(hashes, lambda h: grams(h, buckets))).alias("b"))
        return found.groupBy("b").agg(F.count(F.lit(1)).alias(name))

    counts = cut_lineage(counted(rows, "raw").join(counted(good, "target"), "b", "left"))
    sums = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    raw = (F.coalesce("raw", F.lit(0)) + 1) / F.lit(float(sums["raw"] + buckets))
    target = (F.coalesce("target", F.lit(0)) + F.lit(float(prior)) * raw) / F.lit(float(sums["target"] + prior))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    weights = every.join(counts, "b", "left").select(F.struct("b", F.log(target / raw).alias("w")).alias("e"))
    return cut_lineage(weights.agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["w"]).alias("weights")))


def judge_quality(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, score and kept.

    Base: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; base_failed below
    ten words or with more than a fifth of the words in repeated windows. kept: not
    base_failed, and the mean log ratio is at least ``threshold``. Null and empty texts
    have zero counts, score 0 and fail. Repeated rows are judged each. Without labels
    all scores are 0.
    """
    weights = log_ratios(docs, labels, buckets, prior).scalar()
    text = F.col("_text")
    rows = docs.select("doc_id", whole_text().alias("_text")).select(
        "doc_id", "_text", weights.alias("_w"), F.transform(split_words(text), lambda w: F.xxhash64(w)).alias("_h")
    )
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    ratio = bound(F.struct(F.col("_h").alias("h"), F.col("_w").alias("w")), lambda m: F.aggregate(
        grams(m["h"], buckets), F.lit(0.0), lambda total, b: total + F.get(m["w"], b)
    ))
    rows = rows.select(
        "doc_id", F.size("_h").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_h")).alias("n_repeat_words"),
        (ratio / F.greatest(2 * F.size("_h") - 1, F.lit(1))).alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score",
        (~failed & (F.col("score") >= threshold)).alias("kept"),
    )
