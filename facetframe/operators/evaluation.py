"""Topic quality: c_v coherence, diversity, and a sweep over cluster settings."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import tokens as K
from ..session import cut_lineage
from .clustering import density_clusters
from .topics import class_terms, topic_counts, topics_of_counts
from .vectors import merge_topics

WINDOW = 110
TOP = 10
_EPS = 1e-12
# Window starts compared at a time: a long text needs no more memory for it than a short one.
_STARTS = 1 << 16


def leading_words(topics: DataFrame, n: int = TOP) -> DataFrame:
    """``topic``, ``place``, ``word``: the n heaviest words of each topic."""
    ordered = F.slice(F.sort_array(F.transform("words", lambda w: F.struct(
        (-w["weight"]).alias("order"), w["word"].alias("word")))), 1, n)
    return topics.filter(F.size("words") > 0).select(F.col("id").alias("topic"), F.posexplode(ordered).alias("place", "w")).select(
        "topic", "place", F.col("w.word").alias("word")
    )


def topic_diversity(topics: DataFrame, n: int = TOP) -> DataFrame:
    """Distinct words over all words in the leading lists."""
    return leading_words(topics, n).agg(
        F.try_divide(F.count_distinct("word"), F.count("word")).alias("diversity")
    )


def window_counts(documents: DataFrame, words: DataFrame, window: int = WINDOW) -> DataFrame:
    """``w1``, ``w2``, ``n``: sliding windows that hold both words (or one, when equal).

    Only pairs of words that share a topic are counted. A text of at most
    ``window`` words is one window, a longer one has a window at every start. The
    row with NULL words holds the number of all windows. Each document is handled
    where it lies; the tasks return summed counts.
    """
    return _window_counts(documents.withColumn("weights", _once()), [_listed(words)], window).select("w1", "w2", "n")


def _once():
    """The weights of a document that counts once, in one setting."""
    return F.expr("array(1L)")


def _listed(words: DataFrame) -> list:
    """The leading words on the driver: a part of the model, a few words per topic."""
    return words.collect()


def _window_counts(documents: DataFrame, lists: list[list], window: int) -> DataFrame:
    """``setting``, ``w1``, ``w2``, ``n`` for several lists of leading words, by one pass over the texts.

    ``documents`` has ``document`` and ``weights``: how often it counts in each setting.
    A setting may count pairs of words that share a topic in another one only.
    """
    partners: dict[str, set[str]] = {}
    for listed in lists:
        by_topic: dict[int, list[str]] = {}
        for row in listed:
            by_topic.setdefault(row["topic"], []).append(row["word"])
        for group in by_topic.values():
            for word in group:
                partners.setdefault(word, set()).update(w for w in group if w >= word)

    def count(batches):
        totals: dict[tuple[str | None, str | None], np.ndarray] = {}
        for batch in batches:
            for length, places_of, terms, weights in zip(batch["length"], batch["places"], batch["terms"], batch["weights"]):
                weights = np.asarray(weights, dtype=np.int64)
                starts = max(length - window + 1, 1)
                totals[None, None] = totals.get((None, None), 0) + starts * weights
                places: dict[str, list[int]] = {}
                for at, term in zip(places_of, terms):
                    if term in partners:
                        places.setdefault(term, []).append(at)
                if not places:
                    continue
                row_of, masks = {}, np.zeros((len(places), starts), dtype=bool)
                for row, (term, at) in enumerate(places.items()):
                    # Window s covers positions s .. s+window-1: mark the starts that reach a position.
                    where = np.asarray(at)
                    edges = np.bincount(np.maximum(where - window + 1, 0), minlength=starts + 1)
                    edges = edges - np.bincount(np.minimum(where + 1, starts), minlength=starts + 1)
                    row_of[term], masks[row] = row, edges.cumsum()[:starts] > 0
                shared = np.zeros((len(places), len(places)), dtype=np.int64)
                for low in range(0, starts, _STARTS):
                    some = masks[:, low : low + _STARTS].astype(np.float32)  # whole numbers up to 2**24 stay exact
                    shared += (some @ some.T).astype(np.int64)
                for term, row in row_of.items():
                    for other in partners[term]:
                        n = shared[row, row_of[other]] if other in row_of else 0
                        if n:
                            totals[term, other] = totals.get((term, other), 0) + n * weights
        found = [(k, a, b, int(n)) for (a, b), ns in totals.items() for k, n in enumerate(ns) if n]
        if found:
            yield pd.DataFrame(found, columns=["setting", "w1", "w2", "n"])

    # Only the places of topic words leave the JVM, next to the length of the text.
    bags = documents.filter(F.col("document").isNotNull()).select(K.words(F.col("document")).alias("t"), "weights")
    placed = F.transform("t", lambda t, i: F.struct(i.alias("at"), t.alias("term")))
    if len(partners) <= 10_000:
        placed = F.filter(placed, lambda x: x["term"].isin(*partners))
    bags = bags.select(F.size("t").alias("length"), placed.alias("p"), "weights").select(
        "length", F.col("p.at").alias("places"), F.col("p.term").alias("terms"), "weights"
    )
    counted = bags.mapInPandas(count, "setting int, w1 string, w2 string, n long")
    return counted.groupBy("setting", "w1", "w2").agg(F.sum("n").alias("n"))


def coherence_cv(documents: DataFrame, topics: DataFrame, window: int = WINDOW, n: int = TOP) -> DataFrame:
    """``topic``, ``coherence``, ``std_dev``, ``support`` per topic.

    Every leading word gets the vector of its normalised pointwise mutual
    information with all leading words of the topic. The coherence is the mean
    cosine between these vectors and their sum. ``documents`` has ``document``.
    """
    listed = _listed(leading_words(topics, n))
    # Small, and used several times below.
    found = cut_lineage(_window_counts(documents.withColumn("weights", _once()), [listed], window))
    return _coherence(found, listed)


def _coherence(found: DataFrame, listed: list) -> DataFrame:
    """The coherence of the topics of ``listed`` from the counts of one setting."""
    spark = found.sparkSession
    words = spark.createDataFrame([tuple(w) for w in listed], "topic int, place int, word string")
    total = found.filter("w1 IS NULL").agg(F.max("n").cast("double").alias("t")).scalar()
    counts = found.filter("w1 IS NOT NULL")

    first = words.select("topic", F.col("place").alias("p1"), F.col("word").alias("a"))
    second = words.select("topic", F.col("place").alias("p2"), F.col("word").alias("b"))
    # n*n rows per topic, n being the length of the leading lists.
    grid = first.join(second, "topic").withColumns({"w1": F.least("a", "b"), "w2": F.greatest("a", "b"), "total": total})
    single = counts.filter("w1 = w2")
    filled = (
        grid.join(counts, ["w1", "w2"], "left")
        .join(single.select(F.col("w1").alias("a"), F.col("n").alias("na")), "a", "left")
        .join(single.select(F.col("w1").alias("b"), F.col("n").alias("nb")), "b", "left")
    )
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("total")
    joint = share("n") + _EPS
    independent = share("na") * share("nb")
    npmi = F.when(independent > 0, F.log(joint / independent) / -F.log(joint)).otherwise(F.lit(0.0))
    cells = filled.select("topic", "p1", "p2", npmi.alias("x"))
    whole = cells.groupBy("topic", "p2").agg(F.sum("x").alias("s"))
    paired = cells.join(whole, ["topic", "p2"]).groupBy("topic", "p1").agg(
        F.sum(F.col("x") * F.col("s")).alias("dot"),
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"),
        F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("ns"),
    )
    norm = F.col("nx") * F.col("ns")
    cosine = F.coalesce(F.try_divide(F.col("dot"), norm), F.lit(0.0))
    return paired.groupBy("topic").agg(
        F.avg(cosine).alias("coherence"), F.stddev_pop(cosine).alias("std_dev"), F.count(F.lit(1)).alias("support")
    )


def evaluate_topics(documents: DataFrame, topics: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: corpus coherence, diversity and the outlier, valid and total counts.

    ``assigned`` has ``topic`` for every document with usable text; ``valid``
    counts all of them but the outliers.
    """
    coherence = coherence_cv(documents, topics).agg(F.avg("coherence").alias("c")).scalar()
    diversity = topic_diversity(topics).select("diversity").scalar()
    count = topics.agg(F.count(F.lit(1)).alias("t")).scalar()
    return topic_counts(assigned, "topic").select(
        coherence.alias("coherence_v"), diversity.alias("topic_diversity"), count.alias("topics"),
        F.col("outlier").alias("outlier_count"), (F.col("total") - F.col("outlier")).alias("valid_count"),
        F.col("total").alias("total_count"),
    )


def candidates(
    min_topic_size: tuple[int, int] | None, confidence: tuple[int, int] | None, trials: int, seed: int = 42
) -> list[tuple[int | None, int | None]]:
    """Settings to try: the whole grid if it is small enough, else a seeded sample of it."""
    if min_topic_size is None and confidence is None:
        raise ValidationError("give a range for the topic size or for the confidence threshold")
    span = lambda r: [None] if r is None else list(range(min(r), max(r) + 1))
    sizes, thresholds = span(min_topic_size), span(confidence)
    if len(sizes) * len(thresholds) <= trials:
        return list(itertools.product(sizes, thresholds))
    draw, chosen = random.Random(seed), {}
    while len(chosen) < trials:
        chosen[draw.choice(sizes), draw.choice(thresholds)] = None
    return list(chosen)


def _scores(documents: DataFrame, placed: list[tuple[int, DataFrame]]) -> dict[int, tuple]:
    """Per trial the number of topics, their coherence and their diversity.

    ``placed`` has the trials' ``id`` and ``topic``. Documents that lie in the same topics
    in all trials share a pattern: words are counted per pattern, and only the counts are
    spread to the topics. Repeated ids count as often as a join of the two would have them.
    """
    topic_of = None
    for k, (_, found) in enumerate(placed):
        one = found.select("id", F.lit(k).alias("setting"), "topic")
        topic_of = one if topic_of is None else topic_of.unionByName(one)
    copies = topic_of.groupBy("id", "setting", "topic").agg(F.count(F.lit(1)).alias("copies"))
    marked = cut_lineage(copies.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("setting", "topic", "copies"))).alias("marks")))
    patterns = cut_lineage(marked.select("marks").distinct().withColumn("pattern", F.monotonically_increasing_id()))
    weights = F.transform(
        F.sequence(F.lit(0), F.lit(len(placed) - 1)),
        lambda k: F.aggregate(F.filter("marks", lambda m: m["setting"] == k), F.lit(0).cast("long"), lambda total, m: total + m["copies"]),
    )
    known = cut_lineage(marked.join(patterns, "marks").select("id", "pattern", weights.alias("weights")))
    docs = cut_lineage(documents.filter(F.col("document").isNotNull()).join(known, "id").select("document", "pattern", "weights"))

    spread = patterns.select("pattern", F.explode("marks").alias("m")).select("pattern", "m.*")
    terms = cut_lineage(class_terms(docs, "pattern", "document")).withColumnRenamed("class", "pattern")
    counts = terms.join(spread, "pattern").groupBy("setting", F.col("topic").alias("class"), "term").agg(F.sum(F.col("n") * F.col("copies")).alias("n"))
    counts = cut_lineage(counts)
    sizes = docs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).join(spread, "pattern")
    sizes = cut_lineage(sizes.groupBy("setting", F.col("topic").alias("id")).agg(F.sum(F.col("n") * F.col("copies")).alias("frequency")))

    def of(table: DataFrame, k: int) -> DataFrame:
        return table.filter(F.col("setting") == k).drop("setting")

    topics = [cut_lineage(topics_of_counts(of(counts, k), of(sizes, k))) for k in range(len(placed))]
    lists = [_listed(leading_words(t)) for t in topics]
    windows = cut_lineage(_window_counts(docs.select("document", "weights"), lists, WINDOW))
    out = {}
    for k, (trial, _) in enumerate(placed):
        coherence = _coherence(of(windows, k), lists[k]).agg(F.avg("coherence")).first()[0]
        out[trial] = (topics[k].count(), coherence, topic_diversity(topics[k]).first()["diversity"])
    return out


def sweep(
    documents: DataFrame, vectors: DataFrame, reduced: DataFrame, min_topic_size: tuple[int, int] | None = None,
    confidence: tuple[int, int] | None = None, topic_count: tuple[int, int] | None = None, trials: int = 10,
    defaults: tuple[int, int | None] = (15, None), seed: int = 42,
) -> DataFrame:
    """One row per setting: ``trial``, the setting, topics found, coherence, diversity, ``metric``, ``error``.

    ``metric`` is the coherence. Fewer topics than wanted scores minus the missing
    share, a failed setting -1. The best setting comes first. All settings are clustered
    first; then the texts are read twice for all of them, once to count the words of each
    pattern of topics and once to count windows.
    """
    low, high = (min(topic_count), max(topic_count)) if topic_count else (None, None)
    tried, placed, errors = [], [], {}
    for trial, (size, threshold) in enumerate(candidates(min_topic_size, confidence, trials, seed), start=1):
        setting = (size or defaults[0], threshold or defaults[1])
        tried.append((trial, *setting, high))
        try:
            found = density_clusters(reduced, setting[0], setting[1])
            if high is not None:
                found = merge_topics(cut_lineage(found).join(vectors, "id"), high)
            placed.append((trial, cut_lineage(found.select("id", F.col("topic").cast("int").alias("topic")))))
        except ValidationError as error:
            errors[trial] = str(error)
    scores = _scores(documents, placed) if placed else {}
    results = []
    for trial, *setting in tried:
        if trial in errors:
            results.append((trial, *setting, None, None, None, -1.0, errors[trial]))
            continue
        topics, coherence, diversity = scores[trial]
        metric = coherence if coherence is not None else -1.0
        if low is not None and topics < low:
            metric = -(low - topics) / low
        results.append((trial, *setting, topics, coherence, diversity, float(metric), None))
    frame = documents.sparkSession.createDataFrame(
        results,
        "trial int, min_topic_size int, topic_confidence_threshold int, max_topics int, topics long, "
        "coherence double, diversity double, metric double, error string",
    )
    return frame.orderBy(F.col("metric").desc(), "trial")
