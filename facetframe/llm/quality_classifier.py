"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a whole text (lengths, shares of characters, repetition) are standardised
by their mean and deviation over all documents. Random cosines of them approximate a
Gaussian kernel. Each task adds up the normal equations of its labelled rows; the sums
are added by Spark and the ridge solution is one small linear system. Scores of a fold
that the ridge has not seen are cut into fixed bins and calibrated by pooling adjacent
violators.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_map, fold, totals, utf8, whole_text

COSINES = 256
RIDGE = 1e-3
SEED = 5
#: About this many labelled rows are used for fitting, chosen by a hash of the id.
SAMPLE = 400_000
CUT = 0.3
BINS = 400
STATISTICS = (
    "log_words", "log_chars", "word_length", "upper", "digits", "symbols", "marks", "points", "breaks", "other",
    "distinct_words", "distinct_pairs", "stutter", "top_word", "distinct_lines", "line_words", "longest_word", "ends_marked",
)


def _byte_kinds() -> np.ndarray:
    """Kinds of bytes: 0 letters, 1 upper case, 2 digits, 3 symbols, 4 ! and ?, 5 . , ; :, 6 line breaks, 7 other marks, 8 blanks."""
    kinds = np.zeros(256, np.uint8)
    kinds[:128] = 7
    for kind, chars in enumerate((
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", b"", b" \t\r\x0b\x0c",
    )):
        for c in chars:
            kinds[c] = kind
    return kinds


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text, from the whole text."""
    flat, starts = utf8(column)
    size = np.maximum(np.diff(starts), 1)
    kinds = _byte_kinds()[flat]
    shares = [totals(kinds == k, starts) / size for k in range(1, 8)]
    out = np.zeros((len(column), len(STATISTICS)))
    out[:, 1] = np.log1p(np.diff(starts))
    for i, share in enumerate(shares):
        out[:, 3 + i] = share
    for row, text in enumerate(column.to_pylist()):
        words = text.split()
        n = len(words)
        if not n:
            continue
        lines = [line for line in text.split("\n") if line and not line.isspace()]
        counts = Counter(words)
        lengths = list(map(len, words))
        total = sum(lengths)
        out[row, 0] = np.log1p(n)
        out[row, 2] = total / n
        # Distinct words grow slower than words: compared on a logarithmic scale.
        out[row, 10] = np.log1p(len(counts)) / np.log1p(n)
        out[row, 11] = len(set(zip(words, words[1:]))) / max(1, n - 1)
        out[row, 12] = sum(map(eq, words, words[1:])) / n
        out[row, 13] = max(counts.values()) / n if n > 5 else 0.0
        out[row, 14] = len(set(lines)) / max(1, len(lines))
        out[row, 15] = np.log1p(n / max(1, len(lines)))
        out[row, 16] = np.log1p(max(lengths))
        out[row, 17] = sum(w[-1] in "!?#*$%&|<>" for w in words) / n
    return out


class Model(NamedTuple):
    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return cosines(statistics, self) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        """Calibrated scores in 0 to 1; a small share of the raw score keeps the order inside a level."""
        raw = self.raw(statistics)
        level = np.interp(raw, self.edges, self.values) if len(self.edges) else np.full(len(raw), 0.5)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -50, 50))), 0.0, 1.0)


def cosines(statistics: np.ndarray, model: Model) -> np.ndarray:
    """Bias, standardised statistics and random cosines of a block of rows."""
    z = np.clip((statistics - model.mean) / model.deviation, -8, 8)
    waves = np.sqrt(2 / len(model.phases)) * np.cos(z @ model.directions + model.phases)
    return np.hstack([np.ones((len(z), 1)), z, waves])


def isotonic(counts: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``means`` with weights ``counts``: pool adjacent violators."""
    blocks: list[list[float]] = []
    for n, y in zip(counts.tolist(), means.tolist()):
        blocks.append([n, y, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            n2, y2, k2 = blocks.pop()
            n1, y1, k1 = blocks.pop()
            blocks.append([n1 + n2, (n1 * y1 + n2 * y2) / (n1 + n2), k1 + k2])
    return np.concatenate([np.full(int(k), y) for _, y, k in blocks]) if blocks else np.zeros(0)


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats`` of every document; null texts count as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = text_statistics(batch.column(1)).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text()).mapInArrow(measure, f"doc_id {kind}, stats array<double>")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows outside fold 0: folds 1 to 3 give the ridge weights, fold 4 the calibration.

    Null labels and ids are ignored; rows that are labelled twice count twice. Without
    labelled rows every score is about one half.
    """
    size = len(STATISTICS)
    moments = stats.agg(*(F.avg(F.col("stats")[i]) for i in range(size)), *(F.stddev_pop(F.col("stats")[i]) for i in range(size))).first()
    mean = np.array([m or 0.0 for m in moments[:size]])
    deviation = np.array([m or 1.0 for m in moments[size:]])
    random = np.random.default_rng(SEED)
    model = Model(
        mean, deviation, random.normal(size=(size, COSINES)) / np.sqrt(size), random.uniform(0, 2 * np.pi, COSINES),
        np.zeros(0), np.zeros(0), np.zeros(0),
    )
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    known = known.where(fold("doc_id") != 0)
    share = min(1.0, sample / max(1, known.count()))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = cut_lineage(stats.join(known, "doc_id").select("stats", "y", (fold("doc_id") == 4).alias("calibrate")))
    width = 1 + size + COSINES

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        equations = np.zeros((width, width + 1))
        for batch in batches:
            if len(batch):
                x = cosines(batch.column(0).flatten().to_numpy().reshape(-1, size), model)
                equations += x.T @ np.column_stack([x, batch.column(1).to_numpy()])
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(0, equations.size + 1, width + 1, dtype=np.int32)), pa.array(equations.reshape(-1))
        )
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), lists], names=["row", "sums"])

    def add(pdf):
        import pandas as pd

        return pd.DataFrame({"row": pdf["row"].iloc[:1].to_list(), "sums": [np.sum(np.stack(pdf["sums"].to_list()), axis=0)]})

    # Few tasks: the sample is bounded, and every task sends one matrix.
    parts = rows.where(~F.col("calibrate")).select("stats", "y").coalesce(16).mapInArrow(sums, "row long, sums array<double>")
    added = sorted(parts.groupBy("row").applyInPandas(add, "row long, sums array<double>").collect())
    total = np.array([r["sums"] for r in added]) if added else np.zeros((width, width + 1))
    left, right = total[:, :-1], total[:, -1]
    model = model._replace(weights=np.linalg.solve(left + np.eye(width) * (RIDGE * max(left[0, 0], 1.0) + 1e-9), right))
    fitted = model

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                raw = fitted.raw(batch.column(0).flatten().to_numpy().reshape(-1, size))
                bin_of = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bin_of), pa.array(raw), batch.column(1)], names=["bin", "raw", "y"])

    levels = (
        rows.where("calibrate").select("stats", "y").mapInArrow(bins, "bin long, raw double, y double")
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw"), F.avg("y").alias("y")).orderBy("bin").collect()
    )  # at most BINS rows
    if not levels:
        return model._replace(edges=np.array([0.0, 1.0]), values=np.array([0.0, 1.0]) if added and total.any() else np.array([0.5, 0.5]))
    return model._replace(
        edges=np.array([r["raw"] for r in levels]),
        values=isotonic(np.array([r["n"] for r in levels], float), np.array([r["y"] for r in levels])),
    )


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out (fold 0), score and predicted (score at least ``cut``).

    Empty and null texts are scored like any other, from statistics that are all zero.
    Repeated rows are scored each. No documents: no rows.
    """
    stats = cut_lineage(statistics_table(docs))
    model = fit(stats, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents whose score is at least ``cut``, with all their columns."""
    model, names = fit(cut_lineage(statistics_table(docs)), labels), docs.columns

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keep = model.score(text_statistics(batch.column(batch.num_columns - 1))) >= cut
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).filter(pa.array(keep))

    return arrow_map(docs.select(*(F.col(f"`{c}`") for c in docs.columns), whole_text()), choose, docs.schema)
