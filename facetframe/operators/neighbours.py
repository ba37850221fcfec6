"""A graph of near neighbours, and the map that its leading eigenvectors draw.

Neighbours are looked for in sorted orders: vectors are projected on a few random
directions, the projections' bits are interleaved to one key, and runs of equal length of
the sorted keys are compared within. Runs have a fixed length, so crowds of equal vectors
only fill more of them. What several orders find is then improved by exchange: neighbours of
neighbours, and of those that name a document as theirs, are candidates too.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..session import cut_lineage, stage_scope
from . import spectral
from .spectral import gram, turned
from .vectors import numbered

#: Documents in a run whose pairs are compared.
RUN = 256
#: Directions a sorted order takes its keys from, and the bits of each.
DIRECTIONS, BITS = 4, 12
#: Nearest neighbours, of either direction, that take part in an exchange.
REACH = 8
#: Steps from 0 to 1 of the coarse vectors that exchanges compare first.
STEPS = 32_767
#: Exchanges end when at most this share of the links is new.
SETTLED = 0.01
#: The least weight of a link along the first order; it keeps the graph in one piece.
THREAD = 1e-4


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``id``, ``vec`` of unit length. NULL and zero vectors, and those with NULL or non-finite numbers, go."""
    vec = F.col("vec").cast("array<double>")
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    known = vectors.select("id", vec.alias("vec"), length.alias("__length")).filter(
        (F.col("__length") > 0) & (F.col("__length") < float("inf")) & ~F.isnan("__length")
    )
    return known.select("id", F.transform("vec", lambda x: x / F.col("__length")).alias("vec"))


def _rows(vectors: DataFrame) -> DataFrame:
    """The unit vectors, stored, with a unique ``row``: ids may repeat."""
    return cut_lineage(unit_vectors(vectors).withColumn("row", F.monotonically_increasing_id()))


def _order(frame: DataFrame, mean: np.ndarray, spread: np.ndarray, rng: np.random.Generator) -> DataFrame:
    """``row``, ``id``, ``number``: places in the order of the interleaved bits of random projections. Vectors stay where they are."""
    ways = rng.normal(size=(len(mean), DIRECTIONS))
    scale = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", ways, spread, ways), 1e-300))
    shift = rng.uniform(-0.5, 0.5, DIRECTIONS)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            z = (np.array(pdf["vec"].tolist()) - mean) @ ways / scale + shift
            level = np.clip((1 / (1 + np.exp(-1.7 * z))) * 2**BITS, 0, 2**BITS - 1).astype(np.int64)
            key = np.zeros(len(pdf), np.int64)
            for bit in range(BITS - 1, -1, -1):
                for way in range(DIRECTIONS):
                    key = key << 1 | level[:, way] >> bit & 1
            yield pdf[["row", "id"]].assign(key=key)

    kind = frame.schema["id"].dataType.simpleString()
    keyed = cut_lineage(frame.mapInPandas(keys, f"row long, id {kind}, key long"))
    return cut_lineage(numbered(keyed, "key", "id").select("row", "id", "number"))


def _within_runs(orders: list[DataFrame], unit: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each document among those in its run, for every order. A vector moves once an order."""
    kind = unit.schema["id"].dataType.simpleString()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["id"].to_numpy(), np.array(pdf["vec"].tolist())
        far = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) if len(x) * x.size < 4_000_000 else _squared(x)
        np.fill_diagonal(far, np.inf)
        keep = min(k, len(ids) - 1)
        near = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, :keep]
        rows = np.repeat(np.arange(len(ids)), keep)
        return pd.DataFrame({"id": ids[rows], "other": ids[near.ravel()], "squared": far[rows, near.ravel()]})

    run = F.floor(F.col("number") / RUN)
    placed = [ordered.select("row", F.lit(i).alias("order"), run.alias("run")) for i, ordered in enumerate(orders)]
    runs = functools.reduce(DataFrame.unionByName, placed).join(unit, "row").select("order", "run", "id", "vec")
    return runs.groupBy("order", "run").applyInPandas(compare, f"id {kind}, other {kind}, squared double")


def _squared(x: np.ndarray) -> np.ndarray:
    length = (x * x).sum(axis=1)
    return np.maximum(length[:, None] + length - 2 * x @ x.T, 0.0)


def _best(pairs: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` nearest pairs of each ``key``; a task keeps k a key before the shuffle."""
    other = "other" if key == "id" else "id"
    place = F.row_number().over(W.partitionBy(key).orderBy("squared", other))
    return pairs.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


def near_neighbours(vectors: DataFrame, k: int = 15, orders: int = 4, exchanges: int = 12, seed: int = 7) -> DataFrame:
    """``id``, ``other``, ``distance``: about the ``k`` nearest others of each unit vector, by Euclidean distance.

    ``vectors`` has unique ``id`` and ``vec``, all of one length; see ``unit_vectors`` for
    those that take no part. Exchanges go on until few links are new, ``exchanges`` times
    at most. Distances are exact; a true neighbour may be missing, the share found is 0.9
    or more on the data of the tests. Of equally near ones the
    lowest ids count among those found. A single vector has no neighbour.
    """
    if k < 1:
        raise ValidationError("k must be positive")
    with stage_scope(vectors.sparkSession):
        found, _ = _search(_rows(vectors), k, orders, exchanges, seed)
        return cut_lineage(found.select("id", "other", F.sqrt("squared").alias("distance")), outlive=True)


def _search(unit: DataFrame, k: int, orders: int, exchanges: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The neighbours (``squared`` distances), and the first order."""
    kind = unit.schema["id"].dataType.simpleString()
    rng = np.random.default_rng(seed)
    sums = gram(unit.select(F.concat(F.array(F.lit(1.0)), "vec").alias("a")), "a", "a")
    if not sums.size:
        return unit.sparkSession.createDataFrame([], f"id {kind}, other {kind}, squared double"), unit.select("row", "id", F.lit(0).cast("long").alias("number"))
    mean = sums[0, 1:] / sums[0, 0]
    spread = sums[1:, 1:] / sums[0, 0] - np.outer(mean, mean)
    sorted_by = [_order(unit, mean, spread, rng) for _ in range(orders)]
    pairs = _within_runs(sorted_by, unit, k).withColumn("round", F.lit(0))
    near = cut_lineage(_nearest(pairs, k))
    # What an exchange compares first: vectors in steps of one in STEPS, a quarter of their size.
    steps = F.transform("vec", lambda x: F.round(x * STEPS).cast("smallint"))
    coarse, links = cut_lineage(unit.select("id", steps.alias("steps"))), None
    for turn in range(1, exchanges + 1):
        near, links = _exchanged(near, links, unit, coarse, k, turn)
        if near.filter(F.col("round") == turn).count() <= SETTLED * near.count():
            break
    return near.select("id", "other", "squared"), sorted_by[0]


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest pairs of each ``id``, each once, from the first ``round`` that found it."""
    once = pairs.repartition("id").groupBy("id", "other").agg(F.min("squared").alias("squared"), F.min("round").alias("round"))
    return _best(once, "id", k)


def _exchanged(near: DataFrame, before: DataFrame | None, unit: DataFrame, coarse: DataFrame, k: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Neighbours improved by those of their neighbours, and the links they were exchanged along.

    Every document brings REACH links of either direction at most. Two links that met
    ``before`` do not meet again. Those that do are compared by ``coarse`` vectors; the bound
    on their error lets every pair through that may replace a neighbour of either end, and
    these alone are measured.
    """
    forth = _best(near, "id", REACH).select("id", "other")
    back = _best(near, "other", REACH).select(F.col("other").alias("id"), F.col("id").alias("other"))
    links = forth.union(back).distinct()
    if before is None:
        links = links.withColumn("fresh", F.lit(True))
    else:
        known = before.select("id", "other", F.lit(True).alias("known"))
        links = links.join(known, ["id", "other"], "left").select("id", "other", F.col("known").isNull().alias("fresh"))
    links = cut_lineage(links)
    last = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("squared", "other")).alias("last"))
    widest = F.when(F.col("n") < k, float("inf")).otherwise(F.col("last.squared"))
    ends = coarse.join(last, "id").select(F.col("id").alias("other"), widest.alias("widest"), F.col("last.other").alias("last"), "steps")
    met = links.join(links.filter("fresh").select("id").distinct(), "id", "left_semi").join(ends, "other")
    held = F.collect_list(F.struct("other", "fresh", "widest", "last", "steps")).alias("e")
    met = met.repartition("id").groupBy("id").agg(held).select(*[F.col("e")[c].alias(c) for c in ("other", "fresh", "widest", "last")], F.flatten(F.col("e")["steps"]).alias("steps"))
    kind = unit.schema["id"].dataType.simpleString()
    found = met.mapInArrow(_may_replace, f"id {kind}, other {kind}").distinct()
    found = found.join(near.select("id", "other"), ["id", "other"], "left_anti")
    pairs = found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    x, y = (unit.select(F.col("id").alias(n), F.col("vec").alias("v" + n)) for n in "ab")
    squares = F.zip_with("va", "vb", lambda p, q: (p - q) * (p - q))
    measured = pairs.join(x, "a").join(y, "b").select("a", "b", F.aggregate(squares, F.lit(0.0), lambda s, v: s + v).alias("squared"))
    both = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
    more = measured.select(F.explode(both).alias("e"), "squared").select("e.id", "e.other", "squared", F.lit(turn).alias("round"))
    return cut_lineage(_nearest(near.unionByName(more), k)), links


def _may_replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id``, ``other`` among the ends of a document's links: ``other`` may be nearer than the last neighbour of ``id``."""
    for whole in batches:
        for low in range(0, len(whole), 256):
            batch = whole.slice(low, 256)
            kind = batch.schema.field(0).type.value_type
            other, fresh, widest, last, steps = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(5))
            if not len(other):
                continue
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            wide = int(sizes.max())
            at = np.cumsum(sizes)[:, None] - sizes[:, None] + np.arange(wide)
            real = np.arange(wide) < sizes[:, None]
            at = np.where(real, at, 0)
            x = steps.reshape(len(other), -1).astype(float)[at]
            length = (x * x).sum(axis=2)
            # Whole numbers below 2 ** 53: nothing is rounded.
            far = np.sqrt(np.maximum(length[:, :, None] + length[:, None, :] - 2 * x @ x.transpose(0, 2, 1), 0.0)) / STEPS
            least = far - math.sqrt(x.shape[2]) / STEPS - 1e-6
            mine, theirs = other[at][:, :, None], other[at][:, None, :]
            limit, after = widest[at][:, :, None], last[at][:, :, None]
            may = real[:, :, None] & real[:, None, :] & (fresh[at][:, :, None] | fresh[at][:, None, :]) & (mine != theirs)
            # Where all neighbours are at the same place, only lower ids at that place count.
            may &= (least <= np.sqrt(limit)) & ((limit > 0) | (theirs < after))
            row, i, j = np.nonzero(may)
            yield pa.RecordBatch.from_arrays(
                [pa.array(other[at[row, i]], kind), pa.array(other[at[row, j]], kind)], names=["id", "other"]
            )


def _links(near: DataFrame, first: DataFrame, unit: DataFrame) -> DataFrame:
    """``a`` < ``b``, ``w``: the graph without directions.

    The weight is exp(-d² / (s t)), where s and t are the distances of both ends' farthest
    neighbours. Neighbours in the first order are linked as well, however weakly, which
    leaves no document apart.
    """
    scale = near.groupBy("id").agg(F.max("squared").alias("widest"))
    along = cut_lineage(first.select("row", "number").join(unit, "row").select("id", "vec", "number"))
    after = along.select(F.col("id").alias("other"), F.col("vec").alias("next"), (F.col("number") - 1).alias("number"))
    squares = F.zip_with("vec", "next", lambda p, q: (p - q) * (p - q))
    thread = along.join(after, "number").select("id", "other", F.aggregate(squares, F.lit(0.0), lambda s, v: s + v).alias("squared"))
    edges = near.unionByName(thread).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "squared")
    # Both directions measured the same distance, but for rounding.
    edges = edges.groupBy("a", "b").agg(F.min("squared").alias("squared"))
    for end in "ab":
        edges = edges.join(scale.select(F.col("id").alias(end), F.col("widest").alias("w" + end)), end)
    both = F.sqrt(F.col("wa") * F.col("wb"))
    weight = F.when(F.col("squared") <= 0, 1.0).when(both <= 0, THREAD).otherwise(F.greatest(F.exp(-F.col("squared") / both), F.lit(THREAD)))
    return edges.select("a", "b", weight.alias("w"))


def _walk(links: DataFrame, degrees: DataFrame, columns: DataFrame) -> DataFrame:
    """Half the walk plus half standing still, made symmetric, as salted entries."""
    ends = (degrees.select(F.col("col").alias(end), F.col("degree").alias("d" + end)) for end in "ab")
    for end, known in zip("ab", ends):
        links = links.join(known, end)
    step = F.col("w") / 2 / F.sqrt(F.col("da") * F.col("db"))
    both = F.array(F.struct(F.col("a").alias("row"), F.col("b").alias("col")), F.struct(F.col("b").alias("row"), F.col("a").alias("col")))
    moved = links.select(F.explode(both).alias("e"), step.alias("w")).select("e.row", "e.col", "w")
    still = degrees.select(F.col("col").alias("row"), "col", F.lit(0.5).alias("w"))
    return cut_lineage(spectral.salted(moved.unionByName(still).join(columns, "col")))


def layout(
    vectors: DataFrame, size: int = 2, k: int = 15, orders: int = 4, exchanges: int = 12, tolerance: float = 1e-2, seed: int = 7
) -> tuple[np.ndarray, DataFrame]:
    """Eigenvalues, and ``id``, ``vec``: the ``size`` smoothest coordinates over the graph of neighbours.

    They are eigenvectors of the random walk on the graph after the constant one, so
    neighbours lie close together. With the links as rows, each holding its two ends,
    half the walk plus half standing still is a matrix times its transpose, and the
    coordinates are its singular vectors. Each coordinate has a mean square of one, and the
    sign that makes its sum of cubes positive. Documents without a usable vector are
    absent. ``tolerance`` is that of ``spectral.leading_vectors``. Where the graph has fewer coordinates (two documents have none), the rest is 0.
    """
    spark = vectors.sparkSession
    with stage_scope(spark):
        unit = _rows(vectors)
        near, first = _search(unit, k, orders, exchanges, seed)
        links = cut_lineage(_links(near, first, unit))
        if links.isEmpty():
            zero = F.array(*[F.lit(0.0)] * size)
            return np.zeros(0), cut_lineage(unit.select("id", zero.alias("vec")), outlive=True)
        ends = F.explode(F.array("a", "b")).alias("col")
        degrees = cut_lineage(links.select("w", ends).groupBy("col").agg(F.sum("w").alias("degree"), F.count(F.lit(1)).alias("rows")))
        columns = cut_lineage(spectral.spread_columns(degrees))
        halves = links.select(F.struct("a", "b").alias("row"), "w", ends).join(degrees, "col").join(columns, "col")
        entries = cut_lineage(spectral.salted(halves.withColumn("w", F.sqrt(F.col("w") / 2 / F.col("degree")))))
        values, right = spectral.leading_vectors(entries, columns, size + 1, tolerance, multiplied=lambda: _walk(links, degrees, columns))
        # The constant is known: the root of the degrees. Groups that hang together weakly have nearly
        # equal values, in which it may be mixed with others, so it is turned out of the vectors found.
        n = math.sqrt(columns.count())
        rooted = right.join(degrees, "col").select(F.col("col").alias("id"), "vec", F.array(F.sqrt("degree")).alias("root"))
        constant = gram(rooted, "vec", "root")
        others = np.linalg.svd(constant.T)[2][1:].T
        levels, mix = np.linalg.eigh(others.T @ np.diag(values**2) @ others)
        levels, mix = levels[::-1], others @ mix[:, ::-1]
        width = len(levels)
        scaled = turned(rooted, "vec", mix).select("id", F.transform("vec", lambda x: x / F.col("root")[0]).alias("vec"))
        at = [F.col("vec")[i] for i in range(width)]
        sums = scaled.agg(*[F.sum(x * x) for x in at], *[F.sum(x * x * x) for x in at]).first() if width else ()
        by = np.diag([(1.0 if sums[width + i] >= 0 else -1.0) * n / max(math.sqrt(sums[i]), 1e-300) for i in range(width)])
        by = np.hstack([by, np.zeros((width, size - width))])
        made = turned(scaled, "vec", by)
        return 2 * levels - 1, cut_lineage(made, outlive=True)
