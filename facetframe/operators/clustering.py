"""Density clusters with outliers, on a grid.

Documents are counted per grid cell of the reduced vectors. Cells with enough
documents are dense; dense cells that touch form a cluster; a thin cell next to
a dense one joins it; everything else is an outlier. Documents are never
compared with each other, so a million copies of one text are one cell with a
large count. All iterative work runs on the dense cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..session import cut_lineage
from .vectors import numbered, renumber

SALTS = 16


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest node reachable from each node.

    Labels flow along edges, to the nodes and to the labels these had, and then jump to
    the label of their label: whole parts move at once, not their rims, so the number
    of rounds grows with the logarithm of a component's length. Each round is written
    to the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    while True:  # ends when no label changes: labels only fall
        heard = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        )
        spread = labels.join(heard, "node", "left").select(
            "node", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("old")
        )
        spread = cut_lineage(spread)
        told = spread.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("told"))
        spread = spread.join(told, "node", "left").select("node", F.least("label", F.coalesce("told", "label")).alias("label"), "old")
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = spread.join(jump, "label", "left").select(
            "node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"
        )
        # The changes are counted while the round is written.
        seen = Observation()
        moved = cut_lineage(moved.observe(seen, F.count_if(F.col("label") != F.col("old")).alias("changed")))
        labels = moved.select("node", "label")
        if not seen.get["changed"]:
            return labels


def neighbours(cell: str, dimensions: int, forward_only: bool):
    """The cells that share a face with a cell."""
    steps = (1,) if forward_only else (1, -1)
    moved = []
    for d in range(dimensions):
        for step in steps:
            moved.append(F.array(*[F.col(cell)[i] + (step if i == d else 0) for i in range(dimensions)]))
    return F.explode(F.array(*moved))


def cell_sides(points: DataFrame, min_samples: int, resolution: float) -> tuple[list[float], int]:
    """The side of a cell in each dimension, and the number of dimensions (0 without vectors).

    The middle of a normal cloud holds twice ``min_samples`` distinct places per cell.
    """
    dimensions = points.select(F.max(F.size("vec"))).first()[0]
    if not dimensions:
        return [], 0
    spread = points.select("vec").distinct().agg(
        F.count(F.lit(1)).alias("places"),
        *[F.coalesce(F.stddev_pop(F.col("vec")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(dimensions)],
    ).first()
    unit = (2 * min_samples * (2 * math.pi) ** (dimensions / 2) / spread["places"]) ** (1 / dimensions) / resolution
    return [max(spread[f"s{i}"] * unit, 1e-12) for i in range(dimensions)], dimensions


def _one_level(points: DataFrame, side: list[float], min_samples: int, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """``id vec label`` for one cell size (NULL label: outlier), and ``label size``."""
    cell = F.array(*[F.floor(F.col("vec")[i] / F.lit(side[i]))for i in range(dimensions)])
    placed = points.withColumn("cell", cell)
    cells = cut_lineage(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    dense = cells.filter(F.col("n") >= min_samples)
    steps = dense.select(F.col("cell").alias("a"), neighbours("cell", dimensions, True).alias("b"))
    edges = steps.join(dense.select(F.col("cell").alias("b")), "b", "left_semi")
    labels = connected_components(dense.select(F.col("cell").alias("node")), edges)

    core = labels.join(dense, labels["node"] == dense["cell"]).select("cell", "label", "n")
    thin = cells.filter(F.col("n") < min_samples)
    around = thin.select("cell", neighbours("cell", dimensions, False).alias("near"))
    border = (
        around.join(core.select(F.col("cell").alias("near"), "label", F.col("n").alias("weight")), "near")
        .groupBy("cell").agg(F.max_by("label", F.struct("weight", "label")).alias("label"))
    )
    mapped = core.select("cell", "label").unionByName(border)
    sizes = mapped.join(cells, "cell").groupBy("label").agg(F.sum("n").alias("size"))

    # A cell can hold a large share of all documents: spread it over salts.
    salted = placed.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = mapped.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["cell", "__salt"], "left").select("id", "vec", "label"), sizes


def density_clusters(
    vectors: DataFrame, min_topic_size: int = 15, min_samples: int | None = None, max_topic_size: float | None = None,
    resolution: float = 1.0,
) -> DataFrame:
    """``id``, ``topic``: clusters by size (0 is the largest), -1 for outliers.

    ``vectors`` holds ``id`` and a short ``vec`` (see ``reduce_dimensions``). The
    cell size is set so that the middle of a normal cloud would hold twice
    ``min_samples`` documents per cell; ``resolution`` scales the cells. Copies
    of a document share a place, and the size is taken from the distinct places,
    so that a much-copied text does not thin out the other clusters.
    Clusters above ``max_topic_size`` (a share of all documents) are split with
    cells half as wide, again and again. Only a cluster that is one place (to the
    precision of its numbers) and still too large becomes outliers.
    """
    if min_topic_size < 2:
        raise ValidationError("min_topic_size must be at least 2")
    min_samples = min(min_samples or min_topic_size, min_topic_size)
    points = vectors.filter(F.col("vec").isNotNull()).select("id", "vec")
    side, dimensions = cell_sides(points, min_samples, resolution)
    if not dimensions:
        return points.select("id", F.lit(-1).alias("topic"))
    limit = None if max_topic_size is None else int(max_topic_size * points.count())
    if limit is not None and min_topic_size >= limit:
        raise ValidationError("min_topic_size is not below the maximal topic size")

    done, pending, level = [], points, 0
    while True:
        labelled, sizes = _one_level(pending, side, min_samples, dimensions)
        fits = F.col("size") >= min_topic_size
        if limit is not None:
            fits = fits & (F.col("size") <= limit)
        # Outliers have no label and stay out of the join.
        verdict = sizes.select("label", fits.alias("fits"), (F.col("size") >= min_topic_size).alias("large"))
        known = labelled.filter("label IS NOT NULL").join(verdict, "label")
        judged = cut_lineage(known.unionByName(labelled.filter("label IS NULL"), allowMissingColumns=True))
        name = F.concat(F.lit(f"{level}:"), F.to_json("label"))
        done.append(judged.filter("fits").select("id", name.alias("cluster")))
        done.append(judged.filter("label IS NULL OR NOT large").select("id", F.lit(None).cast("string").alias("cluster")))
        if limit is None:
            break
        pending = judged.filter("large AND NOT fits")
        # Clusters of one place cannot be split.
        span = pending.groupBy("label").agg(*[
            (F.max(F.col("vec")[i]) - F.min(F.col("vec")[i]) <= F.greatest(F.lit(1e-300), F.max(F.abs(F.col("vec")[i])) * 2.0**-50)).alias(f"p{i}")
            for i in range(dimensions)
        ])
        one_place = F.lit(True)
        for i in range(dimensions):
            one_place = one_place & F.col(f"p{i}")
        stuck = cut_lineage(span.filter(one_place).select("label"))
        done.append(pending.join(stuck, "label", "left_semi").select("id", F.lit(None).cast("string").alias("cluster")))
        pending = cut_lineage(pending.join(stuck, "label", "left_anti").select("id", "vec"))
        if pending.isEmpty():
            break
        side, level = [s / 2 for s in side], level + 1

    assigned = done[0]
    for part in done[1:]:
        assigned = assigned.unionByName(part)
    # Number the clusters in a fixed order first, then by size.
    names = assigned.filter("cluster IS NOT NULL").select("cluster").distinct()
    ids = numbered(names, "cluster").select("cluster", F.col("number").alias("topic"))
    named = assigned.filter("cluster IS NOT NULL").join(ids, "cluster").select("id", "topic")
    loose = assigned.filter("cluster IS NULL").select("id", F.lit(-1).alias("topic"))
    return renumber(named.unionByName(loose))
