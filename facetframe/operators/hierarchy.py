"""Clusters of varying density: a hierarchy of density levels, cut where clusters last longest.

Documents are counted per grid cell. At every level of density the cells at or above
it form components; a component of one level lies in one component of the level
below, so the components are a tree. Where a component comes apart into two or more
large enough ones, new clusters begin; otherwise it goes on, a little smaller. A
cluster's stability is its excess of mass: its documents summed over the densities at
which it lasts. Bottom-up, a cluster is kept if it is at least as stable as the best
choice below it.

Levels are spaced evenly on a logarithmic scale, so their number grows with the
logarithm of the fullest cell only, and the components of all levels are found in one
run. Documents are never compared with each other: a million copies are one cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..session import cut_lineage, stage_scope
from .clustering import SALTS, cell_sides, connected_components, neighbours
from .vectors import numbered, renumber


def density_levels(
    vectors: DataFrame, min_samples: int, per_doubling: int = 4, resolution: float = 1.0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree of density levels over the cells of ``vectors`` (``id``, short ``vec``).

    Level j holds the cells with ``min_samples * 2 ** (j / per_doubling)`` documents or
    more; cells touch where they share a face. Returns

    * placed vectors: ``id``, ``cell``;
    * cells with their components: ``level``, ``cell``, ``n``, ``label`` (the smallest cell of the component);
    * components: ``level``, ``label``, ``parent`` (label one level below, NULL at level 0), ``mass`` (documents), ``cells``.

    Vectors that are NULL have no place. No vectors give empty tables.
    """
    points = vectors.filter(F.col("vec").isNotNull()).select("id", "vec")
    side, dimensions = cell_sides(points, min_samples, resolution)
    cell = F.array(*[F.floor(F.col("vec")[i] / F.lit(side[i])) for i in range(dimensions)]) if dimensions else F.array().cast("array<bigint>")
    placed = points.select("id", cell.alias("cell"))
    cells = cut_lineage(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    # A trace is added, as a ratio that is a power of two may come out a little below its logarithm.
    top = F.floor(F.log2(F.col("n") / F.lit(min_samples)) * per_doubling + F.lit(1e-9)).cast("int")
    dense = cut_lineage(cells.filter(F.col("n") >= min_samples).withColumn("top", top))
    levels = F.explode(F.sequence(F.lit(0), F.col("top")))
    node = F.struct("level", "cell")
    nodes = dense.select("cell", "n", levels.alias("level"))
    if dimensions:
        touching = dense.select(F.col("cell").alias("a"), F.col("top").alias("ta"), neighbours("cell", dimensions, True).alias("b"))
        touching = touching.join(dense.select(F.col("cell").alias("b"), F.col("top").alias("tb")), "b")
        edges = touching.select("a", "b", F.explode(F.sequence(F.lit(0), F.least("ta", "tb"))).alias("level")).select(
            F.struct("level", F.col("a").alias("cell")).alias("a"), F.struct("level", F.col("b").alias("cell")).alias("b")
        )
    else:
        edges = nodes.limit(0).select(node.alias("a"), node.alias("b"))
    found = connected_components(nodes.select(node.alias("node")), edges)
    labelled = found.select(F.col("node.level").alias("level"), F.col("node.cell").alias("cell"), F.col("label.cell").alias("label"))
    labelled = cut_lineage(labelled.join(dense.select("cell", "n"), "cell").select("level", "cell", "n", "label"))
    components = labelled.groupBy("level", "label").agg(F.sum("n").alias("mass"), F.count(F.lit(1)).alias("cells"))
    # The cell that names a component also stands one level below, in the component's parent.
    below = labelled.select((F.col("level") + 1).alias("level"), F.col("cell").alias("label"), F.col("label").alias("parent"))
    components = cut_lineage(components.join(below, ["level", "label"], "left").select("level", "label", "parent", "mass", "cells"))
    return placed, labelled, components


def condensed_clusters(components: DataFrame, dimensions: int, min_samples: int, smallest: int, largest: int | None, per_doubling: int) -> DataFrame:
    """The clusters of a tree of levels: ``level`` and ``label`` of the component that each begins as, and those
    of the ``parent`` cluster that it broke off (a struct, NULL for roots), ``mass`` at its beginning and ``stability``.

    Components below ``smallest`` or above ``largest`` documents take no part. The
    density of a cell is taken as the root of its count by the number of dimensions:
    one over the distance of neighbours.
    """
    sized = components.filter(F.col("mass") >= smallest)
    if largest is not None:
        sized = sized.filter(F.col("mass") <= largest)
    me = F.struct("level", "label")
    # ``over``: the component one level below, if it takes part.
    tree = sized.select(me.alias("node"), F.struct((F.col("level") - 1).alias("level"), F.col("parent").alias("label")).alias("over"), "mass")
    known = sized.select(me.alias("over"), F.lit(True).alias("inside"))
    tree = cut_lineage(tree.join(known, "over", "left").select("node", F.when(F.col("inside"), F.col("over")).alias("over"), "mass"))
    parts = tree.filter("over IS NOT NULL").groupBy("over").agg(F.count(F.lit(1)).alias("parts"))
    tree = cut_lineage(tree.join(parts, "over", "left").select("node", "over", "mass", "parts"))
    # A component that is the only large part of the one below is the same cluster; the smallest node is its beginning.
    same = tree.filter("parts = 1").select(F.col("node").alias("a"), F.col("over").alias("b"))
    begun = connected_components(tree.select("node"), same).withColumnRenamed("label", "cluster")
    tree = cut_lineage(tree.join(begun, "node"))
    density = lambda level: F.pow(
        F.lit(float(min_samples)) * F.pow(F.lit(2.0), level / F.lit(float(per_doubling))), F.lit(1.0 / max(dimensions, 1))
    )
    level = F.col("node.level")
    stability = tree.groupBy("cluster").agg(
        F.sum(F.col("mass") * (density(level) - density(level - 1))).alias("stability")
    )
    first = tree.filter("node = cluster").select("cluster", "over", "mass")
    owner = tree.select(F.col("node").alias("over"), F.col("cluster").alias("parent"))
    first = first.join(owner, "over", "left").join(stability, "cluster")
    return cut_lineage(first.select("cluster.level", "cluster.label", "parent", "mass", "stability"))


def most_stable(clusters: DataFrame) -> DataFrame:
    """``level``, ``label`` of the clusters to keep: no two nested, the sum of their stabilities the largest.

    Of a cluster and an equally good choice below it, the cluster is kept. Rounds
    follow the height of the tree of clusters, not their number.
    """
    me = F.struct("level", "label")
    tree = cut_lineage(clusters.select(me.alias("cluster"), "parent", "stability"))
    parts = tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.count(F.lit(1)).alias("parts"))
    waiting = cut_lineage(tree.join(parts, "cluster", "left").select(
        "cluster", "parent", "stability", F.coalesce("parts", F.lit(0)).alias("parts"), F.lit(0).cast("long").alias("heard"), F.lit(0.0).alias("below")
    ))
    judged = []
    while True:  # bottom-up: a cluster is judged once all its parts are
        ready = waiting.filter("heard = parts").select(
            "cluster", "parent", F.greatest("stability", "below").alias("best"), (F.col("stability") >= F.col("below")).alias("kept")
        )
        ready = cut_lineage(ready)
        if ready.isEmpty():
            break
        judged.append(ready)
        told = ready.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(
            F.count(F.lit(1)).alias("more"), F.sum("best").alias("gain")
        )
        waiting = cut_lineage(waiting.filter("heard < parts").join(told, "cluster", "left").select(
            "cluster", "parent", "stability", "parts", (F.col("heard") + F.coalesce("more", F.lit(0))).alias("heard"),
            (F.col("below") + F.coalesce("gain", F.lit(0.0))).alias("below"),
        ))
    if not judged:
        return clusters.limit(0).select("level", "label")
    verdicts = judged[0]
    for part in judged[1:]:
        verdicts = verdicts.unionByName(part)
    verdicts = cut_lineage(verdicts.select("cluster", "parent", "kept"))
    chosen, open_ = [], verdicts.filter("parent IS NULL")
    while not open_.isEmpty():  # top-down: below a kept cluster nothing is kept
        chosen.append(open_.filter("kept").select("cluster.level", "cluster.label"))
        passed = open_.filter("NOT kept").select(F.col("cluster").alias("parent"))
        open_ = cut_lineage(verdicts.join(passed, "parent", "left_semi").select("cluster", "parent", "kept"))
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return cut_lineage(out)


def density_hierarchy(
    vectors: DataFrame, min_topic_size: int = 15, min_samples: int | None = None, max_topic_size: float | None = None,
    resolution: float = 1.0, per_doubling: int = 4,
) -> DataFrame:
    """``id``, ``topic``: the most stable clusters of all densities, by size (0 is the largest), -1 for outliers.

    Takes what ``clustering.density_clusters`` takes, and ``per_doubling``, the number of
    density levels between a density and its double. A cluster holds the cells of the
    component it begins as and the thin cells that share a face with them (of several
    clusters, the fullest neighbouring cell's, then the last in order). Components
    above ``max_topic_size`` (a share of all documents) are no clusters, their parts
    may be. NULL vectors have no row; no vectors give no rows.
    """
    if min_topic_size < 2:
        raise ValidationError("min_topic_size must be at least 2")
    min_samples = min(min_samples or min_topic_size, min_topic_size)
    with stage_scope(vectors.sparkSession):
        placed, labelled, components = density_levels(vectors, min_samples, per_doubling, resolution)
        placed = cut_lineage(placed)
        limit = None
        if max_topic_size is not None:
            limit = int(max_topic_size * placed.count())
            if min_topic_size >= limit:
                raise ValidationError("min_topic_size is not below the maximal topic size")
        dimensions = placed.select(F.max(F.size("cell"))).first()[0] or 0
        kept = most_stable(condensed_clusters(components, dimensions, min_samples, min_topic_size, limit, per_doubling))
        ids = numbered(kept, "level", "label").select("level", "label", F.col("number").alias("topic"))
        core = cut_lineage(labelled.join(ids, ["level", "label"]).select("cell", "n", "topic"))
        mapped = core.select("cell", "topic")
        if dimensions:
            thin = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < min_samples)
            around = thin.select("cell", neighbours("cell", dimensions, False).alias("near"))
            border = around.join(core.select(F.col("cell").alias("near"), "topic", F.col("n").alias("weight")), "near")
            mapped = mapped.unionByName(border.groupBy("cell").agg(F.max_by("topic", F.struct("weight", "topic")).alias("topic")))
        # A cell can hold a large share of all documents: spread it over salts.
        salted = placed.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        copies = mapped.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = salted.join(copies, ["cell", "__salt"], "left").select("id", F.coalesce("topic", F.lit(-1)).alias("topic"))
        return cut_lineage(renumber(cut_lineage(found)), outlive=True)
