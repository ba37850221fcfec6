"""Near-duplicate vectors by cross-polytope hashing with fast Hadamard rotations.

A vector is rotated by three rounds of sign flips and Hadamard butterflies; the largest
coordinate and its sign name the nearest corner of the cross-polytope. A table's key
joins three such corners. A vector is at *home* under its own key in each of six tables,
and a *guest* under ten more keys of each, the likeliest ones that a slip to the next
largest coordinates gives. Pairs that meet under a key, one of them at home, are verified
by their cosine in double precision.

No pair leaves a task. A pair is counted where it meets first, which both vectors' keys
tell, and a task gives back counts per vector and enough links to connect what it found.

Equal vectors are one entry from the start. In a crowd under one key, entries within half
the angle of its first entry are one *ball*: there all pairs are proved by the triangle
inequality, so they are counted and never compared. A key with very many entries is cut
into a grid of blocks of bounded size, where members of its largest ball do not meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_map, extended, fresh
from .graph import components

SIMILARITY = 0.95
SEED = 13
TABLES, CORNERS, GUESTS = 6, 3, 10
#: A key with more entries at home makes a ball.
CROWD = 48
#: A key with more entries is cut into blocks; a block holds about twice as many at most.
MOST = 4096
#: Next largest coordinates that guests may take: singly, and in pairs.
_SINGLE, _DOUBLE = 5, 2


def hadamard(x: np.ndarray) -> np.ndarray:
    """The rows' Walsh-Hadamard transforms, by butterflies; the row length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x


def corners(x: np.ndarray, flips: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest corners of rotated rows in order (twice the coordinate, plus its sign), and how large they are."""
    for signs in flips:
        x = hadamard(x * signs)
    size = np.abs(x)
    order = np.argsort(-size, axis=1, kind="stable")[:, :most]
    return 2 * order + (np.take_along_axis(x, order, 1) < 0), np.take_along_axis(size, order, 1)


def slips(most: int) -> list[tuple[int, ...]]:
    """Ranks of the corners that a guest's key takes instead of the first ones: one of them, or two."""
    single = [tuple(r if k == at else 0 for k in range(CORNERS)) for at in range(CORNERS) for r in range(1, min(_SINGLE, most - 1) + 1)]
    double = [
        tuple(r if k == one else s if k == two else 0 for k in range(CORNERS))
        for one in range(CORNERS) for two in range(one + 1, CORNERS)
        for r in range(1, min(_SINGLE, most - 1) + 1) for s in range(1, min(_DOUBLE, most - 1) + 1)
    ]
    return single + double


def keys(vectors: np.ndarray) -> np.ndarray:
    """Keys (row, table, 1 + guests): the home key comes first. Only sums and comparisons, so a row's keys never depend on other rows."""
    rows, size = vectors.shape
    padded = np.zeros((rows, max(4, 1 << (size - 1).bit_length())))
    # Scaled by a power of two, which is exact, so that no sum overflows.
    padded[:, :size] = vectors * np.exp2(-np.floor(np.log2(np.abs(vectors).max(axis=1))))[:, None]
    wide = padded.shape[1]
    most = min(wide, _SINGLE + 1)
    ranks = np.array(slips(most))
    rng = np.random.default_rng(SEED)
    out = np.empty((rows, TABLES, 1 + GUESTS), np.int64)
    for table in range(TABLES):
        found = [corners(padded, rng.choice([-1.0, 1.0], (3, wide)), most) for _ in range(CORNERS)]
        cost = sum((size[:, :1] - size[:, ranks[:, k]]) ** 2 for k, (_, size) in enumerate(found))
        chosen = ranks[np.argsort(cost, axis=1, kind="stable")[:, :GUESTS]]
        chosen = np.concatenate([np.zeros((rows, 1, CORNERS), np.int64), chosen], axis=1)
        key = np.full((rows, 1 + GUESTS), size % 4096 * TABLES + table, np.int64)
        for k, (corner, _) in enumerate(found):
            key = key * (1 << 15) + np.take_along_axis(corner, chosen[:, :, k], 1) % (1 << 15)
        out[:, table] = key
    return out


def meets_first(table: int, key: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of pairs of rows of ``keys`` that meet in ``table`` under ``key``: which of them meet nowhere before."""
    at_one, at_other = ((x[:, :, :1] == y).any(axis=2) for x, y in ((one, other), (other, one)))
    earlier = (at_one[:, :table] | at_other[:, :table]).any(axis=1)
    # Within the table they may meet at both homes: the smaller key counts.
    both = at_one[:, table] & at_other[:, table]
    return ~earlier & (~both | (np.minimum(one[:, table, 0], other[:, table, 0]) == key))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in pairs, each computed alone."""
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def near_pairs(
    home: np.ndarray, balls: np.ndarray, parts: np.ndarray, across: bool, vectors: np.ndarray, least: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one block's entries that link, as index lists in order, a bounded number at a time.

    Entries of one ball do not meet; with ``across`` only entries of different parts do.
    """
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    step = max(1, min(256, (1 << 21) // len(vectors)))
    for low in range(0, len(vectors), step):
        high = min(low + step, len(vectors))
        close = unit[low:high] @ unit.T >= least - 1e-9
        close &= np.arange(low, high)[:, None] < np.arange(len(vectors))
        close &= home[low:high, None] | home
        close &= balls[low:high, None] != balls
        if across:
            close &= parts[low:high, None] != parts
        i, j = np.nonzero(close)
        i += low
        if len(i):
            near = np.ones(len(i), bool)
            edge = np.abs((unit[i] * unit[j]).sum(axis=1) - least) < 2e-9
            near[edge] = cosines(vectors[i[edge]], vectors[j[edge]]) >= least
            yield i[near], j[near]


def settle(
    table: int, key: int, copies: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], held: np.ndarray, place: np.ndarray
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of a block's linked pairs: how many count here for each entry, and pairs that connect them. An entry's keys are ``held[place]``."""
    counts, edges, label = np.zeros(len(copies), np.int64), [], np.arange(len(copies))
    for i, j in pairs:
        for a in range(0, len(i), 1 << 15):
            p, q = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            first = meets_first(table, key, held[place[p]], held[place[q]])
            np.add.at(counts, p[first], copies[q[first]])
            np.add.at(counts, q[first], copies[p[first]])
        ones, starts = np.unique(i, return_index=True)
        for k, low, high in zip(ones.tolist(), starts.tolist(), [*starts[1:].tolist(), len(i)]):
            far = j[low:high][label[j[low:high]] != label[k]]
            if len(far):
                others, at = np.unique(label[far], return_index=True)
                edges += [(k, x) for x in far[at].tolist()]
                label[np.isin(label, others)] = label[k]
    return counts, edges


def _measured(vectors: DataFrame) -> DataFrame:
    """The rows with ``_digest``, equal for equal vectors, null for those that link with nothing."""
    name = fresh(vectors, "_digest")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = []
            for values in batch.column(1):
                one = None if not values.is_valid else values.values
                if one is None or not len(one) or one.null_count:
                    found.append(None)
                    continue
                x = one.to_numpy().astype(np.float64) + 0.0  # no negative zero
                found.append(xxhash.xxh3_128_digest(x.tobytes()) if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["vec_id", "embedding", name])

    rows = vectors.select("vec_id", "embedding")
    return arrow_map(rows, measure, extended(rows, f"`{name}` binary")).withColumnRenamed(name, "_digest")


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.stack([x.values.to_numpy().astype(np.float64) for x in lists])


def _entries(classes: DataFrame) -> DataFrame:
    """(table, key, node, home) of all keys of all classes (node, vector)."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1)])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                found = keys(_matrix(batch.column(1).take(pa.array(rows))))
                shape = found.shape
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.repeat(np.arange(shape[1], dtype=np.int32), shape[2]), shape[0])), pa.array(found.reshape(-1)),
                    pa.array(np.repeat(batch.column(0).to_numpy()[rows], shape[1] * shape[2])),
                    pa.array(np.tile(np.arange(shape[2]) == 0, shape[0] * shape[1])),
                ], names=["table", "key", "node", "home"])

    return classes.select("node", "vector").mapInArrow(file, "table int, key long, node long, home boolean")


def _balls(crowds: DataFrame, entries: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(node, ball): entries at home under a crowded key that are within half the angle of its first entry, the ball."""
    inner = math.sqrt((1 + least) / 2) + 1e-9  # the cosine of half the angle
    own = entries.where("home").join(crowds.select("key"), "key").select("key", "node")
    first = own.groupBy("key").agg(F.min("node").alias("ball"))
    centres = first.join(classes.select(F.col("node").alias("ball"), F.col("vector").alias("centre")), "ball")
    both = own.join(centres, "key").join(classes.select("node", "vector"), "node").where("size(vector) = size(centre)")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                k for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3)))
                if cosines(*(v.values.to_numpy().astype(np.float64)[None] for v in (x, y)))[0] >= inner
            ]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], names=["node", "ball"])

    near = both.select("node", "ball", "vector", "centre").mapInArrow(compare, "node long, ball long")
    return near.groupBy("node").agg(F.min("ball").alias("ball"))


def _blocks(entries: DataFrame, full: DataFrame, balls: DataFrame, most: int) -> DataFrame:
    """Entries with ball, and for those of full keys a row per block: cell, part, across.

    Parts of a full key: the entries outside its largest ball, and those inside, each cut
    into parts of about ``most``. A block is a pair of parts, not both inside.
    """
    entries = entries.join(balls, "node", "left").withColumn("ball", F.coalesce("ball", "node"))
    plain = entries.join(full.select("key"), "key", "left_anti").select(
        "*", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("part")
    )
    crowded = cut_lineage(entries.join(full.select("key"), "key", "left_semi"))
    sizes = crowded.groupBy("key", "ball").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "ball")).alias("top"), F.sum("n").alias("n")
    ).select(
        "key", F.col("top.ball").alias("largest"),
        F.ceil((F.col("n") - F.col("top.n")) / most).cast("int").alias("outside"), F.ceil(F.col("top.n") / most).cast("int").alias("inside"),
    )
    spread = F.pmod(F.xxhash64("node"), F.when(F.col("ball") == F.col("largest"), F.col("inside")).otherwise(F.col("outside"))).cast("int")
    parted = crowded.join(cut_lineage(sizes), "key").withColumn(
        "part", F.when(F.col("ball") == F.col("largest"), F.col("outside") + spread).otherwise(spread)
    )
    # Outside entries meet all parts; inside ones meet the outside parts only.
    last = F.when(F.col("part") < F.col("outside"), F.col("outside") + F.col("inside")).otherwise(F.col("outside"))
    met = parted.where("outside > 0").withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    grid = met.select(
        *entries.columns, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part"
    )
    return plain.unionByName(grid)


def near_vectors(vectors: DataFrame, least: float = SIMILARITY, most: int = MOST, crowd: int = CROWD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept.

    Vectors link from a cosine of ``least`` on. n_links counts the other rows that a row
    links with; component_id is the smallest vec_id that links reach, itself included;
    kept tells whether that is its own. Every returned link is verified; a pair of 64
    numbers at the threshold itself meets with a probability of 0.9999.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with
    nothing, and are their own component. So do vectors of different lengths with each
    other. Repeated rows, also of one id, are rows of their own and link. A null id never
    names a component unless all its ids are null. No vectors: no rows. Other columns play
    no part and are not returned.
    """
    rows = cut_lineage(_measured(vectors).withColumn("_row", F.monotonically_increasing_id()))
    classes = cut_lineage(
        rows.where("_digest IS NOT NULL").groupBy("_digest").agg(
            F.min("_row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("vector")
        )
    )
    entries = cut_lineage(_entries(classes))
    held = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("homes")).where("n > 1 AND homes > 0")
    held = cut_lineage(held)
    met = cut_lineage(entries.join(held.select("key"), "key", "left_semi"))
    full = held.where(F.col("n") > most)
    balls = cut_lineage(_balls(held.where(F.col("homes") > crowd), met, classes, least))
    blocks = _blocks(met, full, balls, most)
    whole = blocks.join(classes.select("node", "copies", "vector"), "node").select(
        F.xxhash64("key", "low", "high").alias("_at"), "key", "low", "high", "table", "node", "copies", "home", "ball", "part", "vector"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def found(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(10)]
            sizes = np.array([len(x) for x in batch.column(10)])
            group = np.stack([*at[:4], sizes], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, [len(batch)]])
            blocks = []
            wanted = np.zeros(len(batch), bool)
            for i, j in zip(edges.tolist(), edges[1:].tolist()):
                if j - i < 2 or not at[7][i:j].any():
                    continue
                block = (at[7][i:j].astype(bool), at[8][i:j], at[9][i:j], at[2][i] != at[3][i], _matrix(batch.column(10).slice(i, j - i)), least)
                for pair in near_pairs(*block):
                    for side in pair:
                        wanted[i + side] = True
                if wanted[i:j].any():
                    blocks.append((i, j, block))
            # Keys of all entries that link in some block of this batch, once for each vector.
            rows = np.flatnonzero(wanted)
            first = rows[np.unique(at[5][rows], return_index=True)[1]]
            held, of = np.zeros((len(first), TABLES, 1 + GUESTS), np.int64), np.full(len(batch), -1)
            for size in np.unique(sizes[first]).tolist():
                same = np.flatnonzero(sizes[first] == size)
                held[same] = keys(_matrix(batch.column(10).take(pa.array(first[same]))))
            of[rows] = np.searchsorted(at[5][first], at[5][rows])
            nodes, counts, ends = [], [], []
            for i, j, block in blocks:
                n, links = settle(int(at[4][i]), int(at[1][i]), at[6][i:j], near_pairs(*block), held, of[i:j])
                some = np.flatnonzero(n)
                nodes.append(at[5][i:j][some])
                counts.append(n[some])
                ends += at[5][i:j][np.array(links, np.int64).reshape(-1, 2)].tolist()
            nodes, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (nodes, counts))
            ends = np.array(ends, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([nodes, ends[:, 0]])), pa.array(np.concatenate([counts, np.zeros(len(ends), np.int64)])),
                pa.array(np.concatenate([nodes, ends[:, 1]])),
            ], names=["node", "links", "other"])

        for batch in batches:
            rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            order = rest.column(0).to_numpy()
            cut = int(np.searchsorted(order, order[-1])) if len(order) else 0  # the last block may go on
            if cut:
                yield found(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and len(rest):
            yield found(rest)

    # Equal hashes of different blocks only bring them together; the blocks are told apart by their own columns.
    dealt = whole.repartition("_at").sortWithinPartitions("_at", "key", "low", "high", F.size("vector"))
    verified = cut_lineage(dealt.mapInArrow(verify, "node long, links long, other long"))
    edges = verified.where("links = 0").select(F.col("node").alias("a"), F.col("other").alias("b")).union(
        balls.where("node <> ball").select("node", "ball")
    )
    linked = components(edges).withColumnRenamed("node", "_node")
    named = classes.join(linked, classes["node"] == linked["_node"], "left").select("node", "least", F.coalesce("root", "node").alias("_name"))
    named = cut_lineage(named)
    names = named.groupBy("_name").agg(F.min("least").alias("component_id"))
    weight = balls.join(classes.select("node", "copies"), "node")
    sums = weight.groupBy("ball").agg(F.sum("copies").alias("in_ball"))
    inside = weight.join(sums, "ball").select("node", (F.col("in_ball") - F.col("copies")).alias("inside"))
    outside = verified.where("links > 0").groupBy("node").agg(F.sum("links").alias("outside"))
    result = classes.select("_digest", "node", "copies").join(named.join(names, "_name").select("node", "component_id"), "node")
    result = result.join(cut_lineage(inside), "node", "left").join(outside, "node", "left").select(
        F.col("_digest").alias("_of"), "component_id",
        (F.col("copies") - 1 + F.coalesce("inside", F.lit(0)) + F.coalesce("outside", F.lit(0))).alias("n_links"),
    )
    result = cut_lineage(result)
    joined = rows.select("vec_id", "_digest").join(result, F.col("_digest") == F.col("_of"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("_of").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
    SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM vectors
    WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= {SIMILARITY}
), reached AS (
    SELECT vec_id AS node, vec_id AS root FROM vectors
    UNION
    SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.node WHERE reached.root < links.b
)
SELECT r.node AS vec_id, (SELECT count(*) FROM links WHERE links.a = r.node) AS n_links, min(r.root) AS component_id, r.node = min(r.root) AS kept
FROM reached r GROUP BY r.node
"""
