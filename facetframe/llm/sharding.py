"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Documents with equal texts form a group. Small groups are gathered by a hash of their
text into a fixed number of cells; a group that outweighs a cell is an item of its own,
cut by rows only when it is heavier than a quarter of a shard. The driver therefore places a number of
items that is bounded by parameters: largest first, each in the shard where the dot
product of its vector with the residual capacity is highest, among those with room
left in bytes. Shuffles carry digests, never texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import numbered, whole_text

SHARDS = 8
#: Cells of small groups; the balance is about as fine as one cell.
CELLS = 16384
#: Groups above one part in HEAVY of all bytes, tokens or rows are items of their own: at most 3 * HEAVY.
HEAVY = 4096


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every item (rows of ``vectors``: bytes, tokens, rows), largest item first.

    An item goes where its vector, in units of the totals, meets the largest residual
    capacity, if that shard still has room for it in bytes; if none has, to the shard
    with most room in bytes. Ties go to the lower shard.
    """
    total = np.maximum(vectors.sum(axis=0), 1)
    unit = vectors / total
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int64)
    for item in np.lexsort((np.arange(len(unit)), -unit[:, 0])):
        need = unit[item]
        room = residual[:, 0] >= need[0] - 1e-15
        best = int(np.argmax(np.where(room, residual @ need, -np.inf))) if room.any() else int(np.argmax(residual[:, 0]))
        residual[best] -= need
        out[item] = best
    return out


def shard(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS, heavy: int = HEAVY) -> DataFrame:
    """Assign every document: doc_id, size, text_crc32, tokens, law, shard, slot, grown_shard.

    ``size`` is UTF-8 bytes plus one, ``tokens`` counts words between white space. The
    law is ``bytes``: shard sizes near equal; equal texts stay together unless their
    group is heavier than a small part of a shard and has to be cut. ``grown_shard`` is
    null. Null and empty texts are one group of size 1 each row; repeated rows are
    placed one by one; no documents, no rows.
    """
    text = whole_text()
    words = F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        words.cast("long").alias("tokens"), F.md5(text.cast("binary")).alias("_group"),
        F.monotonically_increasing_id().alias("_row"),  # written with the rows, so it stays the same
    )
    rows = cut_lineage(rows)
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    if not total[2]:
        return rows.select(
            "doc_id", "size", "text_crc32", "tokens", F.lit("bytes").alias("law"), F.lit(0).alias("shard"),
            F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    limits = [max(1, (x or 0) // heavy) for x in total]
    groups = rows.groupBy("_group").agg(
        F.count(F.lit(1)).alias("n"), F.max("size").alias("bytes"), F.max("tokens").alias("words")
    )
    share = F.greatest(
        F.col("n") * F.col("bytes") / total[0], F.col("n") * F.col("words") / max(1, total[1]), F.col("n") / total[2]
    )
    large = cut_lineage(
        groups.where(
            (F.col("n") * F.col("bytes") > limits[0]) | (F.col("n") * F.col("words") > limits[1]) | (F.col("n") > limits[2])
        ).select(
            "_group",
            # A group above a quarter of a shard is cut into parts of a sixteenth, if it has as many rows.
            F.when(share > 1 / (4 * shards), F.least(F.col("n"), F.ceil(share * 16 * shards))).otherwise(1).alias("_parts"),
        )
    )
    part = F.pmod(F.xxhash64("_row"), F.col("_parts"))
    cell = F.pmod(F.xxhash64("_group"), F.lit(cells)).cast("string")
    # Its size is bounded: at most 3 * heavy rows of 50 bytes.
    rows = rows.join(F.broadcast(large), "_group", "left").withColumn(
        "_item", F.when(F.col("_parts").isNull(), cell).otherwise(F.concat_ws(":", F.col("_group"), part.cast("string")))
    )
    items = (
        rows.groupBy("_item").agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).orderBy("_item").toPandas()
    )  # at most cells + 3 * heavy rows and the parts of groups that were cut
    items["shard"] = place(items.iloc[:, 1:4].to_numpy(np.float64), shards)
    spark = docs.sparkSession
    where = cut_lineage(spark.createDataFrame(items[["_item", "shard"]], "_item string, shard int"))
    rows = rows.join(F.broadcast(where), "_item").select("doc_id", "size", "text_crc32", "tokens", "shard")
    return numbered(rows, "shard", "slot").select(
        "doc_id", "size", "text_crc32", "tokens", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
