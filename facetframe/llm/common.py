"""What the training-data operators share: inputs, folds, numbered rows and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure, cut_lineage

#: Rows of an Arrow batch. Documents may be long, so a batch holds few of them: what a worker works out for a batch grows with it.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Session options of these operators: small Arrow batches and adaptive joins."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def extended(df: DataFrame, columns: str) -> T.StructType:
    """The schema of ``df`` with more columns, given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(columns).fields])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def arrow_map(df: DataFrame, function, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for frames with any column names; ``function`` works by position."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))).mapInArrow(function, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column | str) -> Column:
    """The fold 0 to 4 of a document: crc32 of the id as text, modulo 5. A null id counts as empty text."""
    ref = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(ref.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def whole_text(name: str = "text") -> Column:
    """The text of a row; a null text counts as empty."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


#: Most 64-bit words of a filter of keys, 8 MB.
FILTER_WORDS = 1 << 20


def key_filter(keys: DataFrame, name: str, most: int = FILTER_WORDS):
    """A test for columns of keys that is true for every key in ``keys[name]``, and for few others.

    A bit array of some 16 bits a key, and of ``most`` words at the most, that tasks get
    with the plan. It lets a join move only the rows that may have a partner: rows that
    fail it have none, the others are joined exactly. Null keys fail it.
    """
    words = 1 << 10
    n = keys.count()
    while words < most and 4 * words < n:
        words *= 4
    bits = words * 64

    def place(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(bits))

    filled = keys.where(F.col(name).isNotNull()).select(place(F.col(name)).alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")
    )
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word"))
    row = every.join(filled, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("e"))
    held = cut_lineage(row.agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["bits"]).alias("bits"))).scalar()

    def may_hold(key: Column) -> Column:
        at = place(key.cast(keys.schema[name].dataType))
        word = F.get(held, F.floor(at / 64).cast("int"))
        return F.coalesce(key.isNotNull() & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))) != 0), F.lit(False))

    return may_hold


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (one more than rows), without copying the texts."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(starts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]]
    return flat, starts - starts[0]


def totals(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``starts``; an empty stretch sums to zero."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return running[starts[1:]] - running[starts[:-1]]


def numbered(df: DataFrame, within: str, name: str) -> DataFrame:
    """Number the rows of ``df`` from 0 within each value of the integer column ``within``.

    Each task numbers its own rows per value; the counts of earlier tasks are then
    added. Only (task, value) counts are shuffled, so a value that holds most rows is
    no burden. The rows are written once in between, for a stable order.
    """
    schema = extended(df, f"_task int, `{name}` long")
    position = df.columns.index(within)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys = batch.column(position).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            values, first, sizes = np.unique(keys[order], return_index=True, return_counts=True)
            rank = np.arange(len(keys)) - np.repeat(first, sizes)
            rank += np.repeat([seen.get(v, 0) for v in values.tolist()], sizes).astype(np.int64)
            for v, n in zip(values.tolist(), sizes.tolist()):
                seen[v] = seen.get(v, 0) + n
            out = np.empty(len(keys), np.int64)
            out[order] = rank
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), task, np.int32)), pa.array(out)],
                names=[*batch.schema.names, "_task", name],
            )

    rows = cut_lineage(df.mapInArrow(count, schema))
    counts = rows.groupBy(within, "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.selectExpr(
        f"`{within}`", "_task",
        f"sum(_n) OVER (PARTITION BY `{within}` ORDER BY _task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before",
    )
    before = cut_lineage(before)
    return (
        rows.join(before, [within, "_task"], "left")
        .withColumn(name, F.col(name) + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_task", "_before")
    )
