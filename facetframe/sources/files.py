"""Reading source files, cleaning them up, and looking at the first rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import INDEX, quoted
from ..session import cut_lineage
from .csv_ranges import csv_records

# Texts that mean "missing" in a CSV cell.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_OVERFLOW = "__overflow"


def read_csv(
    spark: SparkSession, path: str, delimiter: str = ",", infer: bool = True, one_line_records: bool = False,
    split_quoted: bool = False, number: str | None = None,
) -> DataFrame:
    """CSV with a header. Rows with too many fields are skipped; short rows are padded with NULL.

    Quoted cells may hold line breaks, so by default a file is read by one task.
    ``one_line_records`` promises that no cell has a line break and lets files be
    split. ``split_quoted`` promises that quote characters stand around cells and
    doubled inside them only, and splits files whose cells do hold line breaks (see
    ``csv_ranges``); ``number`` then names a column with the place of a row in the
    files, which ``prepare_source`` takes as ``key``.

    The file is read with one column more than the header has; it is filled only
    in rows that are too long. ``infer`` turns columns whose values all read as
    whole numbers, numbers or truth values into those types, with one
    aggregation over the file.
    """
    options = {"sep": delimiter, "encoding": "UTF-8", "escape": '"', "multiLine": not one_line_records}
    names = spark.read.options(**options, header=True).csv(path).columns
    # A marker that no file holds keeps empty cells apart from absent ones.
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _OVERFLOW]])
    reading = {**options, "enforceSchema": True, "nullValue": "\u0001", "emptyValue": ""}
    kept = []
    if split_quoted:
        cells = F.from_csv("record", ", ".join(f"{quoted(f.name)} string" for f in text.fields), {k: str(v) for k, v in reading.items() if k != "enforceSchema"})
        place = number or "__number"
        rows = csv_records(spark, path).select(F.col("number").alias(place), cells.alias("__cells")).select(place, "__cells.*")
        kept = [F.col(quoted(number))] if number else []
    else:
        rows = spark.read.options(**reading, header=True).csv(path, schema=text)
    rows = rows.filter(F.col(_OVERFLOW).isNull()).drop(_OVERFLOW)
    rows = rows.select(*kept, *[
        F.when(~F.col(quoted(n)).isin(*MISSING), F.col(quoted(n))).alias(n) for n in names
    ])
    if not infer:
        return rows
    kinds = {"long": "bigint", "double": "double"}
    measures = []
    for i, n in enumerate(names):
        ref = F.col(quoted(n))
        measures.append(F.count(ref).alias(f"n{i}"))
        measures += [F.count(ref.try_cast(t)).alias(f"{k}{i}") for k, t in kinds.items()]
        measures.append(F.count_if(F.lower(ref).isin("true", "false")).alias(f"bool{i}"))
    found = rows.agg(*measures).first()
    typed = []
    for i, n in enumerate(names):
        ref, total = F.col(quoted(n)), found[f"n{i}"]
        target = next((t for k, t in {**kinds, "bool": "boolean"}.items() if total and found[f"{k}{i}"] == total), None)
        typed.append((ref.try_cast(target) if target else ref).alias(n))
    return rows.select(*kept, *typed)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def prepare_source(df: DataFrame, key: str | None = None) -> DataFrame:
    """Drop columns without a header name and number the rows."""
    blank = [c for c in df.columns if c.startswith("Unnamed: ") or re.fullmatch(r"_c\d+", c)]
    return with_row_index(df.drop(*blank), key)


def with_row_index(df: DataFrame, key: str | None = None) -> DataFrame:
    """Add the LONG row id ``__index``.

    With ``key`` (a unique integer column) the id is that column and costs
    nothing. Without one, rows are numbered 0..n-1 in file order: one narrow job
    counts the rows of each input partition, and each row gets its partition's
    offset plus its place in the partition. A frame with a shuffle below it might
    be laid out differently the second time, so it is stored first.
    """
    if key is not None:
        return df.withColumn(INDEX, F.col(quoted(key)).cast("long"))
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = cut_lineage(df)
    place = F.monotonically_increasing_id()
    numbered = df.withColumn("__place", place)
    partition = F.shiftrightunsigned(F.col("__place"), 33).cast("int")
    # Plan-only bookkeeping, one number per input partition, as zipWithIndex does.
    sizes = numbered.groupBy(partition.alias("p")).count().orderBy("p").collect()
    offsets, total = {}, 0
    for row in sizes:
        offsets[row["p"]] = total
        total += row["count"]
    frame = df.sparkSession.createDataFrame(
        list(offsets.items()) or [(0, 0)], "__partition INT, __offset LONG"
    )
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("__partition", partition)
        .join(frame, "__partition", "left")
        .withColumn(INDEX, F.col("__offset") + inside)
        .drop("__place", "__partition", "__offset")
    )


def preview(df: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` rows, each with the total row count next to it."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows")).scalar()
    return df.orderBy(INDEX).limit(n).withColumn("total_rows", total)


def to_records(df: DataFrame) -> DataFrame:
    """One JSON object per row; NaN and NULL both become ``null``."""
    values = []
    for field in df.schema.fields:
        value = F.col(quoted(field.name))
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        values.append(value.alias(field.name))
    return df.select(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("record"))
