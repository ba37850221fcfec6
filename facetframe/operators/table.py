"""Sorting, paging, and the valid rows of a column."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import EmptyDataError
from ..filters import Filter, filter_table
from ..schema import INDEX, Column, TableSchema, quoted


def sort_order(column: Column, ascending: bool) -> SparkColumn:
    """NULLs come last either way; ascending booleans start with True."""
    up = ascending != (column.type == S.BOOLEAN)
    key = column.sort_key()
    return key.asc_nulls_last() if up else key.desc_nulls_last()


def sort_table(df: DataFrame, schema: TableSchema, name: str | None, ascending: bool = True) -> DataFrame:
    """Sort by one column, ties by row id. An unknown column leaves the table as it is."""
    if name is None or name not in df.columns:
        return df
    order = [sort_order(schema.get(name), ascending)]
    if INDEX in df.columns:
        order.append(F.col(INDEX).asc())
    return df.orderBy(*order)


#: Rows up to which a page is a top-k of each task.
NEAR = 10_000
#: Rows of a sample of row positions, and ranges cut from it.
SAMPLE, RANGES = 2048, 64


def _before(order: list[tuple[SparkColumn, bool]], row) -> SparkColumn:
    """Whether a row comes before ``row``, the values of the keys of ``order``."""
    test = F.lit(False)
    for (key, up), value in reversed(list(zip(order, row))):
        test = (key < F.lit(value) if up else key > F.lit(value)) | ((key == F.lit(value)) & test)
    return test


def _row_at(rows: DataFrame, order: list[tuple[SparkColumn, bool]], place: int):
    """The keys of the row at ``place`` of the sorted table; None beyond its end.

    ``order`` are keys that are never NULL and together tell all rows apart, each with its
    direction. Ranges are cut at rows drawn by hash; one narrow pass counts the rows of
    each, and the range that holds the place is cut again, until it is small.
    """
    columns = [key.alias(f"k{i}") for i, (key, _) in enumerate(order)]
    names = [F.col(f"k{i}") for i in range(len(order))]
    named = [(name, up) for name, (_, up) in zip(names, order)]
    sorting = [name.asc() if up else name.desc() for name, up in named]
    keys = rows.select(*columns)
    while place >= NEAR:
        drawn = keys.orderBy(F.xxhash64(*names), *names).limit(SAMPLE).orderBy(*sorting).collect()
        step = max(1, len(drawn) // RANGES)
        bounds = drawn[step - 1 :: step] or [None]
        if bounds == [None]:
            return None
        # How many bounds a row is not before: the same on every evaluation.
        number = sum((F.when(_before(named, b), 0).otherwise(1) for b in bounds), F.lit(0))
        sizes = sorted(map(tuple, keys.groupBy(number.alias("r")).agg(F.count(F.lit(1))).collect()))
        for at, n in sizes:
            if place < n:
                break
            place -= n
        else:
            return None
        if at > 0:
            keys = keys.filter(~_before(named, bounds[at - 1]))
        if at < len(bounds):
            keys = keys.filter(_before(named, bounds[at]))
    return next(iter(keys.orderBy(*sorting).offset(place).limit(1).collect()), None)


def paginate(
    df: DataFrame, schema: TableSchema, flt: Filter | None = None, sort: tuple[str, bool] | None = None,
    page: int = 0, limit: int | None = 15,
) -> DataFrame:
    """One page of the filtered, sorted table; ``limit=None`` is the whole of it.

    Sort and slice together become a top-k per task, so a page near the start never
    sorts the table. A page beyond ``NEAR`` rows is found by position: the rows of
    ranges of the sort order are counted, and the range that holds its first row is cut
    again until it is small; the page is then a top-k from that row on. Ties go by row id
    in both ways.
    """
    rows = filter_table(df, schema, flt)
    named = sort is not None and sort[0] in rows.columns
    offset = page * (limit or 0)
    if limit is not None and offset + limit > NEAR and INDEX in rows.columns:
        order = [(F.col(INDEX), True)]
        if named:
            column = schema.get(sort[0])
            key = column.sort_key()
            missing = key.isNull()
            # A NULL stands behind all values, whatever the direction; among NULLs the row id decides.
            filler = rows.select(F.max(key)).first()[0]
            if filler is not None:
                order = [(missing, True), (F.coalesce(key, F.lit(filler)), sort[1] != (column.type == S.BOOLEAN)), *order]
        sorting = [key.asc() if up else key.desc() for key, up in order]
        # The first and the last row of the page are found by themselves; all between them is the page.
        first = _row_at(rows, order, offset)
        if first is None:
            return rows.limit(0)
        return rows.filter(~_before(order, first)).orderBy(*sorting).limit(limit)
    if named:
        rows = sort_table(rows, schema, *sort)
    elif INDEX in rows.columns:
        rows = rows.orderBy(INDEX)
    if limit is None:
        return rows
    return rows.offset(offset).limit(limit)


def page_meta(df: DataFrame, schema: TableSchema, flt: Filter | None = None, limit: int | None = 15) -> DataFrame:
    total = F.count(F.lit(1))
    pages = F.lit(1).cast("long") if limit is None else F.ceil(total / F.lit(limit)).cast("long")
    return filter_table(df, schema, flt).agg(total.alias("total"), pages.alias("pages"))


def is_valid(column: Column) -> SparkColumn:
    """Not NULL, and for topics not an outlier."""
    ref = F.col(quoted(column.name))
    return (ref.isNotNull() & (ref != -1)) if column.type == S.TOPIC else ref.isNotNull()


def valid_rows(df: DataFrame, schema: TableSchema, name: str, strict: bool = False) -> DataFrame:
    rows = df.filter(is_valid(schema.get(name)))
    if strict and rows.isEmpty():
        raise EmptyDataError(f'no row has a valid value in "{name}"')
    return rows


def unique_labels(topics: DataFrame) -> DataFrame:
    """``id`` and a label per topic; repeated labels get " (2)", " (3)" in topic order.

    A missing label falls back to the first three words, then to "Topic n".
    """
    label = F.nullif(F.col("label"), F.lit(""))
    if "words" in topics.columns:
        top = F.array_join(F.transform(F.slice("words", 1, 3), lambda w: w["word"]), ", ")
        label = F.coalesce(label, F.nullif(top, F.lit("")))
    label = F.coalesce(label, F.concat(F.lit("Topic "), (F.col("id") + 1).cast("string")))
    named = topics.select("id", label.alias("label"))
    nth = F.row_number().over(W.partitionBy("label").orderBy("id"))
    named = named.withColumn("nth", nth)
    suffix = F.when(F.col("nth") > 1, F.concat(F.lit(" ("), F.col("nth").cast("string"), F.lit(")"))).otherwise("")
    return named.select("id", F.concat("label", suffix).alias("label"))


def display_column(df: DataFrame, schema: TableSchema, name: str, topics: DataFrame | None = None) -> DataFrame:
    """Replace topic ids by labels and booleans by "True"/"False"."""
    column = schema.get(name)
    ref = F.col(quoted(name))
    if column.type == S.BOOLEAN:
        return df.withColumn(name, F.when(ref, "True").when(~ref, "False"))
    if column.type == S.TOPIC and topics is not None:
        labels = unique_labels(topics).select(F.col("id").alias("__id"), F.col("label").alias("__label"))
        joined = df.join(labels, ref == F.col("__id"), "left")
        return joined.withColumn(name, F.col("__label")).drop("__id", "__label")
    return df


def column_values(
    df: DataFrame, schema: TableSchema, name: str, flt: Filter | None = None, topics: DataFrame | None = None
) -> DataFrame:
    rows = valid_rows(filter_table(df, schema, flt), schema, name)
    index = [INDEX] if INDEX in rows.columns else []
    return display_column(rows.select(*index, quoted(name)), schema, name, topics)


def unique_values(df: DataFrame, schema: TableSchema, name: str, flt: Filter | None = None) -> DataFrame:
    rows = valid_rows(filter_table(df, schema, flt), schema, name)
    return rows.select(quoted(name)).distinct().orderBy(schema.get(name).sort_key())
