"""Profiles of columns under a filter: counts, aggregates, distributions, places."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import ValidationError
from ..filters import Filter, filter_table, to_column
from ..functions.ranking import exact_quantiles
from ..schema import INDEX, TableSchema, quoted
from .fit import category_dimension
from .table import display_column, valid_rows

AGGREGATES = {
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "mean": F.avg,
    "std": F.stddev_samp,
    "max": F.max,
    "min": F.min,
}


def _method(name: str) -> str:
    if name != "median" and name not in AGGREGATES:
        raise ValidationError(f'"{name}" is not an aggregation method')
    return name


def frequency_distribution(
    df: DataFrame, schema: TableSchema, name: str, flt: Filter | None = None, topics: DataFrame | None = None
) -> DataFrame:
    """``category``, ``frequency`` in column order; True before False.

    Categories of the whole table that the filter empties appear with 0.
    """
    column = schema.get(name, S.CATEGORICAL_FAMILY)
    rows = valid_rows(filter_table(df, schema, flt), schema, name)
    ref = F.col(quoted(name))
    counts = rows.groupBy(ref.alias("category")).agg(F.count(F.lit(1)).alias("frequency"))
    if column.type in (S.CATEGORICAL, S.ORDERED):
        dimension = category_dimension(df, schema, name)
        counts = dimension.join(counts, "category", "left").select(
            "category", F.coalesce("frequency", F.lit(0)).alias("frequency")
        )
    key = column.sort_key(F.col("category"))
    counts = counts.orderBy(key.desc() if column.type == S.BOOLEAN else key.asc())
    if topics is not None or column.type == S.BOOLEAN:
        shown = display_column(counts.withColumnRenamed("category", name), schema, name, topics)
        return shown.withColumnRenamed(name, "category").select("category", "frequency")
    return counts


def aggregate_values(
    df: DataFrame, schema: TableSchema, name: str, grouped_by: str, method: str, flt: Filter | None = None,
    topics: DataFrame | None = None,
) -> DataFrame:
    """One aggregate of a continuous column per category: ``category``, ``value``.

    Groups without a value are left out, except that the sum of nothing is 0 and
    keeps the empty categories. Truth values read True and False; ``topics``
    (``id``, ``label``) puts labels in the place of topic ids.
    """
    schema.get(name, (S.CONTINUOUS,))
    by = schema.get(grouped_by, S.CATEGORICAL_FAMILY)
    rows = valid_rows(filter_table(df, schema, flt), schema, grouped_by).select(
        F.col(quoted(grouped_by)).alias("category"), F.col(quoted(name)).alias("value")
    )
    if _method(method) == "median":
        out = exact_quantiles(rows, ["category"], "value", {"value": 0.5})
    else:
        out = rows.groupBy("category").agg(AGGREGATES[method](F.col("value")).alias("value"))
    if method == "sum" and by.type in (S.CATEGORICAL, S.ORDERED):
        out = category_dimension(df, schema, grouped_by).join(out, "category", "left").select(
            "category", F.coalesce("value", F.lit(0.0)).alias("value")
        )
    out = out.filter(F.col("value").isNotNull()).orderBy(by.sort_key(F.col("category")))
    return _shown(out, schema, {"category": grouped_by}, topics)


def _shown(out: DataFrame, schema: TableSchema, columns: dict[str, str], topics: DataFrame | None) -> DataFrame:
    """Display values in the result columns (name -> source column) that hold topics or truth values."""
    names = out.columns
    for shown, source in columns.items():
        kind = schema.get(source).type
        if kind == S.BOOLEAN or (kind == S.TOPIC and topics is not None):
            out = display_column(out.withColumnRenamed(shown, source), schema, source, topics).withColumnRenamed(source, shown)
    return out.select(*names)


def paired_values(
    df: DataFrame, schema: TableSchema, column1: str, column2: str, flt: Filter | None = None,
    include_empty: bool = False, topics: DataFrame | None = None,
) -> DataFrame:
    """Joint counts of two columns: ``y`` (first), ``x`` (second), ``frequency``.

    Truth values read True and False; ``topics`` (``id``, ``label``) puts labels
    in the place of topic ids.

    ``include_empty`` adds the combinations of declared categories that never
    occur; both columns must then have resolved categories.
    """
    rows = valid_rows(valid_rows(filter_table(df, schema, flt), schema, column1), schema, column2)
    counts = rows.groupBy(F.col(quoted(column1)).alias("y"), F.col(quoted(column2)).alias("x")).agg(
        F.count(F.lit(1)).alias("frequency")
    )
    if include_empty:
        ys, xs = schema.get(column1).categories, schema.get(column2).categories
        if not ys or not xs:
            raise ValidationError("include_empty needs two columns with resolved categories")
        grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(y) for y in ys])).alias("y"))
        grid = grid.select("y", F.explode(F.array(*[F.lit(x) for x in xs])).alias("x"))
        counts = grid.join(counts, ["y", "x"], "left").select(
            "y", "x", F.coalesce("frequency", F.lit(0)).alias("frequency")
        )
    out = counts.orderBy(schema.get(column1).sort_key(F.col("y")), schema.get(column2).sort_key(F.col("x")))
    return _shown(out, schema, {"y": column1, "x": column2}, topics)


def column_counts(df: DataFrame, schema: TableSchema, name: str, flt: Filter | None = None) -> DataFrame:
    """Row counts around a filter, in one pass over the whole table."""
    column = schema.get(name)
    ref = F.col(quoted(name))
    inside = to_column(flt, schema)
    valid = ref.isNotNull()
    outlier = F.lit(None).cast("long")
    true = false = F.lit(None).cast("long")
    if column.type == S.TOPIC:
        valid = valid & (ref != -1)
        outlier = F.count_if(inside & (ref == -1))
    if column.type == S.BOOLEAN:
        true, false = F.count_if(inside & ref), F.count_if(inside & ~ref)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(inside).alias("inside"),
        F.count_if(~inside).alias("outside"),
        F.count_if(inside & valid).alias("valid"),
        F.count_if(inside & ~valid).alias("invalid"),
        outlier.alias("outlier"),
        true.alias("true"),
        false.alias("false"),
    )


def describe(rows: DataFrame, value: str) -> DataFrame:
    """Count, mean, spread, exact quartiles, the 1.5 IQR range and what lies outside it."""
    rows = rows.select(F.col(value).alias("v")).filter("v IS NOT NULL")
    quartiles = exact_quantiles(rows, [], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    bounds = quartiles.select(
        F.struct(
            "q1", "median", "q3",
            (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"),
            (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"),
        ).alias("q")
    ).scalar()
    ranged = rows.withColumn("q", bounds)
    return ranged.agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.max("q.median").alias("median"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("q.q1").alias("q1"),
        F.max("q.q3").alias("q3"),
        F.max("v").alias("max"),
        F.max("q.low").alias("inlier_low"),
        F.max("q.high").alias("inlier_high"),
        F.count_if((F.col("v") < F.col("q.low")) | (F.col("v") > F.col("q.high"))).alias("outlier_count"),
    )


def descriptive_statistics(df: DataFrame, schema: TableSchema, name: str, flt: Filter | None = None) -> DataFrame:
    schema.get(name, (S.CONTINUOUS,))
    return describe(filter_table(df, schema, flt).select(F.col(quoted(name)).alias("v")), "v")


def _places(df: DataFrame, schema: TableSchema, latitude: str, longitude: str, flt: Filter | None) -> DataFrame:
    for name, role in ((latitude, "latitude"), (longitude, "longitude")):
        if schema.get(name, (S.GEOSPATIAL,)).role != role:
            raise ValidationError(f'"{name}" does not hold {role} values')
    lat, lon = F.col(quoted(latitude)), F.col(quoted(longitude))
    rows = filter_table(df, schema, flt).filter(lat.isNotNull() & lon.isNotNull())
    return rows.withColumns({"latitude": lat, "longitude": lon})


def _first_label(schema: TableSchema, label: str) -> SparkColumn:
    """The first non-null label in row order."""
    schema.get(label, (S.UNIQUE, S.CATEGORICAL, S.ORDERED))
    ref = F.col(quoted(label))
    first = F.min_by(ref, F.when(ref.isNotNull(), F.col(INDEX)))
    return F.coalesce(first, F.lit("Unnamed Location")).alias("label")


def geo_points(
    df: DataFrame, schema: TableSchema, latitude: str, longitude: str, label: str | None = None,
    flt: Filter | None = None,
) -> DataFrame:
    """Rows per coordinate pair."""
    outputs = [F.count(F.lit(1)).cast("double").alias("value")]
    if label is not None:
        outputs.append(_first_label(schema, label))
    return _places(df, schema, latitude, longitude, flt).groupBy("latitude", "longitude").agg(*outputs)


def geo_aggregate(
    df: DataFrame, schema: TableSchema, latitude: str, longitude: str, name: str, method: str,
    label: str | None = None, flt: Filter | None = None,
) -> DataFrame:
    """An aggregate of a continuous column per coordinate pair; no value counts as 0."""
    schema.get(name, (S.CONTINUOUS,))
    keys = ["latitude", "longitude"]
    rows = _places(df, schema, latitude, longitude, flt)
    value = F.col(quoted(name))
    labels = [] if label is None else [_first_label(schema, label)]
    if _method(method) != "median":
        return rows.groupBy(*keys).agg(F.coalesce(AGGREGATES[method](value), F.lit(0.0)).alias("value"), *labels)
    medians = exact_quantiles(rows.withColumn("__value", value), keys, "__value", {"value": 0.5})
    places = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *labels).drop("size")
    return places.join(medians, keys, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
