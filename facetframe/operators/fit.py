"""Fitting: from source columns to typed columns, with derived calendar columns."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import ValidationError
from ..schema import INDEX, Column, TableSchema, quoted

# Strptime directives and the matching datetime pattern letters.
_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "p": "a", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD",
    "z": "xx", "Z": "z", "%": "%",
}
_DAY = 86_400_000_000


def java_pattern(fmt: str) -> str:
    """A strptime format as a Spark datetime pattern."""
    out, i = [], 0
    while i < len(fmt):
        char = fmt[i]
        if char == "%" and i + 1 < len(fmt):
            i += 1
            if fmt[i] not in _DIRECTIVES:
                raise ValidationError(f"unsupported datetime directive %{fmt[i]}")
            out.append(_DIRECTIVES[fmt[i]])
        elif char.isalpha():
            out.append(f"'{char}'")
        elif char == "'":
            out.append("''")
        else:
            out.append(char)
        i += 1
    return "".join(out)


def fit_continuous(ref: SparkColumn, whole: bool = False) -> SparkColumn:
    """A double without NaN; ``whole`` numbers cannot be NaN and need no test."""
    number = ref.try_cast("double")
    if whole:
        return number
    return F.when(~F.isnan(number), number)


def fit_geospatial(ref: SparkColumn, role: str) -> SparkColumn:
    limit = 90.0 if role == "latitude" else 180.0
    number = ref.try_cast("double")
    return F.when(number.between(-limit, limit), number)


def fit_text(ref: SparkColumn) -> SparkColumn:
    return F.nullif(ref.cast("string"), F.lit(""))


def fit_temporal(ref: SparkColumn, fmt: str | None, is_time: bool) -> SparkColumn:
    if is_time:
        return ref.cast("timestamp")
    text = ref.cast("string")
    if fmt is None:
        return F.try_to_timestamp(text)
    return F.try_to_timestamp(text, F.lit(java_pattern(fmt)))


def nearest_day(instant: SparkColumn) -> SparkColumn:
    """Round to the nearest midnight, noon going to the even day number."""
    micros = F.unix_micros(instant)
    rest = F.pmod(micros, F.lit(_DAY))
    day = F.call_function("div", micros - rest, F.lit(_DAY))
    up = (rest > _DAY // 2) | ((rest == _DAY // 2) & (F.pmod(day, F.lit(2)) == 1))
    return F.timestamp_micros((day + up.cast("long")) * F.lit(_DAY))


def calendar_column(feature: str, instant: SparkColumn) -> SparkColumn:
    if feature == "year":
        return F.date_trunc("YEAR", instant)
    if feature == "month":
        return F.date_trunc("MONTH", instant)
    if feature == "date":
        return nearest_day(instant)
    if feature == "monthly":
        return F.get(F.array(*[F.lit(m) for m in S.MONTHS]), F.month(instant) - 1)
    if feature == "day_of_week":
        return F.get(F.array(*[F.lit(d) for d in S.DAYS_OF_WEEK]), F.dayofweek(instant) - 1)
    return F.date_format(instant, "HH:00")


def drop_rare(df: DataFrame, name: str, min_frequency: int) -> DataFrame:
    """NULL out categories seen fewer than ``min_frequency`` times.

    The counts are one row per category; the join back to the rows is a
    broadcast while that table is small and a skew-handled sort-merge beyond.
    """
    ref = F.col(quoted(name))
    kept = (
        df.filter(ref.isNotNull()).groupBy(ref.alias("__kept")).count()
        .filter(F.col("count") >= min_frequency).select("__kept")
    )
    joined = df.join(kept, df[quoted(name)] == kept["__kept"], "left")
    return joined.withColumn(name, F.col("__kept")).drop("__kept")


def resolve_category_order(df: DataFrame, name: str, order: tuple[str, ...] | None) -> tuple[str, ...]:
    """The final category order of one column.

    Values missing from the declared order come first, sorted; then the declared
    ones that occur. With no declared order, all values sorted. Runs one
    distinct; the order becomes part of the schema.
    """
    ref = F.col(quoted(name)).cast("string")
    rows = df.select(ref.alias("v")).filter("v IS NOT NULL").distinct().collect()
    present = {r["v"] for r in rows}
    declared = [c for c in (order or ()) if c in present]
    return tuple(sorted(present - set(declared)) + declared)


def resolve_categories(df: DataFrame, names: list[str]) -> dict[str, tuple[str, ...]]:
    """The sorted values of some plain categories, all in one pass; they become part of the schema."""
    if not names:
        return {}
    found = df.agg(*[F.sort_array(F.collect_set(F.col(quoted(n)).cast("string"))).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return {n: tuple(found[f"c{i}"]) for i, n in enumerate(names)}


def category_dimension(df: DataFrame, schema: TableSchema, name: str) -> DataFrame:
    """The categories of a column over the whole table, one per row, with positions."""
    column = schema.get(name)
    if column.categories and column.type != S.CATEGORICAL:
        pairs = [F.struct(F.lit(c).alias("category"), F.lit(i).alias("position")) for i, c in enumerate(column.categories)]
        return df.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    return (
        df.select(F.col(quoted(name)).alias("category")).filter("category IS NOT NULL").distinct()
        .withColumn("position", F.lit(None).cast("int"))
    )


def _fit_column(df: DataFrame, column: Column) -> SparkColumn:
    ref = F.col(quoted(column.name))
    data_type = df.schema[column.name].dataType.typeName()
    if column.type == S.CONTINUOUS:
        return fit_continuous(ref, data_type in ("byte", "short", "integer", "long"))
    if column.type == S.GEOSPATIAL:
        return fit_geospatial(ref, column.role)
    if column.type in (S.TEXTUAL, S.UNIQUE):
        return fit_text(ref)
    if column.type == S.TEMPORAL:
        return fit_temporal(ref, column.datetime_format, data_type.startswith(("timestamp", "date")))
    if column.type == S.BOOLEAN:
        return ref.cast("boolean")
    if column.type == S.TOPIC:
        return ref.cast("int")
    return ref.cast("string")


def fit(df: DataFrame, schema: TableSchema) -> tuple[DataFrame, TableSchema]:
    """Project to the declared columns, type them, add the derived ones.

    One select for everything, plus one count per column with a rare-value limit,
    one distinct per ordered category whose order is not resolved yet, and one pass
    for the values of all plain categories that do not come with them.
    """
    declared = [c for c in schema.columns if not c.internal]
    missing = [c.name for c in declared if c.name not in df.columns]
    if missing:
        raise ValidationError(f"the dataset lacks the declared columns {missing}")
    fitted = [c for c in schema.columns if c.internal and c.name in df.columns]

    index = [F.col(INDEX)] if INDEX in df.columns else []
    values = [_fit_column(df, c).alias(c.name) for c in declared]
    carried = [F.col(quoted(c.name)).cast("int" if c.type == S.TOPIC else "string").alias(c.name)
               for c in fitted if c.type in (S.TOPIC, S.UNIQUE)]
    out = df.select(*index, *values, *carried)

    for column in declared:
        if column.type in (S.CATEGORICAL, S.ORDERED) and column.min_frequency > 0:
            out = drop_rare(out, column.name, column.min_frequency)

    features = {}
    for column in declared:
        if column.type == S.TEMPORAL:
            for feature in column.temporal_features:
                name = f"{column.name} ({S.TEMPORAL_FEATURES[feature]})"
                features[name] = calendar_column(feature, F.col(quoted(column.name)))
    if features:
        out = out.withColumns(features)

    full = schema.with_derived()
    for column in declared:
        if column.type == S.ORDERED and column.categories is None:
            order = resolve_category_order(out, column.name, column.category_order)
            full = full.resolved(column.name, order)
    plain = [c.name for c in declared if c.type == S.CATEGORICAL and c.categories is None]
    for name, values in resolve_categories(out, plain).items():
        full = full.resolved(name, values)
    return project_schema(out, full), full


def project_schema(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Only the schema's columns, in schema order, with ``__index`` in front if present."""
    kept = [INDEX] if INDEX in df.columns else []
    kept += [c.name for c in schema.columns if c.name in df.columns]
    return df.select(*[quoted(c) for c in kept])


def refit(
    previous: TableSchema, new: TableSchema, workspace: DataFrame, source: DataFrame
) -> tuple[DataFrame, TableSchema]:
    """Fit only what changed since ``workspace`` was fitted with ``previous``.

    When the set of columns changed, everything is fitted again. Otherwise the
    changed columns are taken from ``source`` (joined by row id) and fitted, and
    the others keep their values and their derived columns.
    """
    old = {c.name: c for c in previous.columns if not c.internal}
    declared = [c for c in new.columns if not c.internal]
    if set(old) != {c.name for c in declared}:
        return fit(source, new)
    changed = [c for c in declared if _declaration(c) != _declaration(old[c.name])]
    if not changed:
        return project_schema(workspace, previous.with_derived()), previous.with_derived()
    names = {c.name for c in changed}
    stale = names | {d.name for c in changed for d in old[c.name].derived()}
    kept = workspace.drop(*stale)
    fresh, fresh_schema = fit(source.select(INDEX, *[quoted(n) for n in names]), TableSchema(tuple(changed)))
    merged = kept.join(fresh, INDEX, "left")
    columns = []
    for c in declared:
        if c.name in names:
            columns += [f for f in fresh_schema.columns if f.name == c.name or f.source_name == c.name]
        else:
            columns += [p for p in previous.columns if p.name == c.name or p.source_name == c.name]
    schema = TableSchema(tuple(columns)).with_derived()
    return project_schema(merged, schema), schema


def _declaration(column: Column) -> tuple:
    return (
        column.type, column.min_frequency, column.category_order, column.datetime_format,
        column.temporal_features, column.role,
    )
