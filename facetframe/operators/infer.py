"""Guessing column types from data, and profiling a column under a given type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..errors import ValidationError
from ..schema import quoted
from .profile import describe

_NUMERIC = (T.NumericType, T.BooleanType)


def infer_schema(df: DataFrame) -> DataFrame:
    """A suggested type per column: ``name``, ``type``, ``count``.

    A single aggregation over all columns. Distinct values of text columns are
    counted by digest, so that whole documents are not shuffled.
    """
    measures, described = [], []
    for i, field in enumerate(df.schema.fields):
        ref = F.col(quoted(field.name))
        numeric = isinstance(field.dataType, _NUMERIC)
        is_text = isinstance(field.dataType, T.StringType)
        measures.append(F.count(ref).alias(f"n{i}"))
        if not numeric:
            measures.append(F.count_distinct(F.md5(ref) if is_text else ref).alias(f"d{i}"))
            measures.append(F.max(ref.isNull()).cast("int").alias(f"e{i}"))
            measures.append((F.avg(F.length(ref)) if is_text else F.lit(0.0)).alias(f"l{i}"))
        if numeric:
            place = field.name.lower().startswith(("lat", "long"))
            guess = F.lit(S.GEOSPATIAL if place else S.CONTINUOUS)
        else:
            few = (F.col(f"d{i}") + F.col(f"e{i}")) < F.lit(0.1) * F.col(f"n{i}")
            guess = F.when(few, S.CATEGORICAL).when(F.col(f"l{i}") >= 20, S.TEXTUAL).otherwise(S.UNIQUE)
        guess = F.when(F.col(f"n{i}") == 0, S.UNIQUE).otherwise(guess)
        described.append(
            F.struct(F.lit(field.name).alias("name"), guess.alias("type"), F.col(f"n{i}").alias("count"))
        )
    return df.agg(*measures).select(F.inline(F.array(*described)))


def profile_column(df: DataFrame, name: str, type: str) -> DataFrame:
    """What a column looks like when read as ``type``.

    Texts are described by length, numbers by value; ordered categories list
    their sorted values; every other type reports the non-null count.
    """
    if name not in df.columns:
        raise ValidationError(f'column "{name}" does not exist')
    ref = F.col(quoted(name))
    if type == S.TEXTUAL:
        return describe(df.select(F.length(ref.cast("string")).cast("double").alias("value")), "value")
    if type == S.CONTINUOUS:
        return describe(df.select(ref.cast("double").alias("value")), "value")
    if type == S.ORDERED:
        counted = df.filter(ref.isNotNull()).groupBy(ref.cast("string").alias("category"))
        return counted.agg(F.count(F.lit(1)).alias("count")).orderBy("category")
    return df.agg(F.count(ref).alias("count"))
