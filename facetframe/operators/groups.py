"""Overlapping groups of rows, reduced to a pattern table in one pass.

A *pattern* says which of the groups a row belongs to. Counting rows per pattern
(a partial aggregation; there are few patterns) gives group sizes, overlaps,
co-occurrence and contingency counts without any join and without reading the
table once per group. Everything after that runs on the pattern table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import ValidationError
from ..filters import Filter, to_column
from ..schema import TableSchema, quoted
from .fit import category_dimension
from .table import is_valid

_BITS = 62


@dataclass(frozen=True)
class Group:
    name: str
    filter: Filter | None


def named(groups) -> list[Group]:
    """Accept ``Group`` objects or ``{"name", "filter"}`` dictionaries."""
    out = [g if isinstance(g, Group) else Group(g["name"], g["filter"]) for g in groups]
    if len({g.name for g in out}) != len(out):
        raise ValidationError("group names must be unique")
    return out


class Patterns:
    """How membership in ``groups`` is packed into one column.

    Up to 62 groups share a LONG; more are written as a string of 0 and 1.
    """

    def __init__(self, groups, schema: TableSchema):
        self.groups = named(groups)
        if not self.groups:
            raise ValidationError("at least one group is required")
        self.masks = [to_column(g.filter, schema) for g in self.groups]
        self.packed = len(self.groups) <= _BITS

    def __len__(self) -> int:
        return len(self.groups)

    def expression(self) -> SparkColumn:
        if self.packed:
            total = F.lit(0).cast("long")
            for i, mask in enumerate(self.masks):
                total = total + F.when(mask, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
            return total
        return F.concat(*[F.when(m, "1").otherwise("0") for m in self.masks])

    def has(self, group: SparkColumn | int, pattern: str = "pattern") -> SparkColumn:
        """Is the (zero-based) group in the pattern?"""
        group = F.lit(group) if isinstance(group, int) else group
        if self.packed:
            return F.getbit(F.col(pattern), group.cast("int")) == 1
        return F.substr(F.col(pattern), group.cast("int") + 1, F.lit(1)) == "1"

    def size(self, pattern: str = "pattern") -> SparkColumn:
        """How many groups the pattern names."""
        if self.packed:
            return F.bit_count(pattern)
        return F.length(F.replace(F.col(pattern), F.lit("0"), F.lit("")))

    def each_group(self) -> SparkColumn:
        """One row per group, when selected: ``gid``, ``group``."""
        return F.inline(
            F.array(*[F.struct(F.lit(i).alias("gid"), F.lit(g.name).alias("group")) for i, g in enumerate(self.groups)])
        )

    def each_pair(self, ordered: bool = False) -> SparkColumn:
        """One row per pair of groups, when selected: ``g1``, ``g2``, ``group1``, ``group2``.

        ``ordered`` adds the reversed pairs and each group with itself.
        """
        k = len(self.groups)
        pairs = [(i, j) for i in range(k) for j in range(k) if ordered or i < j]
        return F.inline(
            F.array(*[
                F.struct(
                    F.lit(i).alias("g1"), F.lit(j).alias("g2"),
                    F.lit(self.groups[i].name).alias("group1"), F.lit(self.groups[j].name).alias("group2"),
                )
                for i, j in pairs
            ])
        )


def pattern_counts(df: DataFrame, patterns: Patterns, **keys: SparkColumn) -> DataFrame:
    """Rows per pattern and extra key: ``pattern``, the keys, ``n``."""
    extra = [c.alias(name) for name, c in keys.items()]
    return df.groupBy(patterns.expression().alias("pattern"), *extra).agg(F.count(F.lit(1)).alias("n"))


def _total(condition: SparkColumn) -> SparkColumn:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def extract_groups(
    df: DataFrame, schema: TableSchema, groups, name: str, exclude_overlapping: bool = False
) -> DataFrame:
    """The non-null values of each group in long form; shared rows appear once per group."""
    patterns = Patterns(groups, schema)
    rows = df.filter(F.col(quoted(name)).isNotNull()).select(
        patterns.expression().alias("pattern"), F.col(quoted(name)).alias("value")
    )
    if exclude_overlapping:
        rows = rows.filter(patterns.size() <= 1)
    long = rows.select("pattern", "value", patterns.each_group())
    return long.filter(patterns.has(F.col("gid"))).select("gid", "group", "value")


def group_info(
    df: DataFrame, schema: TableSchema, groups, name: str, exclude_overlapping: bool = False
) -> DataFrame:
    """Per group: ``empty_count``, ``valid_count``, ``overlap_count``, ``total_count`` (of the table)."""
    patterns = Patterns(groups, schema)
    table = pattern_counts(df, patterns, present=F.col(quoted(name)).isNotNull())
    table = table.withColumn("total", table.agg(F.sum("n").alias("t")).scalar())
    table = table.select("*", patterns.each_group())
    inside = patterns.has(F.col("gid"))
    present = F.col("present")
    overlapping = inside & present & (patterns.size() > 1)
    valid = inside & present & ((patterns.size() == 1) if exclude_overlapping else F.lit(True))
    return table.groupBy("gid", "group").agg(
        _total(inside & ~present).alias("empty_count"),
        _total(valid).alias("valid_count"),
        _total(overlapping).alias("overlap_count"),
        F.max("total").alias("total_count"),
    )


def overlaps(df: DataFrame, schema: TableSchema, groups, name: str) -> DataFrame:
    """Rows shared by each pair of groups, after NULLs are left out."""
    patterns = Patterns(groups, schema)
    table = pattern_counts(df.filter(F.col(quoted(name)).isNotNull()), patterns)
    table = table.select("*", patterns.each_pair())
    shared = patterns.has(F.col("g1")) & patterns.has(F.col("g2"))
    return table.groupBy("group1", "group2").agg(_total(shared).alias("overlap_count"))


def group_warnings(
    df: DataFrame, schema: TableSchema, groups, name: str, exclude_overlapping: bool = False
) -> DataFrame:
    """``group``, ``level`` (error or warning), ``message`` for empty, small and overlapping groups."""
    info = group_info(df, schema, groups, name, exclude_overlapping)
    count = F.col("valid_count")
    small = info.filter(count <= 10).select(
        "group",
        F.when(count == 0, "error").otherwise("warning").alias("level"),
        F.when(count == 0, F.concat(F.lit('"'), F.col("group"), F.lit('" has no valid rows')))
        .otherwise(F.concat(F.lit('"'), F.col("group"), F.lit('" has only '), count.cast("string"), F.lit(" rows")))
        .alias("message"),
    )
    if len(groups) < 2:
        return small
    shared = overlaps(df, schema, groups, name).filter("overlap_count > 0").select(
        F.col("group1").alias("group"),
        F.lit("warning").alias("level"),
        F.concat(
            F.col("overlap_count").cast("string"), F.lit(' rows are in both "'), F.col("group1"),
            F.lit('" and "'), F.col("group2"), F.lit('"'),
        ).alias("message"),
    )
    return small.unionByName(shared)


def cooccurrence(df: DataFrame, schema: TableSchema, groups) -> DataFrame:
    """For every ordered pair of groups: shared rows, the sizes, and the phi correlation."""
    patterns = Patterns(groups, schema)
    table = pattern_counts(df, patterns).select("*", patterns.each_pair(ordered=True))
    a, b = patterns.has(F.col("g1")), patterns.has(F.col("g2"))
    counts = table.groupBy("group1", "group2").agg(
        F.sum("n").alias("total"),
        _total(a).alias("frequency1"),
        _total(b).alias("frequency2"),
        _total(a & b).alias("cooccurrence"),
    )
    n, x, y = (F.col(c).cast("double") for c in ("total", "frequency1", "frequency2"))
    phi = F.try_divide(n * F.col("cooccurrence") - x * y, F.sqrt(x * (n - x)) * F.sqrt(y * (n - y)))
    return counts.select("group1", "group2", "frequency1", "frequency2", "cooccurrence", phi.alias("correlation"))


def value_counts(
    df: DataFrame, schema: TableSchema, patterns: Patterns, name: str, exclude_overlapping: bool = False
) -> DataFrame:
    """``gid``, ``group``, ``value``, ``observed`` over every group and every value that occurs in some group."""
    column = schema.get(name)
    table = pattern_counts(df.filter(is_valid(column)), patterns, value=F.col(quoted(name)))
    if exclude_overlapping:
        table = table.filter(patterns.size() <= 1)
    table = table.filter(patterns.size() > 0).select("*", patterns.each_group())
    return table.groupBy("gid", "group", "value").agg(_total(patterns.has(F.col("gid"))).alias("observed"))


def contingency_table(
    df: DataFrame, schema: TableSchema, groups, name: str, exclude_overlapping: bool = False
) -> DataFrame:
    """Observed and expected counts with residuals, per group and category.

    Declared categories without a row in any group have a zero count; their
    standardised residual is undefined and therefore NULL.
    """
    column = schema.get(name, S.CATEGORICAL_FAMILY)
    patterns = Patterns(groups, schema)
    counts = value_counts(df, schema, patterns, name, exclude_overlapping)
    if column.type in (S.CATEGORICAL, S.ORDERED):
        grid = category_dimension(df, schema, name).select(F.col("category").alias("value"), patterns.each_group())
        counts = grid.join(counts, ["gid", "group", "value"], "left").withColumn(
            "observed", F.coalesce("observed", F.lit(0))
        )
    rows = counts.groupBy("gid").agg(F.sum("observed").alias("row_total"))
    columns = counts.groupBy("value").agg(F.sum("observed").alias("column_total"))
    total = counts.agg(F.sum("observed").cast("double").alias("t")).scalar()
    joined = counts.join(rows, "gid").join(columns, "value").withColumn("total", total)
    expected = F.try_divide(F.col("row_total") * F.col("column_total"), F.col("total"))
    joined = joined.withColumn("expected", expected).withColumn("residual", F.col("observed") - F.col("expected"))
    return joined.select(
        "group", "value", "observed", "expected", "residual",
        F.try_divide("residual", F.sqrt("expected")).alias("standardized_residual"),
    )


def is_mutually_exclusive(df: DataFrame, schema: TableSchema, groups) -> DataFrame:
    """One row: is every row in exactly one group?"""
    patterns = Patterns(groups, schema)
    table = pattern_counts(df, patterns)
    return table.agg((_total(patterns.size() != 1) == 0).alias("mutually_exclusive"))
