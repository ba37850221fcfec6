"""Statistical tests and effect sizes between groups.

Every test is computed from sufficient statistics that one aggregation delivers:
moments per pattern, counts per pattern and value, or rank sums. The formulas
then run as column arithmetic on a frame with one row per comparison, and only
that frame meets the distribution functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..errors import ValidationError
from ..functions import distributions as D
from ..functions.ranking import exact_quantiles, rank_sums
from ..schema import TableSchema, quoted
from .groups import Patterns, pattern_counts, value_counts
from .table import is_valid

TESTS = {
    "t": (S.CONTINUOUS,),
    "mann_whitney_u": (S.ORDERED, S.TEMPORAL, S.CONTINUOUS),
    "chi_squared": (S.ORDERED, S.CATEGORICAL, S.TOPIC),
}
OMNIBUS_TESTS = {
    "anova": (S.CONTINUOUS,),
    "kruskal_wallis": (S.TEMPORAL, S.CONTINUOUS, S.ORDERED),
    "chi_squared": (S.ORDERED, S.CATEGORICAL, S.TOPIC),
}
EFFECTS = {
    "mean_difference": (S.CONTINUOUS,),
    "median_difference": (S.CONTINUOUS,),
    "cohen_d": (S.CONTINUOUS,),
    "point_biserial": (S.CONTINUOUS,),
    "rank_biserial": (S.ORDERED, S.TEMPORAL, S.CONTINUOUS),
    "cramer_v": (S.ORDERED, S.CATEGORICAL, S.TOPIC),
}
OMNIBUS_EFFECTS = {"anova": "eta_squared", "kruskal_wallis": "epsilon_squared", "chi_squared": "cramer_v"}


def _ratio(a: SparkColumn, b: SparkColumn) -> SparkColumn:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


class Comparisons:
    """A list of (side A, side B) comparisons over the patterns of some groups.

    ``kind`` is ``pairs`` (all two-group combinations) or ``rest`` (each group
    against its complement). Overlap is judged inside each comparison.
    """

    def __init__(self, groups, schema: TableSchema, kind: str = "pairs", exclude_overlapping: bool = False):
        self.patterns = Patterns(groups, schema)
        self.kind, self.exclude = kind, exclude_overlapping
        k = len(self.patterns)
        names = [g.name for g in self.patterns.groups]
        if kind == "rest":
            self.items = [(i, None, names[i], f"NOT {names[i]}") for i in range(k)]
        else:
            if k < 2:
                raise ValidationError("at least two groups are required")
            self.items = [(i, j, names[i], names[j]) for i in range(k) for j in range(i + 1, k)]

    def sides(self, i: int, j: int | None) -> tuple[SparkColumn, SparkColumn]:
        """Membership of the two sides, as predicates on ``pattern``."""
        a = self.patterns.has(i)
        if j is None:
            return a, ~a
        b = self.patterns.has(j)
        return (a & ~b, b & ~a) if self.exclude else (a, b)

    def explode(self) -> SparkColumn:
        """One row per comparison, when selected: ``cid``, ``g1``, ``g2`` (-1 = the rest), names."""
        return F.inline(
            F.array(*[
                F.struct(
                    F.lit(c).alias("cid"), F.lit(i).alias("g1"), F.lit(-1 if j is None else j).alias("g2"),
                    F.lit(a).alias("group1"), F.lit(b).alias("group2"),
                )
                for c, (i, j, a, b) in enumerate(self.items)
            ])
        )

    def exploded_sides(self) -> tuple[SparkColumn, SparkColumn]:
        """The two sides as predicates on an exploded frame."""
        a = self.patterns.has(F.col("g1"))
        other = self.patterns.has(F.greatest(F.col("g2"), F.lit(0)))
        rest = F.col("g2") < 0
        b = F.when(rest, ~a).otherwise(other)
        if not self.exclude:
            return a, b
        return F.when(rest, a).otherwise(a & ~other), F.when(rest, ~a).otherwise(other & ~a)


def moments(df: DataFrame, patterns: Patterns, value: SparkColumn) -> DataFrame:
    """Per pattern: ``n``, ``mean``, ``m2`` (sum of squared deviations). One scan, one tiny shuffle."""
    rows = df.select(patterns.expression().alias("pattern"), value.cast("double").alias("v")).filter("v IS NOT NULL")
    return rows.groupBy("pattern").agg(
        F.count("v").cast("double").alias("n"),
        F.avg("v").alias("mean"),
        (F.coalesce(F.var_pop("v"), F.lit(0.0)) * F.count("v")).alias("m2"),
    )


def _grand_mean(table: DataFrame) -> SparkColumn:
    """The mean over all patterns, as a scalar subquery."""
    return table.agg(_ratio(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("center")).scalar()


def _merge(side: SparkColumn, center: SparkColumn) -> tuple[SparkColumn, SparkColumn, SparkColumn]:
    """n, mean and m2 of the patterns on one side, taken around ``center`` for accuracy."""
    pick = lambda e: F.coalesce(F.sum(F.when(side, e)), F.lit(0.0))
    n = pick(F.col("n"))
    shift = pick(F.col("n") * (F.col("mean") - center))
    square = pick(F.col("m2") + F.col("n") * (F.col("mean") - center) * (F.col("mean") - center))
    return n, F.max(center) + _ratio(shift, n), square - _ratio(shift * shift, n)


def two_sample_moments(df: DataFrame, comparisons: Comparisons, value: SparkColumn) -> DataFrame:
    """``cid``, names and ``n1 mean1 var1 n2 mean2 var2`` per comparison."""
    table = moments(df, comparisons.patterns, value)
    table = table.withColumn("center", _grand_mean(table)).select("*", comparisons.explode())
    a, b = comparisons.exploded_sides()
    n1, mean1, m21 = _merge(a, F.col("center"))
    n2, mean2, m22 = _merge(b, F.col("center"))
    out = table.groupBy("cid", "group1", "group2").agg(
        n1.alias("n1"), mean1.alias("mean1"), m21.alias("m21"),
        n2.alias("n2"), mean2.alias("mean2"), m22.alias("m22"),
    )
    var = lambda m2, n: F.when(F.col(n) > 1, F.col(m2) / (F.col(n) - 1))
    return out.withColumns({"var1": var("m21", "n1"), "var2": var("m22", "n2")})


def _t(df, schema, comparisons, column):
    """Student's t with pooled variance."""
    frame = two_sample_moments(df, comparisons, F.col(quoted(column.name)))
    dof = F.col("n1") + F.col("n2") - 2
    pooled = _ratio(F.col("m21") + F.col("m22"), dof)
    scale = F.sqrt(pooled * (_ratio(F.lit(1.0), F.col("n1")) + _ratio(F.lit(1.0), F.col("n2"))))
    t = _ratio(F.col("mean1") - F.col("mean2"), scale)
    return frame.select("cid", "group1", "group2", "n1", "n2", t.alias("statistic"), dof.alias("dof"))


def two_sample_ranks(df: DataFrame, comparisons: Comparisons, column) -> DataFrame:
    """``n1 n2 u ties`` per comparison; ``u`` counts side A above side B, ties half."""
    rows = df.select(
        comparisons.patterns.expression().alias("pattern"), column.numeric_key().alias("value")
    ).filter("value IS NOT NULL")
    cells, pairs = {}, []
    for c, (i, j, _, _) in enumerate(comparisons.items):
        a, b = comparisons.sides(i, j)
        shared = j is not None and not comparisons.exclude
        ka, kb = (f"g{i}", f"g{j}") if shared else (f"a{c}", f"b{c}")
        cells[ka], cells[kb] = a, b
        pairs.append((ka, kb))
    used = None
    for condition in cells.values():
        used = condition if used is None else (used | condition)
    wide = rank_sums(rows.filter(used), "value", cells, pairs, pooled=False)
    structs = [
        F.struct(
            F.lit(c).alias("cid"), F.lit(item[2]).alias("group1"), F.lit(item[3]).alias("group2"),
            F.col(f"n_{a}").alias("n1"), F.col(f"n_{b}").alias("n2"),
            F.col(f"u_{a}_{b}").alias("u"), F.col(f"tie_{a}_{b}").alias("ties"),
        )
        for c, (item, (a, b)) in enumerate(zip(comparisons.items, pairs))
    ]
    return wide.select(F.inline(F.array(*structs)))


def _partition_numerator(parts: int) -> list[int]:
    """N(q) with N / (1 - q^L)^(parts + 1) = 1 / ((1 - q) (1 - q) (1 - q^2) .. (1 - q^parts)), L = lcm(1..parts)."""
    period = math.lcm(*range(1, parts + 1))
    series = [1]
    for i in (1, *range(1, parts + 1)):
        # Times (1 - q^L) / (1 - q^i) = 1 + q^i + .. + q^(L - i), as running sums over windows of L.
        wide = series + [0] * (period - i)
        sums = list(wide)
        for k in range(i, len(sums)):
            sums[k] += sums[k - i]
        series = [s - (sums[k - period] if k >= period else 0) for k, s in enumerate(sums)]
    return series


def exact_u_two_sided(u: float, n1: int, n2: int) -> float:
    """Two-sided p of the exact distribution of U without ties, in exact integers.

    The number of arrangements with U at most k is a coefficient sum of the Gaussian
    binomial: its numerator has 2^n1 terms at most, and each needs the number of
    partitions into parts of at most n1, a quasi-polynomial. The work depends on the
    smaller group only.
    """
    n1, n2 = sorted((int(n1), int(n2)))
    top = n1 * n2
    numerator, period = _partition_numerator(n1), math.lcm(*range(1, n1 + 1))

    def partitions(m: int) -> int:
        """Partitions of 0..m into parts of at most n1."""
        return sum(numerator[j] * math.comb((m - j) // period + n1, n1) for j in range(m % period, min(m, len(numerator) - 1) + 1, period))

    terms = {0: 1}
    for i in range(1, n1 + 1):
        for exponent, sign in list(terms.items()):
            terms[exponent + n2 + i] = terms.get(exponent + n2 + i, 0) - sign
    least = math.floor(min(u, top - u))
    below = sum(sign * partitions(least - exponent) for exponent, sign in terms.items() if exponent <= least)
    return min(1.0, 2 * below / math.comb(n1 + n2, n1))


@F.pandas_udf(T.DoubleType())
def _u_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    out = []
    for s, a, b, t in zip(u, n1, n2, ties):
        if s is None or s != s or not a or not b:
            out.append(None)
            continue
        if min(a, b) <= 8 and t == 0:
            out.append(exact_u_two_sided(s, a, b))
            continue
        n = a + b
        spread = math.sqrt(a * b / 12.0 * ((n + 1) - t / (n * (n - 1)))) if n > 1 else 0.0
        if spread == 0.0:
            out.append(1.0)
            continue
        z = (max(s, a * b - s) - a * b / 2.0 - 0.5) / spread
        out.append(min(1.0, math.erfc(z / math.sqrt(2.0))))
    return pd.Series(out, dtype="float64")


def cell_counts(df: DataFrame, comparisons: Comparisons, column) -> DataFrame:
    """``cid group1 group2 value o1 o2``: counts per value on both sides, absent values left out."""
    table = pattern_counts(df.filter(is_valid(column)), comparisons.patterns, value=F.col(quoted(column.name)))
    table = table.select("*", comparisons.explode())
    a, b = comparisons.exploded_sides()
    pick = lambda side: F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)).cast("double")
    out = table.groupBy("cid", "group1", "group2", "value").agg(pick(a).alias("o1"), pick(b).alias("o2"))
    return out.filter("o1 + o2 > 0")


def chi_squared_of(cells: DataFrame, keys: list[str], rows: int, observed: list[str]) -> DataFrame:
    """Chi-squared of one table per key; a table has ``rows`` groups in the columns ``observed``.

    Adds 0.5 to every cell of a table with an empty cell, corrects 2x2 tables for
    continuity, and also returns Cramer's V with its bias correction and the
    share of sparse cells in the raw table.
    """
    zero = sum((F.count_if(F.col(o) == 0) for o in observed), F.lit(0))
    sparse = sum((F.count_if(F.col(o) < 5) for o in observed), F.lit(0))
    totals = [F.sum(o).alias(f"t_{o}") for o in observed]
    raw = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("width"), zero.alias("zeros"), sparse.alias("sparse"), *totals
    )
    add = F.when(F.col("zeros") > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    joined = cells.join(raw, keys)
    grand = sum((F.col(f"t_{o}") + add * F.col("width") for o in observed), F.lit(0.0))
    joined = joined.withColumn("grand", grand)
    column_total = sum((F.col(o) + add for o in observed), F.lit(0.0))
    yates = (F.col("width") == 2) & F.lit(rows == 2)
    parts = []
    for o in observed:
        expected = (F.col(f"t_{o}") + add * F.col("width")) * _ratio(column_total, F.col("grand"))
        gap = F.abs(F.col(o) + add - expected)
        gap = F.when(yates, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        parts.append(F.when(expected > 0, gap * gap / expected))
    cell = sum(parts, F.lit(0.0))
    out = joined.groupBy(*keys).agg(
        F.sum(cell).alias("statistic"),
        F.max("grand").alias("grand"),
        F.max("width").alias("width"),
        (F.max("sparse") / (F.max("width") * rows)).alias("sparse_share"),
        *[F.max(f"t_{o}").alias(f"t_{o}") for o in observed],
    )
    dof = (F.col("width") - 1) * (rows - 1)
    n, r, k = F.col("grand"), F.col("width"), F.lit(float(rows))
    phi2 = F.greatest(F.lit(0.0), _ratio(F.col("statistic"), n) - _ratio((k - 1) * (r - 1), n - 1))
    k2 = k - _ratio((k - 1) * (k - 1), n - 1)
    r2 = r - _ratio((r - 1) * (r - 1), n - 1)
    smaller = F.least(k2 - 1, r2 - 1)
    v = F.when(smaller > 0, F.sqrt(_ratio(phi2, smaller)))
    return out.withColumns({"dof": dof, "cramer_v": v})


def _chi(df, schema, comparisons, column):
    cells = cell_counts(df, comparisons, column)
    out = chi_squared_of(cells, ["cid", "group1", "group2"], 2, ["o1", "o2"])
    return out.select(
        "cid", "group1", "group2", F.col("t_o1").alias("n1"), F.col("t_o2").alias("n2"),
        "statistic", "dof", "sparse_share", "cramer_v",
    )


def test_statistics(df: DataFrame, schema: TableSchema, comparisons: Comparisons, name: str, test: str) -> DataFrame:
    """``cid group1 group2 n1 n2 statistic`` and what the p-value needs, per comparison."""
    if test not in TESTS:
        raise ValidationError(f'"{test}" is not a two-group test')
    column = schema.get(name, TESTS[test])
    if test == "t":
        return _t(df, schema, comparisons, column)
    if test == "mann_whitney_u":
        return two_sample_ranks(df, comparisons, column).withColumnRenamed("u", "statistic")
    return _chi(df, schema, comparisons, column)


def with_p_value(stats: DataFrame, test: str) -> DataFrame:
    if test == "t":
        p = D.t_p(F.col("statistic"), F.col("dof"))
    elif test == "mann_whitney_u":
        p = _u_p("statistic", "n1", "n2", "ties")
    elif test == "anova":
        p = D.f_p(F.col("statistic"), F.col("dof1"), F.col("dof2"))
    else:
        p = D.chi2_p(F.col("statistic"), F.col("dof"))
    return stats.withColumn("p_value", p)


def effect_sizes(
    df: DataFrame, schema: TableSchema, comparisons: Comparisons, name: str, effect: str, formula: str = "pooled"
) -> DataFrame:
    """``cid``, ``effect_size`` per comparison.

    ``formula`` matters for Cohen's d and the point-biserial correlation:
    ``pooled`` divides by the pooled standard deviation, ``unpooled`` by
    sqrt((n1-1)v1 + (n2-1)v2/(n1+n2)), a variant found in existing tools.
    """
    if effect not in EFFECTS:
        raise ValidationError(f'"{effect}" is not a two-group effect size')
    column = schema.get(name, EFFECTS[effect])
    if effect == "cramer_v":
        return _chi(df, schema, comparisons, column).select("cid", F.col("cramer_v").alias("effect_size"))
    if effect == "rank_biserial":
        ranks = two_sample_ranks(df, comparisons, column)
        return ranks.select("cid", (_ratio(2 * F.col("u"), F.col("n1") * F.col("n2")) - 1).alias("effect_size"))
    if effect == "median_difference":
        return _median_difference(df, comparisons, column)
    frame = two_sample_moments(df, comparisons, F.col(quoted(name)))
    difference = F.col("mean1") - F.col("mean2")
    if effect == "mean_difference":
        return frame.select("cid", difference.alias("effect_size"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    if formula == "pooled":
        spread = F.sqrt(_ratio(F.col("m21") + F.col("m22"), n - 2))
    else:
        spread = F.sqrt(F.col("m21") + _ratio(F.col("m22"), n))
    d = _ratio(difference, spread)
    if effect == "point_biserial":
        d = d * F.sqrt(_ratio(n1 * n2, n * (n - 1)))
    return frame.select("cid", d.alias("effect_size"))


def _median_difference(df, comparisons, column):
    rows = df.select(
        comparisons.patterns.expression().alias("pattern"), F.col(quoted(column.name)).alias("value")
    ).filter("value IS NOT NULL")
    # Distinct sub-populations, so that a group shared by many comparisons is ranked once.
    cells, ends = {}, []
    for c, (i, j, _, _) in enumerate(comparisons.items):
        a, b = comparisons.sides(i, j)
        shared = j is not None and not comparisons.exclude
        ka, kb = (f"g{i}", f"g{j}") if shared else (f"a{c}", f"b{c}")
        cells[ka], cells[kb] = a, b
        ends.append((c, ka, kb))
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in cells.items()]))
    long = rows.select("value", F.explode(tags).alias("cell"))
    medians = exact_quantiles(long, ["cell"], "value", {"median": 0.5})
    # One small map of medians, then one row per comparison.
    table = medians.agg(F.map_from_entries(F.collect_list(F.struct("cell", "median"))).alias("m"))
    out = [F.struct(F.lit(c).alias("cid"), (F.col("m")[a] - F.col("m")[b]).alias("effect_size")) for c, a, b in ends]
    return table.select(F.inline(F.array(*out)))


def _compare(df, schema, comparisons, name, test, effect, formula) -> DataFrame:
    stats = with_p_value(test_statistics(df, schema, comparisons, name, test), test)
    stats = stats.withColumn("sample_size", (F.col("n1") + F.col("n2")).cast("long"))
    if effect == "cramer_v" and test == "chi_squared":
        sized = stats.withColumn("effect_size", F.col("cramer_v"))
    elif effect == "rank_biserial" and test == "mann_whitney_u":
        sized = stats.withColumn("effect_size", _ratio(2 * F.col("statistic"), F.col("n1") * F.col("n2")) - 1)
    else:
        sized = stats.join(effect_sizes(df, schema, comparisons, name, effect, formula), "cid")
    return sized.select(
        "group1", "group2", F.lit(test).alias("test"), "statistic", "p_value",
        F.lit(effect).alias("effect"), "effect_size", "sample_size",
    )


def compare(
    df: DataFrame, schema: TableSchema, groups, name: str, test: str, effect: str,
    exclude_overlapping: bool = False, formula: str = "pooled",
) -> DataFrame:
    """One test and one effect size between two groups."""
    if len(groups) != 2:
        raise ValidationError("exactly two groups are required")
    return compare_pairwise(df, schema, groups, name, test, effect, exclude_overlapping, formula, adjust=False)


def adjusted_p_values(frame: DataFrame) -> DataFrame:
    """Benjamini-Hochberg over all rows of a result frame (one row per comparison)."""
    everything = W.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy("p_value", "group1", "group2"))
    frame = frame.withColumns({"__rank": rank, "__m": F.count(F.lit(1)).over(everything)})
    upward = everything.orderBy(F.col("__rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("__m") / F.col("__rank")).over(upward))
    return frame.withColumn("p_value", adjusted).drop("__rank", "__m")


def compare_pairwise(
    df: DataFrame, schema: TableSchema, groups, name: str, test: str, effect: str,
    exclude_overlapping: bool = False, formula: str = "pooled", adjust: bool = True,
) -> DataFrame:
    """All pairs of groups in one job; p-values adjusted for their number."""
    schema.get(name, S.ANALYZABLE)
    comparisons = Comparisons(groups, schema, "pairs", exclude_overlapping)
    out = _compare(df, schema, comparisons, name, test, effect, formula)
    return adjusted_p_values(out) if adjust else out


def compare_with_rest(
    df: DataFrame, schema: TableSchema, groups, name: str, test: str, effect: str, formula: str = "pooled"
) -> DataFrame:
    """Each group against all rows outside it."""
    schema.get(name, S.ANALYZABLE)
    return _compare(df, schema, Comparisons(groups, schema, "rest"), name, test, effect, formula)


def omnibus_statistics(
    df: DataFrame, schema: TableSchema, groups, name: str, test: str, exclude_overlapping: bool = False
) -> DataFrame:
    """One row: ``statistic``, its degrees of freedom, ``effect_size``, ``sample_size``."""
    if test not in OMNIBUS_TESTS:
        raise ValidationError(f'"{test}" is not an omnibus test')
    column = schema.get(name, OMNIBUS_TESTS[test])
    patterns = Patterns(groups, schema)
    k = len(patterns)
    if k < 2:
        raise ValidationError("at least two groups are required")
    kept = (patterns.size() == 1) if exclude_overlapping else (patterns.size() >= 1)

    if test == "anova":
        table = moments(df, patterns, F.col(quoted(name))).filter(kept)
        table = table.withColumn("center", _grand_mean(table)).select("*", patterns.each_group())
        n, mean, m2 = _merge(patterns.has(F.col("gid")), F.col("center"))
        per_group = table.groupBy("gid").agg(
            n.alias("n"), mean.alias("mean"), m2.alias("m2"), F.max("center").alias("center")
        ).filter("n > 0")
        shift = F.col("mean") - F.col("center")
        sums = per_group.agg(
            F.sum("n").alias("total"),
            F.sum("m2").alias("within"),
            F.sum(F.col("n") * shift).alias("first"),
            F.sum(F.col("n") * shift * shift).alias("second"),
        )
        between = F.col("second") - _ratio(F.col("first") * F.col("first"), F.col("total"))
        dof2 = F.col("total") - k
        f = _ratio(between * dof2, F.col("within") * (k - 1))
        return sums.select(
            f.alias("statistic"), F.lit(float(k - 1)).alias("dof1"), dof2.alias("dof2"),
            _ratio(between, between + F.col("within")).alias("effect_size"),
            F.col("total").cast("long").alias("sample_size"),
        )

    if test == "kruskal_wallis":
        rows = df.select(patterns.expression().alias("pattern"), column.numeric_key().alias("value"))
        rows = rows.filter(F.col("value").isNotNull() & kept)
        cells = {f"g{i}": patterns.has(i) for i in range(k)}
        wide = rank_sums(rows, "value", cells, [], pooled=True)
        n = sum((F.col(f"n_{c}") for c in cells), F.lit(0.0))
        # Mean ranks are compared with the middle rank: no large numbers to cancel.
        gaps = [(F.col(f"n_{c}"), _ratio(F.col(f"r_{c}"), F.col(f"n_{c}")) - (n + 1) / 2) for c in cells]
        squares = sum((F.coalesce(size * gap * gap, F.lit(0.0)) for size, gap in gaps), F.lit(0.0))
        raw = _ratio(F.lit(12.0), n * (n + 1)) * squares
        correction = 1 - _ratio(F.col("tie_all"), n * n * n - n)
        h = _ratio(raw, correction)
        return wide.select(
            h.alias("statistic"), F.lit(float(k - 1)).alias("dof"),
            _ratio(h, n - 1).alias("effect_size"), n.cast("long").alias("sample_size"),
        )

    table = pattern_counts(df.filter(is_valid(column)), patterns, value=F.col(quoted(name))).filter(kept)
    observed = [f"o{i}" for i in range(k)]
    counts = table.groupBy("value").agg(
        *[F.coalesce(F.sum(F.when(patterns.has(i), F.col("n"))), F.lit(0)).cast("double").alias(o)
          for i, o in enumerate(observed)]
    )
    out = chi_squared_of(counts.withColumn("cid", F.lit(0)), ["cid"], k, observed)
    size = sum((F.col(f"t_{o}") for o in observed), F.lit(0.0))
    return out.select(
        "statistic", "dof", F.col("cramer_v").alias("effect_size"), size.cast("long").alias("sample_size")
    )


def compare_omnibus(
    df: DataFrame, schema: TableSchema, groups, name: str, test: str, exclude_overlapping: bool = False
) -> DataFrame:
    """k groups at once; the effect size goes with the test."""
    stats = with_p_value(omnibus_statistics(df, schema, groups, name, test, exclude_overlapping), test)
    return stats.select(
        F.lit(test).alias("test"), "statistic", "p_value",
        F.lit(OMNIBUS_EFFECTS[test]).alias("effect"), "effect_size", "sample_size",
    )


def binary_contingency(df: DataFrame, schema: TableSchema, groups, name: str, p_values: bool = True) -> DataFrame:
    """A 2x2 table per group and category with corrected chi-squared and Yule's Q.

    All cells come from the counts per pattern and value; the remaining corner
    follows from the margins. Q uses the raw counts and is NULL when undefined.
    """
    column = schema.get(name, S.CATEGORICAL_FAMILY)
    patterns = Patterns(groups, schema)
    table = pattern_counts(df.filter(is_valid(column)), patterns, value=F.col(quoted(name)))
    table = table.select("*", patterns.each_group())
    inside = F.coalesce(F.sum(F.when(patterns.has(F.col("gid")), F.col("n"))), F.lit(0))
    cells = table.groupBy("gid", "group", "value").agg(inside.alias("TT"), F.sum("n").alias("in_value"))
    margins = cells.groupBy("gid").agg(F.sum("TT").alias("in_group"), F.sum("in_value").alias("total"))
    cells = cells.join(margins, "gid").select(
        "group", "value", "TT",
        (F.col("in_group") - F.col("TT")).alias("TF"),
        (F.col("in_value") - F.col("TT")).alias("FT"),
        (F.col("total") - F.col("in_group") - F.col("in_value") + F.col("TT")).alias("FF"),
    )
    smallest = F.least("TT", "TF", "FT", "FF")
    add = F.when(smallest == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    a, b, c, d = (F.col(x) + add for x in ("TT", "TF", "FT", "FF"))
    n = a + b + c + d
    chi = F.lit(0.0)
    for observed, expected in ((a, (a + b) * (a + c) / n), (b, (a + b) * (b + d) / n),
                               (c, (c + d) * (a + c) / n), (d, (c + d) * (b + d) / n)):
        gap = F.abs(observed - expected)
        gap = gap - F.least(F.lit(0.5), gap)
        chi = chi + _ratio(gap * gap, expected)
    cross1 = F.col("TT").cast("double") * F.col("FF")
    cross2 = F.col("TF").cast("double") * F.col("FT")
    q = _ratio(cross1 - cross2, cross1 + cross2)
    out = cells.withColumns({"statistic": chi, "yule_q": q, "sparse": smallest < 5})
    return out.withColumn("p_value", D.chi2_p(F.col("statistic"), F.lit(1.0))) if p_values else out


@F.pandas_udf(T.DoubleType())
def _k_squared(n: pd.Series, g1: pd.Series, b2: pd.Series) -> pd.Series:
    """D'Agostino and Pearson: squared normal variates of skewness and kurtosis. One row per group."""
    y = g1 * ((n + 1) * (n + 3) / (6 * (n - 2))) ** 0.5
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = (2 * (beta - 1)) ** 0.5 - 1
    z1 = np.arcsinh(y / (2 / (w2 - 1)) ** 0.5) / (0.5 * np.log(w2)) ** 0.5
    x = (b2 - 3 * (n - 1) / (n + 1)) / (24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) ** 0.5
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * (6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) ** 0.5
    a = 6 + 8 / root * (2 / root + (1 + 4 / root**2) ** 0.5)
    d = 1 + x * (2 / (a - 4)) ** 0.5
    z2 = (1 - 2 / (9 * a) - np.sign(d) * np.cbrt((1 - 2 / a) / d.abs())) / (2 / (9 * a)) ** 0.5
    return z1**2 + z2**2


def _shapes(df: DataFrame, patterns: Patterns, value: SparkColumn, exclude_overlapping: bool) -> DataFrame:
    """``group``, ``n``, skewness ``g1`` and kurtosis ``b2`` per group, from central sums per pattern."""
    rows = df.select(patterns.expression().alias("pattern"), value.cast("double").alias("v")).filter("v IS NOT NULL")
    if exclude_overlapping:
        rows = rows.filter(patterns.size() <= 1)
    m2 = F.var_pop("v") * F.count("v")
    table = rows.groupBy("pattern").agg(
        F.count("v").cast("double").alias("n"), F.avg("v").alias("mean"), m2.alias("m2"),
        (F.coalesce(F.skewness("v"), F.lit(0.0)) * F.sqrt(m2 * m2 * m2 / F.count("v"))).alias("m3"),
        ((F.coalesce(F.kurtosis("v"), F.lit(-3.0)) + 3) * m2 * m2 / F.count("v")).alias("m4"),
    )
    table = table.withColumn("d", F.col("mean") - _grand_mean(table)).select("*", patterns.each_group())
    n, d, m2, m3, m4 = (F.col(c) for c in ("n", "d", "m2", "m3", "m4"))
    sums = table.filter(patterns.has(F.col("gid"))).groupBy("gid", "group").agg(
        F.sum(n).alias("n"), F.sum(n * d).alias("s1"), F.sum(m2 + n * d * d).alias("s2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("s3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("s4"),
    )
    n, shift = F.col("n"), F.col("s1") / F.col("n")
    second = F.col("s2") - n * shift * shift
    third = F.col("s3") - 3 * shift * F.col("s2") + 2 * n * shift * shift * shift
    fourth = F.col("s4") - 4 * shift * F.col("s3") + 6 * shift * shift * F.col("s2") - 3 * n * shift * shift * shift * shift
    return sums.select(
        "group", "n", (F.sqrt(n) * third / F.nullif(F.pow(second, F.lit(1.5)), F.lit(0.0))).alias("g1"),
        (n * fourth / F.nullif(second * second, F.lit(0.0))).alias("b2"),
    )


def normality(df: DataFrame, schema: TableSchema, groups, name: str, exclude_overlapping: bool = False) -> DataFrame:
    """D'Agostino's K^2 per group. The p-value is exp(-K2/2), the chi-squared tail for two degrees."""
    schema.get(name, (S.CONTINUOUS,))
    shape = _shapes(df, Patterns(groups, schema), F.col(quoted(name)), exclude_overlapping)
    # Small groups are computed with the others and then left out: one pass over one row per group.
    shape = shape.withColumn("statistic", F.when(F.col("n") >= 30, _k_squared("n", "g1", "b2")))
    p = F.exp(-F.col("statistic") / 2)
    return shape.select("group", F.col("n").cast("long").alias("n"), "statistic", p.alias("p_value"), (p > 0.05).alias("is_normal"))


def normality_warnings(
    df: DataFrame, schema: TableSchema, groups, name: str, test: str, exclude_overlapping: bool = False
) -> DataFrame:
    """Parametric tests warn about small or non-normal groups, rank tests about normal ones."""
    frame = normality(df, schema, groups, name, exclude_overlapping)
    parametric = test in ("t", "anova")
    confidence = lambda p: F.format_number(100 * p, 2)
    if parametric:
        message = F.when(
            F.col("statistic").isNull(),
            F.concat(F.lit('"'), F.col("group"), F.lit('" has too few rows ('), F.col("n").cast("string"),
                     F.lit(") to expect a normal distribution")),
        ).when(
            ~F.col("is_normal"),
            F.concat(F.lit('"'), F.col("group"), F.lit('" is not normally distributed ('),
                     confidence(1 - F.col("p_value")), F.lit("%)")),
        )
    else:
        message = F.when(
            F.col("is_normal"),
            F.concat(F.lit('"'), F.col("group"), F.lit('" is normally distributed ('),
                     confidence(F.col("p_value")), F.lit("%); a parametric test may suit better")),
        )
    return frame.select("group", message.alias("message")).filter("message IS NOT NULL")


def sparse_cells(
    df: DataFrame, schema: TableSchema, groups, name: str, exclude_overlapping: bool = False
) -> DataFrame:
    """One row: cells below 5, all cells, whether a fifth or more are sparse, and the first five."""
    column = schema.get(name, S.CATEGORICAL_FAMILY)
    patterns = Patterns(groups, schema)
    cells = value_counts(df, schema, patterns, name, exclude_overlapping)
    order = column.sort_key(F.col("value"))
    thin = F.when(F.col("observed") < 5, F.struct(
        order.alias("order"), "gid", "group", F.col("value").cast("string").alias("value"), "observed"
    ))
    summary = cells.agg(
        F.count_if(F.col("observed") < 5).alias("sparse"), F.count(F.lit(1)).alias("cells"),
    ).withColumn("warn", F.col("sparse") >= F.lit(0.2) * F.col("cells"))
    first = cells.select(thin.alias("c")).filter("c IS NOT NULL").orderBy("c").limit(5)
    listed = first.agg(F.sort_array(F.collect_list("c")).alias("l")).scalar()
    text = F.transform(
        F.col("l"),
        lambda c: F.concat(c["group"], F.lit(" - "), c["value"], F.lit(" ("), c["observed"].cast("string"), F.lit(")")),
    )
    return summary.withColumn("l", listed).select("sparse", "cells", "warn", F.array_join(text, ", ").alias("first"))
