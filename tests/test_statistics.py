"""Distribution functions, ranks, tests and effect sizes against independent computations."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetframe.errors import ValidationError
from facetframe.functions import distributions as D
from facetframe.functions.ranking import exact_quantiles
from facetframe.operators import comparison as C
from facetframe.operators import groups as G
from facetframe.schema import INDEX, Column, TableSchema

SCHEMA = TableSchema.of(Column("v", "continuous"), Column("g", "categorical"), Column("c", "categorical"))
AB = [{"name": n, "filter": {"type": "equal_to", "target": "g", "value": n}} for n in "ab"]


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"`{INDEX}` long, v double, g string, c string")


def test_tails_match_commons_math(spark):
    lib = spark._jvm.org.apache.commons.math3.distribution
    for dof in (1.0, 3.0, 30.0, 2000.0):
        for x in (0.01, 0.7, 2.5, 9.0):
            # At 2000 degrees the library itself is off by 2e-12 (see the next test).
            assert D.t_two_sided(x, dof) == pytest.approx(2 * (1 - lib.TDistribution(dof).cumulativeProbability(x)), abs=1e-11)
            assert D.chi2_upper(x, dof) == pytest.approx(1 - lib.ChiSquaredDistribution(dof).cumulativeProbability(x), abs=1e-10)
            assert D.f_upper(x, dof, 7.0) == pytest.approx(1 - lib.FDistribution(dof, 7.0).cumulativeProbability(x), abs=1e-10)
    assert D.normal_two_sided(D.Z975) == pytest.approx(0.05, abs=1e-12)


def test_t_tail_from_whole_numbers():
    n, x = 1000, 0.01
    ratio = math.sqrt(math.pi) * float(Fraction(math.comb(2 * n, n) * n, 4**n))  # gamma(n + 1/2) / gamma(n)
    series = x - (n + 0.5) / (2 * n) * x**3 / 3 + (n + 0.5) * (n + 1.5) / 2 / (2 * n) ** 2 * x**5 / 5
    assert D.t_two_sided(x, 2.0 * n) == pytest.approx(1 - 2 * ratio / math.sqrt(2 * math.pi * n) * series, abs=1e-15)


@pytest.mark.parametrize("power", range(6, 15))
def test_tails_reach_their_limits(power):
    dof = 10.0**power
    # First-order corrections of the limits, from the series in 1 / dof.
    t, phi = 2.0, math.exp(-2.0) / math.sqrt(2 * math.pi)
    assert D.t_two_sided(t, dof) == pytest.approx(math.erfc(t / math.sqrt(2)) + 2 * phi * (t**3 + t) / (4 * dof), abs=1e-9)
    assert D.f_upper(1.5, 2.0, dof) == pytest.approx(math.exp(-dof / 2 * math.log1p(3.0 / dof)), abs=1e-9)
    # Chi-squared: the normal limit with its skewness and second-order terms.
    z = 1.3
    skew, excess = math.sqrt(8 / dof), 12 / dof
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    edge = density * (skew / 6 * (z * z - 1) + excess / 24 * (z**3 - 3 * z) + skew**2 / 72 * (z**5 - 10 * z**3 + 15 * z))
    assert D.chi2_upper(dof + z * math.sqrt(2 * dof), dof) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)) + edge, abs=1e-8 if power == 6 else 1e-9)


def test_exact_u_of_two_rows_against_millions():
    assert C.exact_u_two_sided(0, 2, 3_000_000) == pytest.approx(2 / math.comb(3_000_002, 2), rel=1e-12)
    assert C.exact_u_two_sided(4e12, 8, 10**12) == 1.0


def test_p_columns_handle_null(spark):
    df = spark.createDataFrame([(2.0, 5.0), (None, 5.0)], "x double, d double")
    out = [r[0] for r in df.select(D.chi2_p(F.col("x"), F.col("d"))).collect()]
    assert out[0] == pytest.approx(D.chi2_upper(2.0, 5.0)) and out[1] is None


@pytest.mark.parametrize("n1,n2", [(1, 4), (3, 5), (4, 4), (7, 3)])
def test_exact_u_by_enumeration(n1, n2):
    values = range(n1 + n2)
    us = [sum(a > b for a in s for b in values if b not in s) for s in itertools.combinations(values, n1)]
    for u in range(n1 * n2 + 1):
        top = max(u, n1 * n2 - u)
        expected = min(1.0, 2 * sum(x >= top for x in us) / len(us))
        assert C.exact_u_two_sided(u, n1, n2) == pytest.approx(expected)


def test_quantiles_with_a_hot_value_and_hot_key(spark):
    random.seed(1)
    rows = [("hot", 7.0)] * 4000 + [("hot", random.random() * 10) for _ in range(3000)] + [("rare", x) for x in (1.0, 2.0, 4.0)] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()}
    for key in ("hot", "rare", "one"):
        values = [v for k, v in rows if k == key]
        for name, p in (("q1", 25), ("q2", 50), ("q9", 90)):
            assert out[key][name] == pytest.approx(np.percentile(values, p))


def test_mann_whitney_small_samples_are_exact(spark):
    rows = [(float(x), "a", None) for x in (1, 5, 9)] + [(float(x), "b", None) for x in (2, 3, 4, 6, 7)]
    out = C.compare(table(spark, rows), SCHEMA, AB, "v", "mann_whitney_u", "rank_biserial").first()
    u = sum(a > b for a in (1, 5, 9) for b in (2, 3, 4, 6, 7))
    assert out["statistic"] == u and out["p_value"] == pytest.approx(C.exact_u_two_sided(u, 3, 5))
    assert out["effect_size"] == pytest.approx(2 * u / 15 - 1)


def test_t_test_textbook(spark):
    a, b = [30.02, 29.99, 30.11, 29.97, 30.01, 29.99], [29.89, 29.93, 29.72, 29.98, 30.02, 29.98]
    out = C.compare(table(spark, [(x, "a", None) for x in a] + [(x, "b", None) for x in b]), SCHEMA, AB, "v", "t", "mean_difference").first()
    assert out["statistic"] == pytest.approx(1.959, abs=1e-3) and out["p_value"] == pytest.approx(0.07857, abs=1e-4)
    assert out["effect_size"] == pytest.approx(0.095)


def test_degenerate_groups_give_null_not_an_error(spark):
    same = table(spark, [(1.0, "a", "x"), (1.0, "a", "x"), (1.0, "b", "x")])
    assert C.compare(same, SCHEMA, AB, "v", "t", "cohen_d").first()["statistic"] is None
    empty = table(spark, [(1.0, "a", "x"), (2.0, "a", "y")])
    for test, effect, column in (("t", "median_difference", "v"), ("mann_whitney_u", "rank_biserial", "v"), ("chi_squared", "cramer_v", "c")):
        C.compare(empty, SCHEMA, AB, column, test, effect).collect()
    for test, column in (("anova", "v"), ("kruskal_wallis", "v"), ("chi_squared", "c")):
        C.compare_omnibus(empty, SCHEMA, AB, column, test).collect()


def test_unsupported_columns_are_refused(spark):
    df = table(spark, [(1.0, "a", "x")])
    with pytest.raises(ValidationError):
        C.compare(df, SCHEMA, AB, "g", "t", "cohen_d")
    with pytest.raises(ValidationError):
        C.compare_pairwise(df, SCHEMA, AB[:1], "v", "t", "cohen_d")


def test_u_of_both_sides_adds_up_and_rest_is_symmetric(spark):
    random.seed(3)
    df = table(spark, [(float(random.randint(0, 30)), random.choice("ab"), None) for _ in range(500)])
    ab = C.compare(df, SCHEMA, AB, "v", "mann_whitney_u", "rank_biserial").first()
    ba = C.compare(df, SCHEMA, AB[::-1], "v", "mann_whitney_u", "rank_biserial").first()
    n = {g: df.filter(F.col("g") == g).count() for g in "ab"}
    assert ab["statistic"] + ba["statistic"] == n["a"] * n["b"]
    assert ab["p_value"] == pytest.approx(ba["p_value"])
    rest = C.compare_with_rest(df, SCHEMA, AB[:1], "v", "mann_whitney_u", "rank_biserial").first()
    assert rest["statistic"] == ab["statistic"]


def test_benjamini_hochberg():
    raw = [0.01, 0.04, 0.03, 0.005]
    order = sorted(raw)
    expected = {p: min(q * 4 / (i + 1) for i, q in enumerate(order) if q >= p) for p in raw}
    assert expected[0.03] == pytest.approx(0.04)


def test_adjusted_p_values(spark):
    raw = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([(p, "g", str(i), p) for i, p in enumerate(raw)], "raw double, group1 string, group2 string, p_value double")
    out = {r["raw"]: r["p_value"] for r in C.adjusted_p_values(df).collect()}
    assert out == pytest.approx({0.005: 0.02, 0.01: 0.02, 0.03: 0.04, 0.04: 0.04})


def test_more_groups_than_bits(spark):
    df = table(spark, [(float(i), "a", None) for i in range(100)])
    many = [{"name": f"below {k}", "filter": {"type": "less_than", "target": "v", "value": k}} for k in range(70)]
    info = {r["group"]: r for r in G.group_info(df, SCHEMA, many, "v").collect()}
    assert info["below 0"]["valid_count"] == 0 and info["below 69"]["valid_count"] == 69
    assert info["below 69"]["overlap_count"] == 68 and info["below 5"]["total_count"] == 100


def test_contingency_margins(spark):
    random.seed(5)
    df = table(spark, [(0.0, random.choice("ab"), random.choice("xyz")) for _ in range(300)])
    cells = G.contingency_table(df, SCHEMA, AB, "c").collect()
    assert sum(c["observed"] for c in cells) == 300
    assert sum(c["expected"] for c in cells) == pytest.approx(300)
    assert sum(c["residual"] for c in cells) == pytest.approx(0, abs=1e-9)
    assert all(math.isfinite(c["standardized_residual"]) for c in cells)
