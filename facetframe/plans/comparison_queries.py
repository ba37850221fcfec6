"""Statistical tests, effect sizes and regressions between groups of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparison as C
from ..operators import design
from ..operators import regression as R
from . import tables as T
from .profile_queries import LONG_SQL, MASKS_SQL
from .registry import query, r, rounded
from .tables import BY_STATUS, EQ, GT, IN, ORDERS_SQL, OVERLAPPING

_T = "WITH t AS (" + MASKS_SQL + "), l AS (" + LONG_SQL + ")"
# Pairs of overlapping groups, rows in both left out of the pair.
_APART = _T + """,
    p AS (SELECT 'F orders' AS group1, 'large' AS group2, m1 AS a, m2 AS b, t.* FROM t UNION ALL
          SELECT 'F orders', 'urgent', m1, m3, t.* FROM t UNION ALL SELECT 'large', 'urgent', m2, m3, t.* FROM t),
    s AS (SELECT group1, group2, CASE WHEN a THEN 1 ELSE 2 END AS side, price_known AS v, priority_known AS c, status_known AS s
          FROM p WHERE a <> b)"""
# The same with shared rows on both sides.
_SHARED = _T + """,
    p AS (SELECT 'F orders' AS group1, 'large' AS group2, m1 AS a, m2 AS b, t.* FROM t UNION ALL
          SELECT 'F orders', 'urgent', m1, m3, t.* FROM t UNION ALL SELECT 'large', 'urgent', m2, m3, t.* FROM t),
    s AS (SELECT group1, group2, 1 AS side, price_known AS v, priority_known AS c, status_known AS s FROM p WHERE a
          UNION ALL SELECT group1, group2, 2, price_known, priority_known, status_known FROM p WHERE b)"""
# Each group against the rest.
_REST = _T + """,
    p AS (SELECT 'F orders' AS group1, m1 AS a, t.* FROM t UNION ALL SELECT 'large', m2, t.* FROM t UNION ALL SELECT 'urgent', m3, t.* FROM t),
    s AS (SELECT group1, 'NOT ' || group1 AS group2, CASE WHEN a THEN 1 ELSE 2 END AS side, price_known AS v, priority_known AS c,
                 status_known AS s FROM p)"""
_MOMENTS = """,
    m AS (SELECT group1, group2, count(v) FILTER (WHERE side = 1)::DOUBLE AS n1, count(v) FILTER (WHERE side = 2)::DOUBLE AS n2,
                 avg(v) FILTER (WHERE side = 1) AS a1, avg(v) FILTER (WHERE side = 2) AS a2,
                 var_samp(v) FILTER (WHERE side = 1) AS v1, var_samp(v) FILTER (WHERE side = 2) AS v2,
                 median(v) FILTER (WHERE side = 1) AS d1, median(v) FILTER (WHERE side = 2) AS d2
          FROM s WHERE v IS NOT NULL GROUP BY ALL)"""
# Mid-ranks, rank sums and tied counts within each comparison.
_RANKS = """,
    k AS (SELECT group1, group2, side, rank() OVER w + (count(*) OVER (PARTITION BY group1, group2, v) - 1) / 2.0 AS rk
          FROM s WHERE v IS NOT NULL WINDOW w AS (PARTITION BY group1, group2 ORDER BY v)),
    u AS (SELECT group1, group2, count(*) FILTER (WHERE side = 1)::DOUBLE AS n1, count(*) FILTER (WHERE side = 2)::DOUBLE AS n2,
                 sum(rk) FILTER (WHERE side = 1) - count(*) FILTER (WHERE side = 1) * (count(*) FILTER (WHERE side = 1) + 1) / 2.0 AS u
          FROM k GROUP BY ALL)"""
_CELLS = """,
    o AS (SELECT x.*, coalesce(y.o, 0) AS raw FROM
              (SELECT DISTINCT a.group1, a.group2, b.side, a.{c} AS c FROM s a, (VALUES (1), (2)) b(side) WHERE a.{c} IS NOT NULL) x
          LEFT JOIN (SELECT group1, group2, side, {c} AS c, count(*) AS o FROM s WHERE {c} IS NOT NULL GROUP BY ALL) y
          USING (group1, group2, side, c)),
    h AS (SELECT *, raw + CASE WHEN min(raw) OVER (PARTITION BY group1, group2) = 0 THEN 0.5 ELSE 0.0 END AS o FROM o),
    e AS (SELECT *, sum(o) OVER (PARTITION BY group1, group2, side) * sum(o) OVER (PARTITION BY group1, group2, c)
                    / sum(o) OVER (PARTITION BY group1, group2) AS e, count(*) OVER (PARTITION BY group1, group2) / 2.0 AS width FROM h),
    x AS (SELECT group1, group2, sum(CASE WHEN width = 2 THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) ELSE power(o - e, 2) END / e) AS chi2,
                 sum(o) AS n, max(width) AS w, sum(raw) AS size FROM e GROUP BY ALL)"""


def _compare(spark, folder, kind: str, name: str, test: str, exclude=False):
    df, schema = T.orders(spark, folder)
    comparisons = C.Comparisons(OVERLAPPING, schema, kind, exclude)
    return C.test_statistics(df, schema, comparisons, name, test)


def _effect(spark, folder, name: str, effect: str, exclude=False, formula="pooled"):
    df, schema = T.orders(spark, folder)
    comparisons = C.Comparisons(OVERLAPPING, schema, "pairs", exclude)
    pairs = spark.createDataFrame([(c, i[2], i[3]) for c, i in enumerate(comparisons.items)], "cid int, group1 string, group2 string")
    out = C.effect_sizes(df, schema, comparisons, name, effect, formula)
    return pairs.join(out, "cid").select("group1", "group2", "effect_size")


@query(_SHARED + _MOMENTS + """
    SELECT group1, group2, n1, n2, """ + r("(a1 - a2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))") + """ AS statistic FROM m
""")
def t_statistic(spark, folder):
    return rounded(_compare(spark, folder, "pairs", "price_known", "t").select("group1", "group2", "n1", "n2", "statistic"))


@query(_APART + _RANKS + "SELECT group1, group2, n1, n2, " + r("u", 1) + " AS statistic FROM u")
def mann_whitney_u(spark, folder):
    out = _compare(spark, folder, "pairs", "price_known", "mann_whitney_u", True)
    return rounded(out.select("group1", "group2", "n1", "n2", "statistic"), 1)


@query((_SHARED + _RANKS).replace("price_known AS v", "CAST(substr(priority_known, 1, 1) AS INT) AS v")
       .replace("UNION ALL SELECT group1, group2, 2, price_known", "UNION ALL SELECT group1, group2, 2, CAST(substr(priority_known, 1, 1) AS INT)")
       + "SELECT group1, group2, n1, n2, " + r("u", 1) + " AS statistic FROM u")
def mann_whitney_u_of_categories(spark, folder):
    """Ordered categories are ranked by position; almost every value is tied."""
    out = _compare(spark, folder, "pairs", "priority_known", "mann_whitney_u")
    return rounded(out.select("group1", "group2", "n1", "n2", "statistic"), 1)


@query(_APART + _CELLS.format(c="c") + "SELECT group1, group2, " + r("chi2") + " AS statistic, w - 1.0 AS dof FROM x")
def chi_squared_statistic(spark, folder):
    out = _compare(spark, folder, "pairs", "priority_known", "chi_squared", True)
    return rounded(out.select("group1", "group2", "statistic", "dof"))


@query(_REST + _CELLS.format(c="s") + "SELECT group1, group2, " + r("chi2") + " AS statistic, w - 1.0 AS dof FROM x")
def chi_squared_against_rest(spark, folder):
    """Two categories, so the tables are 2x2 and corrected; one of them has empty cells."""
    out = _compare(spark, folder, "rest", "status_known", "chi_squared")
    return rounded(out.select("group1", "group2", "statistic", "dof"))


@query(_REST + _RANKS + "SELECT group1, group2, " + r("u", 1) + " AS statistic, " + r("2 * u / (n1 * n2) - 1") + " AS effect_size FROM u")
def mann_whitney_against_rest(spark, folder):
    df, schema = T.orders(spark, folder)
    out = C.compare_with_rest(df, schema, OVERLAPPING, "price_known", "mann_whitney_u", "rank_biserial")
    return rounded(out.select("group1", "group2", "statistic", "effect_size"))


@query(_SHARED + _MOMENTS + "SELECT group1, group2, " + r("a1 - a2", 4) + " AS effect_size FROM m")
def effect_mean_difference(spark, folder):
    return rounded(_effect(spark, folder, "price_known", "mean_difference"), 4)


@query(_APART + _MOMENTS + "SELECT group1, group2, " + r("d1 - d2", 4) + " AS effect_size FROM m")
def effect_median_difference(spark, folder):
    return rounded(_effect(spark, folder, "price_known", "median_difference", True), 4)


@query(_SHARED + _MOMENTS + "SELECT group1, group2, " + r("(a1 - a2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))") + " AS effect_size FROM m")
def effect_cohen_d(spark, folder):
    return rounded(_effect(spark, folder, "price_known", "cohen_d"))


@query(_SHARED + _MOMENTS + "SELECT group1, group2, " + r("(a1 - a2) / sqrt((n1 - 1) * v1 + ((n2 - 1) * v2) / (n1 + n2))") + " AS effect_size FROM m")
def effect_cohen_d_unpooled(spark, folder):
    return rounded(_effect(spark, folder, "price_known", "cohen_d", formula="unpooled"))


@query(_APART + _MOMENTS + "SELECT group1, group2, " + r("""(a1 - a2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    * sqrt(n1 * n2 / ((n1 + n2) * (n1 + n2 - 1)))""") + " AS effect_size FROM m")
def effect_point_biserial(spark, folder):
    return rounded(_effect(spark, folder, "price_known", "point_biserial", True))


@query(_SHARED + _RANKS + ", a AS (SELECT group1, group2, avg(rk) FILTER (WHERE side = 1) AS r1, avg(rk) FILTER (WHERE side = 2) AS r2, count(*) AS n FROM k GROUP BY ALL) SELECT group1, group2, "
       + r("2 * (r1 - r2) / n") + " AS effect_size FROM a")
def effect_rank_biserial(spark, folder):
    return rounded(_effect(spark, folder, "price_known", "rank_biserial"))


_V = "sqrt(greatest(0, chi2 / n - (w - 1) * ({k} - 1) / (n - 1)) / least({k} - ({k} - 1) * ({k} - 1) / (n - 1) - 1, w - (w - 1) * (w - 1) / (n - 1) - 1))"


@query(_APART + _CELLS.format(c="c") + "SELECT group1, group2, " + r(_V.format(k="2.0")) + " AS effect_size FROM x")
def effect_cramer_v(spark, folder):
    return rounded(_effect(spark, folder, "priority_known", "cramer_v", True))


_BY_STATUS = "WITH s AS (SELECT status AS g, price_known AS v, priority_known AS c, status FROM (" + ORDERS_SQL + "))"


@query(_BY_STATUS + """,
    g AS (SELECT g, count(v)::DOUBLE AS n, avg(v) AS a, var_pop(v) * count(v) AS m2 FROM s GROUP BY g),
    b AS (SELECT sum(n) AS n, sum(m2) AS w, (SELECT var_pop(v) * count(v) FROM s) - sum(m2) AS b FROM g)
    SELECT """ + r("(b / 2) / (w / (n - 3))") + " AS statistic, 2.0::DOUBLE AS dof1, n - 3 AS dof2, " + r("b / (b + w)") + """ AS effect_size,
           CAST(n AS BIGINT) AS sample_size FROM b
""")
def anova_f(spark, folder):
    return rounded(C.omnibus_statistics(*T.orders(spark, folder), BY_STATUS, "price_known", "anova"))


@query(_BY_STATUS + """,
    k AS (SELECT g, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rk FROM s WHERE c IS NOT NULL),
    z AS (SELECT sum(power(n, 3) - n) AS ties, sum(n)::DOUBLE AS n FROM (SELECT count(*)::DOUBLE AS n FROM s WHERE c IS NOT NULL GROUP BY c)),
    h AS (SELECT (12 / (any_value(n) * (any_value(n) + 1)) * sum(rs) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (power(any_value(n), 3) - any_value(n))) AS h,
                 any_value(n) AS n FROM (SELECT power(sum(rk), 2) / count(*) AS rs FROM k GROUP BY g), z)
    SELECT 'kruskal_wallis' AS test, """ + r("h") + " AS statistic, " + r("exp(-h / 2)") + " AS p_value, 'epsilon_squared' AS effect, "
       + r("h / (n - 1)", 9) + """ AS effect_size, CAST(n AS BIGINT) AS sample_size FROM h
""")
def kruskal_wallis_omnibus(spark, folder):
    """Three groups: two degrees of freedom, for which the p-value is an exponential."""
    out = C.compare_omnibus(*T.orders(spark, folder), BY_STATUS, "priority_known", "kruskal_wallis")
    return rounded(out, effect_size=9)


@query(_BY_STATUS + """,
    o AS (SELECT g, c, count(*)::DOUBLE AS o FROM s WHERE c IS NOT NULL GROUP BY ALL),
    e AS (SELECT *, sum(o) OVER (PARTITION BY g) * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e FROM o),
    x AS (SELECT sum(power(o - e, 2) / e) AS chi2, sum(o) AS n, 5.0 AS w FROM e)
    SELECT """ + r("chi2") + " AS statistic, 8.0::DOUBLE AS dof, " + r(_V.format(k="3.0")) + """ AS effect_size, CAST(n AS BIGINT) AS sample_size FROM x
""")
def chi_squared_omnibus(spark, folder):
    return rounded(C.omnibus_statistics(*T.orders(spark, folder), BY_STATUS, "priority_known", "chi_squared"))


_YEARS = [{"name": f"since {y}", "filter": {"type": "greater_than_or_equal_to", "target": "date", "value": f"{y}-01-01"}} for y in (1996, 1998, 2000)]


@query("WITH t AS (SELECT *, year(date) >= 1996 AS y1, year(date) >= 1998 AS y2, year(date) >= 2000 AS y3 FROM (" + ORDERS_SQL + """)),
    p AS (SELECT 'since 1996' AS group1, 'since 1998' AS group2, y1 AS a, y2 AS b, t.* FROM t UNION ALL
          SELECT 'since 1996', 'since 2000', y1, y3, t.* FROM t UNION ALL SELECT 'since 1998', 'since 2000', y2, y3, t.* FROM t),
    s AS (SELECT group1, group2, 1 AS side, status AS c FROM p WHERE a UNION ALL SELECT group1, group2, 2, status FROM p WHERE b)"""
       + _CELLS.format(c="c") + """,
    q AS (SELECT *, exp(-chi2 / 2) AS p, row_number() OVER (ORDER BY exp(-chi2 / 2), group1, group2) AS k FROM x)
    SELECT group1, group2, """ + r("chi2") + " AS statistic, " + r("least(1, min(p * 3 / k) OVER (ORDER BY k DESC))") + " AS p_value, "
       + r(_V.format(k="2.0")) + " AS effect_size, CAST(size AS BIGINT) AS sample_size FROM q")
def pairwise_adjusted_p(spark, folder):
    """Three categories: two degrees of freedom. The p-values are adjusted for the number of pairs."""
    out = C.compare_pairwise(*T.orders(spark, folder), _YEARS, "status", "chi_squared", "cramer_v")
    return rounded(out.drop("test", "effect"))


def _erfc(x: str) -> str:
    """The complementary error function as its power series; beyond 4.5 it is zero to six digits."""
    return (f"CASE WHEN {x} > 4.5 THEN 0.0 ELSE 1 - 1.1283791670955126 * list_sum(list_transform(range(0, 90), "
            f"lambda i: power(-1.0, i) * power({x}, 2 * i + 1) / ((2 * i + 1) * gamma(i + 1.0)))) END")


# p-values adjusted for their number (Benjamini and Hochberg); ``x`` has group1, group2 and p.
_ADJUSTED = """,
    q AS (SELECT *, row_number() OVER (ORDER BY p, group1, group2) AS k, count(*) OVER () AS pairs FROM x),
    adj AS (SELECT *, least(1, min(p * pairs / k) OVER (ORDER BY k DESC)) AS p_value FROM q)"""
# The tail of U by its normal limit, corrected for ties and continuity.
_U_TAIL = """,
    ties AS (SELECT group1, group2, sum(c * c * c - c) AS t FROM (SELECT group1, group2, v, count(*)::DOUBLE AS c FROM s WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL),
    zs AS (SELECT u.*, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u JOIN ties USING (group1, group2)),
    x AS (SELECT *, least(1, """ + _erfc("(z / sqrt(2.0))") + """) AS p FROM zs)"""


@query(_APART + _MOMENTS + """,
    f AS (SELECT *, (a1 - a2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t, n1 + n2 - 2 AS d,
                 (a1 - a2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS e FROM m),
    x AS (SELECT *, """ + _erfc("((8 * d + 1) / (8 * d + 3) * sqrt(d * ln(1 + t * t / d)) / sqrt(2.0))") + " AS p FROM f)" + _ADJUSTED + """
    SELECT group1, group2, 't' AS test, """ + r("t") + " AS statistic, " + r("p_value", 5) + " AS p_value, 'cohen_d' AS effect, " + r("e")
       + " AS effect_size, CAST(n1 + n2 AS BIGINT) AS sample_size FROM adj")
def pairwise_t_test(spark, folder):
    """The SQL takes the tail of t from the normal one at a corrected place: right to seven digits at these sizes."""
    return rounded(C.compare_pairwise(*T.orders(spark, folder), OVERLAPPING, "price_known", "t", "cohen_d", True), p_value=5)


@query("WITH t AS (" + ORDERS_SQL + """),
    g AS (SELECT DISTINCT priority AS g FROM t),
    s AS (SELECT a.g AS group1, b.g AS group2, CASE WHEN priority = a.g THEN 1 ELSE 2 END AS side, price_known AS v
          FROM g a JOIN g b ON a.g < b.g JOIN t ON priority IN (a.g, b.g))""" + _RANKS + _U_TAIL + _ADJUSTED + """
    SELECT group1, group2, 'mann_whitney_u' AS test, """ + r("u", 1) + " AS statistic, " + r("p_value") + " AS p_value, 'rank_biserial' AS effect, "
       + r("2 * u / (n1 * n2) - 1") + " AS effect_size, CAST(n1 + n2 AS BIGINT) AS sample_size FROM adj")
def pairwise_mann_whitney(spark, folder):
    five = [{"name": p, "filter": EQ("priority", p)} for p in T.PRIORITIES]
    return rounded(C.compare_pairwise(*T.orders(spark, folder), five, "price_known", "mann_whitney_u", "rank_biserial"), statistic=1)


@query(_APART + _MOMENTS + _RANKS + _U_TAIL + """
    SELECT group1, group2, 'mann_whitney_u' AS test, """ + r("u", 1) + " AS statistic, " + r("p") + " AS p_value, 'median_difference' AS effect, "
       + r("d1 - d2") + """ AS effect_size, CAST(x.n1 + x.n2 AS BIGINT) AS sample_size
    FROM x JOIN m USING (group1, group2) WHERE group1 = 'F orders' AND group2 = 'large'""")
def two_group_comparison(spark, folder):
    return rounded(C.compare(*T.orders(spark, folder), OVERLAPPING[:2], "price_known", "mann_whitney_u", "median_difference", True))


@query("WITH t AS (" + ORDERS_SQL + """),
    v AS (SELECT status, price_known AS x, avg(price_known) OVER (PARTITION BY status) AS own, avg(price_known) OVER () AS whole
          FROM t WHERE price_known IS NOT NULL),
    s AS (SELECT sum((x - own) ** 2) AS inside, sum((own - whole) ** 2) AS outside, count(*) AS n FROM v),
    f AS (SELECT *, (outside / 2) / (inside / (n - 3)) AS f FROM s)
    SELECT 'anova' AS test, """ + r("f") + " AS statistic, " + r("exp(-(n - 3) / 2.0 * ln(1 + 2 * f / (n - 3)))") + """ AS p_value,
           'eta_squared' AS effect, """ + r("outside / (outside + inside)") + " AS effect_size, n AS sample_size FROM f")
def anova_omnibus(spark, folder):
    """Three groups: with two degrees of freedom the tail of F has a closed form."""
    return rounded(C.compare_omnibus(*T.orders(spark, folder), BY_STATUS, "price_known", "anova"))


_BINARY = _T + """,
    g AS (SELECT unnest(['F orders', 'large', 'urgent']) AS g, unnest([1, 2, 3]) AS i),
    n AS (SELECT g.g, v.c AS value, count(*) FILTER (WHERE m AND hit) AS TT, count(*) FILTER (WHERE m AND NOT hit) AS TF,
                 count(*) FILTER (WHERE NOT m AND hit) AS FT, count(*) FILTER (WHERE NOT m AND NOT hit) AS FF
          FROM (SELECT g.g, v.c, [m1, m2, m3][g.i] AS m, priority_known = v.c AS hit
                FROM t, g, (SELECT DISTINCT priority_known AS c FROM t WHERE priority_known IS NOT NULL) v
                WHERE priority_known IS NOT NULL) x JOIN g ON g.g = x.g JOIN (SELECT DISTINCT priority_known AS c FROM t) v ON v.c = x.c
          GROUP BY ALL),
    a AS (SELECT *, CASE WHEN least(TT, TF, FT, FF) = 0 THEN 0.5 ELSE 0 END AS d FROM n),
    b AS (SELECT *, TT + d AS p, TF + d AS q, FT + d AS u, FF + d AS w, TT + TF + FT + FF + 4 * d AS s FROM a),
    c AS (SELECT *, abs(p - (p + q) * (p + u) / s) AS gap FROM b)
    SELECT g AS "group", value, TT, TF, FT, FF, least(TT, TF, FT, FF) < 5 AS sparse,
           """ + r("power(gap - least(0.5, gap), 2) * (s / ((p+q)*(p+u)) + s / ((p+q)*(q+w)) + s / ((u+w)*(p+u)) + s / ((u+w)*(q+w)))") + """ AS statistic,
           """ + r("(TT::DOUBLE * FF - TF::DOUBLE * FT) / nullif(TT::DOUBLE * FF + TF::DOUBLE * FT, 0)") + """ AS yule_q
    FROM c
"""


@query(_BINARY)
def binary_contingency(spark, folder):
    return rounded(C.binary_contingency(*T.orders(spark, folder), OVERLAPPING, "priority_known", p_values=False))


# The statistic before it is rounded.
_BINARY_EXACT = _BINARY.replace(", 6) + 0.0 AS statistic", ", 16) + 0.0 AS statistic")


@query("SELECT * REPLACE (" + r("statistic") + " AS statistic), " + r(_erfc("sqrt(statistic / 2)")) + " AS p_value FROM (" + _BINARY_EXACT + ")")
def binary_contingency_p(spark, folder):
    return rounded(C.binary_contingency(*T.orders(spark, folder), OVERLAPPING, "priority_known"))


_K_SQUARED = """
    c AS (SELECT g, v, avg(v) OVER (PARTITION BY g) AS a FROM v),
    m AS (SELECT g, count(*)::DOUBLE AS n, avg(power(v - a, 2)) AS m2, avg(power(v - a, 3)) AS m3, avg(power(v - a, 4)) AS m4 FROM c GROUP BY g),
    s AS (SELECT g, n, m3 / power(m2, 1.5) AS g1, m4 / power(m2, 2) AS b2 FROM m),
    k AS (SELECT *, g1 * sqrt((n+1)*(n+3) / (6*(n-2))) AS y, 3*(n*n+27*n-70)*(n+1)*(n+3) / ((n-2)*(n+5)*(n+7)*(n+9)) AS beta,
                 (b2 - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3) / ((n+1)*(n+1)*(n+3)*(n+5))) AS x,
                 6*(n*n-5*n+2) / ((n+7)*(n+9)) * sqrt(6*(n+3)*(n+5) / (n*(n-2)*(n-3))) AS sb FROM s),
    l AS (SELECT *, sqrt(2*(beta-1)) - 1 AS w2, 6 + 8/sb * (2/sb + sqrt(1 + 4/(sb*sb))) AS a FROM k),
    z AS (SELECT g, n, asinh(y / sqrt(2/(w2-1))) / sqrt(0.5 * ln(w2)) AS z1,
                 (1 - 2/(9*a) - sign(1 + x*sqrt(2/(a-4))) * cbrt((1 - 2/a) / abs(1 + x*sqrt(2/(a-4))))) / sqrt(2/(9*a)) AS z2 FROM l)"""


@query("WITH v AS (SELECT event_type AS g, CAST(value AS DOUBLE) AS v FROM events)," + _K_SQUARED + """
    SELECT g AS "group", CAST(n AS BIGINT) AS n, """ + r("z1*z1 + z2*z2", 3) + " AS statistic, " + r("exp(-(z1*z1 + z2*z2) / 2)") + """ AS p_value,
           exp(-(z1*z1 + z2*z2) / 2) > 0.05 AS is_normal FROM z
""")
def normality(spark, folder):
    df, schema = T.events(spark, folder)
    kinds = [{"name": k, "filter": EQ("event_type", k)} for k in ("click", "view", "purchase", "error", "signup")]
    return rounded(C.normality(df, schema, kinds, "value"), statistic=3)


@query(_T + """,
    o AS (SELECT a.g, b.c, count(l.idx) AS o FROM (SELECT DISTINCT g FROM l) a,
                 (SELECT DISTINCT p AS c FROM (SELECT dayofyear(date) AS p FROM l)) b
          LEFT JOIN (SELECT *, dayofyear(date) AS p FROM l) l ON l.g = a.g AND l.p = b.c GROUP BY ALL)
    SELECT count(*) FILTER (WHERE o < 5) AS sparse, count(*) AS cells, count(*) FILTER (WHERE o < 5) >= 0.2 * count(*) AS warn,
           (SELECT coalesce(string_agg(g || ' - ' || c || ' (' || o || ')', ', ' ORDER BY CAST(c AS VARCHAR), g), '')
            FROM (SELECT * FROM o WHERE o < 5 ORDER BY CAST(c AS VARCHAR), g LIMIT 5)) AS first FROM o
""")
def sparse_cells(spark, folder):
    """Day of year as the category: many thin cells."""
    from ..schema import CATEGORICAL, Column, TableSchema

    df, schema = T.orders(spark, folder)
    days = df.withColumn("day", F.date_format("date", "D"))
    wide = TableSchema((*schema.columns, Column("day", CATEGORICAL)))
    return C.sparse_cells(days, wide, OVERLAPPING, "day")


# Regressions.

_MEANS = "WITH g AS (SELECT status AS s, count(price_known)::DOUBLE AS n, avg(price_known) AS a, var_pop(price_known) * count(price_known) AS m2 FROM (" + ORDERS_SQL + ") GROUP BY 1)"


def _flat(model):
    return rounded(model.coefficients.select("variable", "value", "std_err", "ci_low", "ci_high"), 3)


_HC3 = "power(1 - 1 / {t}.n, 2)"


@query(_MEANS + """,
    v AS (SELECT *, m2 / power(1 - 1 / n, 2) / (n * n) AS v FROM g),
    c AS (SELECT 'Baseline' AS variable, a AS value, sqrt(v) AS se FROM v WHERE s = 'F'
          UNION ALL SELECT x.s, x.a - f.a, sqrt(x.v + f.v) FROM v x, v f WHERE x.s <> 'F' AND f.s = 'F')
    SELECT variable, """ + r("value", 3) + " AS value, " + r("se", 3) + " AS std_err, " + r("value - 1.959963984540054 * se", 3) + """ AS ci_low,
           """ + r("value + 1.959963984540054 * se", 3) + " AS ci_high FROM c")
def linear_regression_reference(spark, folder):
    """With exclusive groups the coefficients are differences of means, and HC3 has a closed form."""
    return _flat(R.linear_regression(*T.orders(spark, folder), BY_STATUS, "price_known", "relative_to_reference", "F"))


@query(_MEANS + """,
    v AS (SELECT *, m2 / power(1 - 1 / n, 2) / (n * n) AS v FROM g),
    c AS (SELECT 'Baseline' AS variable, avg(a) AS value, sqrt(sum(v)) / 3 AS se FROM v
          UNION ALL SELECT x.s, x.a - (SELECT avg(a) FROM v), sqrt(4 * x.v / 9 + (SELECT sum(o.v) FROM v o WHERE o.s <> x.s) / 9) FROM v x)
    SELECT variable, """ + r("value", 3) + " AS value, " + r("se", 3) + " AS std_err, " + r("value - 1.959963984540054 * se", 3) + """ AS ci_low,
           """ + r("value + 1.959963984540054 * se", 3) + " AS ci_high FROM c")
def linear_regression_grand_mean(spark, folder):
    """Deviations from the unweighted mean of the group means; the omitted group is put back."""
    return _flat(R.linear_regression(*T.orders(spark, folder), BY_STATUS, "price_known", "grand_mean_deviation"))


@query(_MEANS + """,
    b AS (SELECT sum(n) AS n, sum(m2) AS rss, (SELECT var_pop(price_known) * count(price_known) FROM (""" + ORDERS_SQL + """)) AS tss FROM g)
    SELECT """ + r("1 - (n - 1) / (n - 3) * rss / tss", 9) + " AS r_squared, " + r("sqrt(rss / (n - 3))", 3) + " AS rmse, "
       + r("-n / 2 * (ln(2 * pi()) + ln(rss / n) + 1)", 3) + " AS log_likelihood, "
       + r("n * (ln(2 * pi()) + ln(rss / n) + 1) + 6", 3) + " AS aic, " + r("n * (ln(2 * pi()) + ln(rss / n) + 1) + 3 * ln(n)", 3) + """ AS bic,
           2.0::DOUBLE AS model_dof, n - 3 AS residual_dof FROM b
""")
def linear_regression_fit(spark, folder):
    model = R.linear_regression(*T.orders(spark, folder), BY_STATUS, "price_known", "relative_to_reference", "F")
    fit = model.fit_evaluation.select("r_squared", "rmse", "log_likelihood", "aic", "bic", "model_dof", "residual_dof")
    return rounded(fit, 3, r_squared=9)


@query("WITH t AS (SELECT CAST(m1 AS INT) AS a, CAST(m3 AS INT) AS b, price_known AS y FROM (" + MASKS_SQL + """) WHERE price_known IS NOT NULL),
    s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy,
                 avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(y) AS sd FROM t),
    c AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s)
    SELECT 'Baseline' AS variable, """ + r("-(ma * ca + mb * cb) / sd", 7) + " AS value FROM c UNION ALL SELECT 'F orders', " + r("ca / sd", 7)
       + " FROM c UNION ALL SELECT 'urgent', " + r("cb / sd", 7) + " FROM c")
def linear_regression_overlapping(spark, folder):
    """Two overlapping groups on a standardised target: the normal equations solved by hand."""
    model = R.linear_regression(*T.orders(spark, folder), [OVERLAPPING[0], OVERLAPPING[2]], "price_known", "relative_to_baseline", standardized=True)
    return rounded(model.coefficients.select("variable", "value"), 7)


@query("WITH t AS (SELECT * FROM (" + MASKS_SQL + """) WHERE price_known IS NOT NULL),
    c AS (SELECT corr(CAST(m1 AS INT), CAST(m3 AS INT)) AS c, count(*) FILTER (WHERE m1) AS n1, count(*) FILTER (WHERE m3) AS n3 FROM t)
    SELECT 'F orders' AS name, n1 AS sample_size, """ + r("1 / (1 - c * c)", 9) + " AS vif FROM c UNION ALL SELECT 'urgent', n3, " + r("1 / (1 - c * c)", 9) + " FROM c")
def variance_inflation(spark, folder):
    model = R.linear_regression(*T.orders(spark, folder), [OVERLAPPING[0], OVERLAPPING[2]], "price_known", "relative_to_baseline")
    return rounded(model.independent_variables, 9)


_ODDS = "WITH g AS (SELECT status AS s, count(*)::DOUBLE AS n, avg(CAST(big AS INT)) AS p FROM (" + ORDERS_SQL + ") WHERE big IS NOT NULL GROUP BY 1)"


@query(_ODDS + """,
    v AS (SELECT *, ln(p / (1 - p)) AS l, 1 / (n * p * (1 - p)) AS v FROM g),
    c AS (SELECT 'Baseline' AS variable, l AS value, sqrt(v) AS se FROM v WHERE s = 'F'
          UNION ALL SELECT x.s, x.l - f.l, sqrt(x.v + f.v) FROM v x, v f WHERE x.s <> 'F' AND f.s = 'F')
    SELECT variable, """ + r("value") + " AS value, " + r("se") + " AS std_err, " + r("exp(value)") + " AS odds_ratio, "
       + r("exp(value + 1.959963984540054 * se)") + " AS odds_ci_high FROM c")
def logistic_regression_reference(spark, folder):
    """With exclusive groups the coefficients are differences of log odds."""
    model = R.logistic_regression(*T.orders(spark, folder), BY_STATUS, "big", "relative_to_reference", "F")
    return rounded(model.coefficients.select("variable", "value", "std_err", "odds_ratio", "odds_ci_high"))


@query(_ODDS + """,
    l AS (SELECT *, ln(p / (1 - p)) AS l, (SELECT sum(n) FROM g) AS t FROM g),
    e AS (SELECT x.s AS variable, (f.n + x.n) / x.t * (x.p - f.p) + o.n / x.t * (1 / (1 + exp(f.l - x.l - o.l)) - o.p) AS value
          FROM l x, l f, l o WHERE f.s = 'F' AND x.s <> 'F' AND o.s NOT IN ('F', x.s))
    SELECT variable, """ + r("value") + " AS value FROM e")
def logistic_marginal_effects(spark, folder):
    """The change from 0 to 1 in one dummy, the others left as observed, averaged over all rows."""
    model = R.logistic_regression(*T.orders(spark, folder), BY_STATUS, "big", "relative_to_reference", "F")
    return rounded(model.marginal_effects.select("variable", "value"))


@query(_ODDS + """,
    l AS (SELECT sum(n * (p * ln(p) + (1 - p) * ln(1 - p))) AS ll, sum(n) AS n, sum(n * p) / sum(n) AS q FROM g),
    f AS (SELECT *, n * (q * ln(q) + (1 - q) * ln(1 - q)) AS l0 FROM l)
    SELECT """ + r("ll", 5) + " AS log_likelihood, " + r("l0", 5) + " AS log_likelihood_null, " + r("2 * (ll - l0)", 5) + " AS log_likelihood_ratio, "
       + r("exp(ll - l0)", 5) + " AS likelihood_ratio, " + r("1 - ll / l0", 9) + " AS pseudo_r_squared, " + r("exp(l0 - ll)", 5) + " AS p_value, "
       + r("6 - 2 * ll", 5) + " AS aic, " + r("3 * ln(n) - 2 * ll", 5) + " AS bic FROM f")
def logistic_regression_fit(spark, folder):
    """Two degrees of freedom, so the p-value of the likelihood ratio is an exponential."""
    model = R.logistic_regression(*T.orders(spark, folder), BY_STATUS, "big", "relative_to_reference", "F")
    names = ("log_likelihood", "log_likelihood_null", "log_likelihood_ratio", "likelihood_ratio", "pseudo_r_squared", "p_value", "aic", "bic")
    return rounded(model.fit_evaluation.select(*names), 5, pseudo_r_squared=9)


@query()
def logistic_regression_penalized(spark, folder):
    target = {"name": "large", "filter": GT("price", 250000)}
    model = R.logistic_regression(*T.orders(spark, folder), [OVERLAPPING[0], OVERLAPPING[2]], target, "relative_to_baseline", penalty=10.0)
    return rounded(model.coefficients.select("variable", "value"))


_LEVELS = "WITH n AS (SELECT status AS s, priority_known AS c, count(*)::DOUBLE AS n FROM (" + ORDERS_SQL + ") WHERE priority_known IS NOT NULL GROUP BY ALL)"


@query(_LEVELS + """,
    l AS (SELECT a.s, a.c, ln(a.n / b.n) AS l, 1 / a.n + 1 / b.n AS v FROM n a JOIN n b ON a.s = b.s AND b.c = '3-MEDIUM' WHERE a.c <> '3-MEDIUM'),
    c AS (SELECT c AS level, 'Baseline' AS variable, l AS value, sqrt(v) AS se FROM l WHERE s = 'F'
          UNION ALL SELECT x.c, x.s, x.l - f.l, sqrt(x.v + f.v) FROM l x JOIN l f ON f.c = x.c AND f.s = 'F' WHERE x.s <> 'F')
    SELECT level, variable, """ + r("value") + " AS value, " + r("se") + " AS std_err FROM c")
def multinomial_regression(spark, folder):
    model = R.multinomial_regression(
        *T.orders(spark, folder), BY_STATUS, "priority_known", "relative_to_reference", "F", reference_level="3-MEDIUM"
    )
    return rounded(model.coefficients.select("level", "variable", "value", "std_err"))


@query(_LEVELS + """
    SELECT CASE WHEN s = 'F' THEN 'Baseline' ELSE s END AS variable, c AS level, """ + r("n / sum(n) OVER (PARTITION BY s)") + " AS prediction FROM n")
def multinomial_predictions(spark, folder):
    model = R.multinomial_regression(*T.orders(spark, folder), BY_STATUS, "priority_known", "relative_to_reference", "F")
    return rounded(model.predictions.select("variable", "level", "prediction"))


@query()
def multinomial_marginal_effects(spark, folder):
    model = R.multinomial_regression(*T.orders(spark, folder), BY_STATUS, "priority_known", "grand_mean_deviation")
    return rounded(model.marginal_effects)


_SIZES = [
    {"name": "small", "filter": {"type": "less_than", "target": "price", "value": 150000}},
    {"name": "middle", "filter": {"type": "and", "operands": [
        {"type": "greater_than_or_equal_to", "target": "price", "value": 150000}, {"type": "less_than", "target": "price", "value": 350000}]}},
    {"name": "big", "filter": {"type": "greater_than_or_equal_to", "target": "price", "value": 350000}},
]


@query()
def ordinal_regression(spark, folder):
    model = R.ordinal_regression(*T.orders(spark, folder), BY_STATUS, _SIZES, "relative_to_reference", "F")
    return rounded(model.coefficients.drop("level"))


@query()
def ordinal_thresholds(spark, folder):
    model = R.ordinal_regression(*T.orders(spark, folder), BY_STATUS, _SIZES, "relative_to_reference", "F")
    return rounded(model.thresholds)


@query("SELECT CASE WHEN price < 150000 THEN 'small' WHEN price < 350000 THEN 'middle' ELSE 'big' END AS level, count(*) AS sample_size FROM (" + ORDERS_SQL + ") GROUP BY 1")
def regression_levels(spark, folder):
    return R.ordinal_regression(*T.orders(spark, folder), BY_STATUS, _SIZES, "relative_to_reference", "F").level_info


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS level, count(*) AS sample_size FROM orders GROUP BY 1")
def regression_calendar_levels(spark, folder):
    """Years as levels, shown in the precision of the derived column."""
    model = R.multinomial_regression(*T.orders(spark, folder), BY_STATUS, "date (Year)", "relative_to_reference", "F")
    return model.level_info


@query("WITH m AS (SELECT status AS s, avg(price_known) AS a FROM (" + ORDERS_SQL + ") GROUP BY 1) SELECT o_orderkey AS idx, " + r("a", 3)
       + " AS prediction FROM orders JOIN m ON s = o_orderstatus")
def score_linear(spark, folder):
    df, schema = T.orders(spark, folder)
    model = R.linear_regression(df, schema, BY_STATUS, "price_known", "grand_mean_deviation", "O")
    return rounded(R.score(df, schema, model).select(F.col("__index").alias("idx"), "prediction"), 3)


@query(_ODDS + " SELECT o_orderkey AS idx, " + r("p", 5) + " AS prediction FROM orders JOIN g ON s = o_orderstatus")
def score_logistic(spark, folder):
    df, schema = T.orders(spark, folder)
    model = R.logistic_regression(df, schema, BY_STATUS, "big", "relative_to_reference", "P")
    return rounded(R.score(df, schema, model).select(F.col("__index").alias("idx"), "prediction"), 5)


@query("WITH t AS (" + MASKS_SQL + """)
    SELECT CAST(m1 AS INT) + 2 * CAST(m2 AS INT) + 4 * CAST(m3 AS INT)::BIGINT AS pattern, priority_known AS level, count(*)::DOUBLE AS n
    FROM t WHERE priority_known IS NOT NULL AND k > 0 GROUP BY ALL""")
def design_table(spark, folder):
    """Rows per membership pattern and level, rows in no group left out."""
    df, schema = T.orders(spark, folder)
    return design.design_table(df, schema, OVERLAPPING, "priority_known", True, ("ordered-categorical",)).drop("position")


@query("WITH v AS (SELECT status AS g, price_known AS v FROM (" + ORDERS_SQL + ") WHERE price_known IS NOT NULL)," + _K_SQUARED + """,
    p AS (SELECT g, n, exp(-(z1*z1 + z2*z2) / 2) AS p FROM z)
    SELECT g AS "group", CASE WHEN n < 30 THEN '"' || g || '" has too few rows (' || CAST(n AS BIGINT) || ') to expect a normal distribution'
        ELSE '"' || g || '" is not normally distributed (' || printf('%.2f', 100 * (1 - p)) || '%)' END AS message
    FROM p WHERE n < 30 OR p <= 0.05
""")
def normality_warnings(spark, folder):
    return C.normality_warnings(*T.orders(spark, folder), BY_STATUS, "price_known", "t")


@query(_LEVELS + """, p AS (SELECT s, c, n / sum(n) OVER (PARTITION BY s) AS p FROM n)
    SELECT o_orderkey AS idx, p.c AS level, """ + r("p", 5) + " AS p FROM orders JOIN p ON s = o_orderstatus")
def score_multinomial(spark, folder):
    df, schema = T.orders(spark, folder)
    model = R.multinomial_regression(df, schema, BY_STATUS, "priority_known", "grand_mean_deviation")
    return rounded(R.score(df, schema, model).select(F.col("__index").alias("idx"), F.inline("probabilities")), 5)


@query()
def score_ordinal(spark, folder):
    df, schema = T.orders(spark, folder)
    model = R.ordinal_regression(df, schema, BY_STATUS, _SIZES, "relative_to_reference", "F")
    return rounded(R.score(df, schema, model).select(F.col("__index").alias("idx"), "latent", F.inline("probabilities")), 5)
