"""Column profiles and group counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups, profile
from ..operators.fit import fit
from ..schema import CATEGORICAL, INDEX, Column, TableSchema
from . import tables as T
from .registry import query, r, rounded
from .tables import AND, BY_STATUS, DOCUMENTS_SQL, EQ, GT, IN, NOT, ORDERS_SQL, OVERLAPPING, SUPPLIERS_SQL, TOPIC_DOCUMENTS_SQL


@query("""
    SELECT o_orderpriority AS category, """ + r("avg(o_totalprice)", 4) + """ AS value
    FROM orders WHERE NOT coalesce(o_orderstatus = 'F', FALSE) AND o_orderdate > TIMESTAMP '1997-01-01 00:00:00' GROUP BY 1
""")
def aggregate_mean_filtered(spark, folder):
    df, schema = T.orders(spark, folder)
    flt = AND(NOT(EQ("status", "F")), GT("date", "1997-01-01T00:00:00Z"))
    return rounded(profile.aggregate_values(df, schema, "price", "priority", "mean", flt), 4)


def _aggregate(method: str, sql: str):
    @query("SELECT status_known AS category, " + r(sql, 2) + " AS value FROM (" + ORDERS_SQL + ") WHERE status_known IS NOT NULL GROUP BY 1")
    def run(spark, folder):
        df, schema = T.orders(spark, folder)
        return rounded(profile.aggregate_values(df, schema, "price_known", "status_known", method), 2)

    return run


def _register_aggregates():
    from .registry import ORACLES, QUERIES

    for method, sql in (("sum", "coalesce(sum(price_known), 0)"), ("median", "median(price_known)"),
                        ("std", "stddev_samp(price_known)"), ("max", "max(price_known)"), ("min", "min(price_known)")):
        _aggregate(method, sql)
        QUERIES[f"aggregate_{method}"], ORACLES[f"aggregate_{method}"] = QUERIES.pop("run"), ORACLES.pop("run")


_register_aggregates()


@query("""
    WITH d AS (SELECT DISTINCT l_shipdate AS k FROM lineitem)
    SELECT l_returnflag AS category, """ + r("median(l_extendedprice)", 4) + """ AS value FROM lineitem GROUP BY 1
""")
def aggregate_median_lineitem(spark, folder):
    df, schema = T.lineitem(spark, folder)
    return rounded(profile.aggregate_values(df, schema, "l_extendedprice", "l_returnflag", "median"), 4)


@query("""
    SELECT d.category, count(t.idx) AS frequency FROM (SELECT DISTINCT priority_known AS category FROM (""" + ORDERS_SQL + """)) d
    LEFT JOIN (SELECT * FROM (""" + ORDERS_SQL + """) WHERE priority IN ('1-URGENT', '2-HIGH')) t ON t.priority_known = d.category
    WHERE d.category IS NOT NULL GROUP BY 1
""")
def frequency_distribution(spark, folder):
    """Categories without a row under the filter are listed with 0."""
    df, schema = T.orders(spark, folder)
    return profile.frequency_distribution(df, schema, "priority_known", IN("priority", "1-URGENT", "2-HIGH"))


@query("SELECT CASE WHEN big THEN 'True' ELSE 'False' END AS category, count(*) AS frequency FROM (" + ORDERS_SQL + ") WHERE big IS NOT NULL GROUP BY 1")
def frequency_distribution_boolean(spark, folder):
    return profile.frequency_distribution(*T.orders(spark, folder), "big")


@query("SELECT event_type AS category, count(*) AS frequency FROM events WHERE value > 5 GROUP BY 1")
def frequency_distribution_events(spark, folder):
    df, schema = T.events(spark, folder)
    return profile.frequency_distribution(df, schema, "event_type", GT("value", 5))


@query("SELECT status_known AS y, priority_known AS x, count(*) AS frequency FROM (" + ORDERS_SQL + ") WHERE status_known IS NOT NULL AND priority_known IS NOT NULL GROUP BY 1, 2")
def paired_values(spark, folder):
    return profile.paired_values(*T.orders(spark, folder), "status_known", "priority_known")


@query("SELECT CASE WHEN big THEN 'True' ELSE 'False' END AS y, status_known AS x, count(*) AS frequency FROM (" + ORDERS_SQL + ") WHERE big IS NOT NULL AND status_known IS NOT NULL GROUP BY 1, 2")
def paired_values_of_flags(spark, folder):
    return profile.paired_values(*T.orders(spark, folder), "big", "status_known")


@query("""
    WITH l AS (SELECT id, 'Theme ' || (id % 3) || CASE WHEN id // 3 > 0 THEN ' (' || (id // 3 + 1) || ')' ELSE '' END AS label
               FROM (SELECT DISTINCT label AS id FROM embeddings WHERE label <> 9))
    SELECT l.label AS y, lang AS x, count(*) AS frequency FROM (""" + TOPIC_DOCUMENTS_SQL + """) t JOIN l ON l.id = t.topic GROUP BY 1, 2
""")
def paired_values_of_topics(spark, folder):
    df, schema = T.topic_documents(spark, folder)
    return profile.paired_values(df, schema, "text (Topic)", "lang", topics=T.topic_table(spark, folder))


@query("""
    WITH k AS (SELECT status_known AS s, lang_of AS l FROM (SELECT status_known, CASE WHEN price > 200000 THEN 'dear' ELSE 'cheap' END AS lang_of FROM (""" + ORDERS_SQL + """)))
    SELECT a.s AS y, b.l AS x, count(k.s) AS frequency FROM (SELECT DISTINCT s FROM k WHERE s IS NOT NULL) a, (SELECT DISTINCT l FROM k) b
    LEFT JOIN k ON k.s = a.s AND k.l = b.l GROUP BY 1, 2
""")
def paired_plain_categories_with_empty(spark, folder):
    """Plain categories come with the fitted schema."""
    df, _ = T.orders(spark, folder)
    raw = df.select(INDEX, "status_known", F.when(F.col("price") > 200000, "dear").otherwise("cheap").alias("band"))
    fitted, schema = fit(raw, TableSchema.of(Column("status_known", CATEGORICAL), Column("band", CATEGORICAL)))
    return profile.paired_values(fitted, schema, "status_known", "band", include_empty=True)


@query("""
    WITH c AS (SELECT DISTINCT o_orderpriority AS p FROM orders)
    SELECT a.p AS y, b.p AS x, count(t.idx) AS frequency FROM c a, c b
    LEFT JOIN (""" + ORDERS_SQL + """) t ON t.priority = a.p AND t.priority_known = b.p GROUP BY 1, 2
""")
def paired_values_with_empty(spark, folder):
    return profile.paired_values(*T.orders(spark, folder), "priority", "priority_known", include_empty=True)


_COUNTS = """
    SELECT count(*) AS total, count(*) FILTER (WHERE {f}) AS inside, count(*) FILTER (WHERE NOT {f}) AS outside,
           count(*) FILTER (WHERE {f} AND {v}) AS valid, count(*) FILTER (WHERE {f} AND NOT {v}) AS invalid,
           {o} AS outlier, {t} AS "true", {n} AS "false"
    FROM ({table})
"""


@query(_COUNTS.format(f="(status = 'F')", v="(price_known IS NOT NULL)", o="NULL::BIGINT", t="NULL::BIGINT", n="NULL::BIGINT", table=ORDERS_SQL))
def column_counts(spark, folder):
    return profile.column_counts(*T.orders(spark, folder), "price_known", EQ("status", "F"))


@query(_COUNTS.format(f="(status = 'F')", v="(big IS NOT NULL)", o="NULL::BIGINT", t="count(*) FILTER (WHERE status = 'F' AND big)",
                      n="count(*) FILTER (WHERE status = 'F' AND NOT big)", table=ORDERS_SQL))
def column_counts_boolean(spark, folder):
    return profile.column_counts(*T.orders(spark, folder), "big", EQ("status", "F"))


@query(_COUNTS.format(f="(lang = 'en')", v="(coalesce(topic, -1) <> -1)", o="count(*) FILTER (WHERE lang = 'en' AND topic = -1)",
                      t="NULL::BIGINT", n="NULL::BIGINT", table=TOPIC_DOCUMENTS_SQL))
def column_counts_topic(spark, folder):
    return profile.column_counts(*T.topic_documents(spark, folder), "text (Topic)", EQ("lang", "en"))


from .table_queries import _DESCRIBE  # noqa: E402


@query(_DESCRIBE.format(source="SELECT l_extendedprice AS v FROM lineitem WHERE l_returnflag = 'A'"))
def descriptive_statistics(spark, folder):
    df, schema = T.lineitem(spark, folder)
    return rounded(profile.descriptive_statistics(df, schema, "l_extendedprice", EQ("l_returnflag", "A")), 4)


@query(_DESCRIBE.format(source="SELECT value AS v FROM events"))
def descriptive_statistics_events(spark, folder):
    """A skewed column, so that some values lie outside the inlier range."""
    df, schema = T.events(spark, folder)
    return rounded(profile.descriptive_statistics(df, schema, "value"), 4)


_PLACES = "(" + SUPPLIERS_SQL + ") WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2"
_PLACE = "CAST(lat AS DOUBLE) AS latitude, CAST(lon AS DOUBLE) AS longitude"
_LABEL = "coalesce(arg_min(name, idx) FILTER (WHERE name IS NOT NULL), 'Unnamed Location') AS label"


@query(f"SELECT {_PLACE}, CAST(count(*) AS DOUBLE) AS value, {_LABEL} FROM {_PLACES}")
def geo_points(spark, folder):
    return profile.geo_points(*T.suppliers(spark, folder), "lat", "lon", "name")


@query(f"SELECT {_PLACE}, {r('median(balance)', 4)} AS value, {_LABEL} FROM {_PLACES}")
def geo_aggregate_median(spark, folder):
    return rounded(profile.geo_aggregate(*T.suppliers(spark, folder), "lat", "lon", "balance", "median", "name"), 4)


@query(f"SELECT {_PLACE}, {r('coalesce(stddev_samp(balance), 0)', 4)} AS value FROM {_PLACES}")
def geo_aggregate_std(spark, folder):
    return rounded(profile.geo_aggregate(*T.suppliers(spark, folder), "lat", "lon", "balance", "std"), 4)


# Groups.

# Row-wise membership of the overlapping groups.
MASKS_SQL = "SELECT *, status = 'F' AS m1, price > 250000 AS m2, priority IN ('1-URGENT', '2-HIGH') AS m3, " \
    "CAST(status = 'F' AS INT) + CAST(price > 250000 AS INT) + CAST(priority IN ('1-URGENT', '2-HIGH') AS INT) AS k FROM (" + ORDERS_SQL + ")"
LONG_SQL = "SELECT 'F orders' AS g, * FROM t WHERE m1 UNION ALL SELECT 'large', * FROM t WHERE m2 UNION ALL SELECT 'urgent', * FROM t WHERE m3"


@query("WITH t AS (" + MASKS_SQL + "), l AS (" + LONG_SQL + """)
    SELECT g AS "group", value, count(*) AS n FROM (SELECT g, status_known AS value FROM l WHERE k = 1 AND status_known IS NOT NULL) GROUP BY ALL
""")
def extracted_groups(spark, folder):
    df, schema = T.orders(spark, folder)
    long = groups.extract_groups(df, schema, OVERLAPPING, "status_known", exclude_overlapping=True)
    return long.groupBy("group", "value").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (" + MASKS_SQL + "), l AS (" + LONG_SQL + """)
    SELECT g AS "group", count(*) FILTER (WHERE price_known IS NULL) AS empty_count,
           count(*) FILTER (WHERE price_known IS NOT NULL AND k = 1) AS valid_count,
           count(*) FILTER (WHERE price_known IS NOT NULL AND k > 1) AS overlap_count,
           (SELECT count(*) FROM orders) AS total_count
    FROM l GROUP BY 1
""")
def group_info_excluding_overlap(spark, folder):
    return groups.group_info(*T.orders(spark, folder), OVERLAPPING, "price_known", True).drop("gid")


@query("WITH t AS (SELECT * FROM (" + MASKS_SQL + """) WHERE price_known IS NOT NULL)
    SELECT 'F orders' AS group1, 'large' AS group2, count(*) FILTER (WHERE m1 AND m2) AS overlap_count FROM t
    UNION ALL SELECT 'F orders', 'urgent', count(*) FILTER (WHERE m1 AND m3) FROM t
    UNION ALL SELECT 'large', 'urgent', count(*) FILTER (WHERE m2 AND m3) FROM t
""")
def group_overlaps(spark, folder):
    return groups.overlaps(*T.orders(spark, folder), OVERLAPPING, "price_known")


@query("WITH t AS (" + MASKS_SQL + """)
    SELECT 'F orders' AS "group", 'warning' AS level, count(*) FILTER (WHERE m1 AND m2) || ' rows are in both "F orders" and "large"' AS message FROM t
    UNION ALL SELECT 'F orders', 'warning', count(*) FILTER (WHERE m1 AND m3) || ' rows are in both "F orders" and "urgent"' FROM t
    UNION ALL SELECT 'large', 'warning', count(*) FILTER (WHERE m2 AND m3) || ' rows are in both "large" and "urgent"' FROM t
    UNION ALL SELECT 'none', 'error', '"none" has no valid rows'
""")
def group_warnings(spark, folder):
    empty = {"name": "none", "filter": GT("price", 10_000_000)}
    return groups.group_warnings(*T.orders(spark, folder), [*OVERLAPPING, empty], "price")


def _cooccurrence_sql() -> str:
    names = ("F orders", "large", "urgent")
    parts = []
    for i, a in enumerate(names, 1):
        for j, b in enumerate(names, 1):
            parts.append(
                f"SELECT '{a}' AS group1, '{b}' AS group2, count(*) FILTER (WHERE m{i}) AS frequency1, "
                f"count(*) FILTER (WHERE m{j}) AS frequency2, count(*) FILTER (WHERE m{i} AND m{j}) AS cooccurrence, "
                + r(f"corr(CAST(m{i} AS INT), CAST(m{j} AS INT))") + " AS correlation FROM t"
            )
    return "WITH t AS (" + MASKS_SQL + ") " + " UNION ALL ".join(parts)


@query(_cooccurrence_sql())
def cooccurrence(spark, folder):
    return rounded(groups.cooccurrence(*T.orders(spark, folder), OVERLAPPING))


_LINE_GROUPS = [
    {"name": f"{kind} {n}", "filter": f} for kind, n, f in (
        ("quantity above", 10, GT("l_quantity", 10)), ("quantity above", 25, GT("l_quantity", 25)),
        ("quantity above", 40, GT("l_quantity", 40)), ("discount above", 0.05, GT("l_discount", 0.05)),
        ("flag", "A", EQ("l_returnflag", "A")), ("flag", "N", EQ("l_returnflag", "N")),
        ("status", "O", EQ("l_linestatus", "O")), ("price above", 50000, GT("l_extendedprice", 50000)),
    )
]


@query("""
    WITH t AS (SELECT [l_quantity > 10, l_quantity > 25, l_quantity > 40, l_discount > 0.05, l_returnflag = 'A',
                       l_returnflag = 'N', l_linestatus = 'O', l_extendedprice > 50000] AS m FROM lineitem),
         n AS (SELECT unnest(['quantity above 10', 'quantity above 25', 'quantity above 40', 'discount above 0.05', 'flag A',
                              'flag N', 'status O', 'price above 50000']) AS name, unnest(range(1, 9)) AS i)
    SELECT a.name AS group1, b.name AS group2, count(*) FILTER (WHERE m[a.i]) AS frequency1,
           count(*) FILTER (WHERE m[b.i]) AS frequency2, count(*) FILTER (WHERE m[a.i] AND m[b.i]) AS cooccurrence,
           """ + r("corr(CAST(m[a.i] AS INT), CAST(m[b.i] AS INT))") + """ AS correlation
    FROM t, n a, n b GROUP BY 1, 2
""")
def cooccurrence_of_eight_groups(spark, folder):
    return rounded(groups.cooccurrence(*T.lineitem(spark, folder), _LINE_GROUPS))


def contingency_sql(where: str = "TRUE") -> str:
    return "WITH t AS (SELECT * FROM (" + MASKS_SQL + f") WHERE priority_known IS NOT NULL AND {where}), l AS (" + LONG_SQL + """),
        o AS (SELECT a.g, b.v, count(l.idx) AS o FROM (SELECT DISTINCT g FROM l) a, (SELECT DISTINCT priority_known AS v FROM t) b
              LEFT JOIN l ON l.g = a.g AND l.priority_known = b.v GROUP BY ALL),
        e AS (SELECT g, v, o, sum(o) OVER (PARTITION BY g) * sum(o) OVER (PARTITION BY v) / sum(o) OVER ()::DOUBLE AS e FROM o)
        SELECT g AS "group", v AS value, o AS observed, """ + r("e", 5) + " AS expected, " + r("o - e", 5) + """ AS residual,
               """ + r("(o - e) / sqrt(e)", 5) + " AS standardized_residual FROM e"


@query(contingency_sql())
def contingency_table(spark, folder):
    return rounded(groups.contingency_table(*T.orders(spark, folder), OVERLAPPING, "priority_known"), 5)


@query(contingency_sql("k <= 1"))
def contingency_table_excluding_overlap(spark, folder):
    return rounded(groups.contingency_table(*T.orders(spark, folder), OVERLAPPING, "priority_known", True), 5)


@query("SELECT TRUE AS by_status, (SELECT count(*) = 0 FROM (" + MASKS_SQL + ") WHERE k <> 1) AS overlapping")
def mutual_exclusivity(spark, folder):
    df, schema = T.orders(spark, folder)
    a = groups.is_mutually_exclusive(df, schema, BY_STATUS).select(F.col("mutually_exclusive").alias("by_status"))
    b = groups.is_mutually_exclusive(df, schema, OVERLAPPING).select("mutually_exclusive").scalar()
    return a.withColumn("overlapping", b)
