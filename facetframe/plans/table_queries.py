"""Sources, fitting, inference, filters, sorting and paging."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..filters import affected_rows, filter_table, to_column
from ..operators import fit as fitting
from ..operators import infer, table
from ..schema import CATEGORICAL, CONTINUOUS, INDEX, TEXTUAL, ORDERED, TEMPORAL, Column, TableSchema
from ..session import cut_lineage, stage_folder
from ..sources import preview, prepare_source, read_csv, read_workspace, to_records, with_row_index, write_workspace
from . import tables as T
from .registry import query, r, rounded
from .tables import AND, EQ, GAPS_SQL, GT, IN, NOT, OR, ORDERS_SQL, TOPIC_DOCUMENTS_SQL


def _scratch(spark) -> str:
    """A new folder below the cluster's shared folder."""
    return f"{stage_folder(spark)}/{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def csv_scan(spark, folder):
    path = _scratch(spark)
    part = T.load(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    part.write.option("header", True).option("sep", ";").csv(path)
    rows = prepare_source(read_csv(spark, path, delimiter=";")).drop(INDEX)
    return rows.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("SELECT doc_id, text, lang FROM documents")
def csv_with_texts(spark, folder):
    """Whole texts through CSV: line breaks, quotes and delimiters inside cells."""
    path = _scratch(spark)
    docs = T.load(spark, folder, "documents").select("doc_id", "text", "lang")
    docs.write.option("header", True).option("sep", ";").option("escape", '"').option("quoteAll", True).csv(path)
    return prepare_source(read_csv(spark, path, delimiter=";")).drop(INDEX)


@query("SELECT doc_id, text, lang, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents")
def csv_in_ranges(spark, folder):
    """The same through ranges of at most 64 kB, with the rows' places in the file."""
    path = _scratch(spark)
    docs = T.load(spark, folder, "documents").select("doc_id", "text", "lang")
    rows = docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")
    rows.write.option("header", True).option("sep", ";").option("escape", '"').option("quoteAll", True).csv(path)
    # A task reads many ranges: the tasks follow the session's slots, not the size of the file.
    wanted = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.maxPartitionNum": str(4 * spark.sparkContext.defaultParallelism)}
    settings = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        made = read_csv(spark, path, delimiter=";", split_quoted=True, number="place")
        return cut_lineage(made)
    finally:
        for name, value in settings.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


@query("SELECT idx, status, price, priority_known, CAST(year(date) AS INTEGER) AS y FROM (" + ORDERS_SQL + ")")
def workspace_round_trip(spark, folder):
    df, schema = T.orders(spark, folder)
    path = _scratch(spark)
    write_workspace(df, schema, path)
    back, restored = read_workspace(spark, path)
    assert restored.get("priority").categories == T.PRIORITIES
    return back.select(
        F.col(INDEX).alias("idx"), "status", "price", "priority_known", F.year(F.col("`date (Year)`")).alias("y")
    )


@query("""
    SELECT c_custkey AS idx, c_name, c_acctbal, (SELECT count(*) FROM customer) AS total_rows
    FROM customer ORDER BY c_custkey LIMIT 15
""")
def dataset_preview(spark, folder):
    df = with_row_index(T.load(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")
    return preview(df).select(F.col(INDEX).alias("idx"), "c_name", "c_acctbal", "total_rows")


@query("""
    SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name, 'segment': nullif(c_mktsegment, 'BUILDING')})::VARCHAR AS record
    FROM customer
""")
def row_records(spark, folder):
    df = T.load(spark, folder, "customer")
    return to_records(df.select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")))


@query("""
    SELECT event_id AS idx, strftime(date_trunc('year', ts), '%Y-%m-%d') AS year,
           strftime(date_trunc('month', ts), '%Y-%m-%d') AS month,
           strftime(CAST(date_trunc('day', ts) AS TIMESTAMP) + CASE
               WHEN epoch_us(ts) % 86400000000 > 43200000000 THEN INTERVAL 1 DAY
               WHEN epoch_us(ts) % 86400000000 = 43200000000 AND (epoch_us(ts) // 86400000000) % 2 = 1 THEN INTERVAL 1 DAY
               ELSE INTERVAL 0 DAY END, '%Y-%m-%d') AS date,
           monthname(ts) AS monthly, dayname(ts) AS day_of_week, strftime(ts, '%H:00') AS hour
    FROM events
""")
def temporal_features(spark, folder):
    df, _ = T.events(spark, folder)
    day = lambda n: F.date_format(F.col(f"`ts ({n})`"), "yyyy-MM-dd")
    return df.select(
        F.col(INDEX).alias("idx"), day("Year").alias("year"), day("Month").alias("month"), day("Date").alias("date"),
        F.col("`ts (Monthly)`").alias("monthly"), F.col("`ts (Day of Week)`").alias("day_of_week"),
        F.col("`ts (Hour)`").alias("hour"),
    )


@query("""
    SELECT event_id AS idx, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events
""")
def temporal_parsing(spark, folder):
    """Text in a declared format; what does not parse is NULL."""
    ts = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    raw = T.load(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "not a date").otherwise(ts).alias("when"))
    df, _ = fitting.fit(
        with_row_index(raw, "event_id"), TableSchema.of(Column("when", TEMPORAL, datetime_format="%d/%m/%Y %H:%M:%S"))
    )
    return df.select(F.col(INDEX).alias("idx"), F.date_format("when", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("""
    WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1)
    SELECT p_partkey AS idx, CASE WHEN n >= 32 THEN part.p_name END AS name FROM part JOIN c ON part.p_name = c.p_name
""")
def rare_categories(spark, folder):
    raw = with_row_index(T.load(spark, folder, "part"), "p_partkey")
    df, _ = fitting.fit(raw, TableSchema.of(Column("p_name", CATEGORICAL, min_frequency=32)))
    return df.select(F.col(INDEX).alias("idx"), F.col("p_name").alias("name"))


@query("""
    WITH v AS (SELECT DISTINCT p_type AS category FROM part), d(category, place) AS (VALUES ('STANDARD', 0), ('PROMO', 1), ('NO SUCH TYPE', 2))
    SELECT v.category, row_number() OVER (ORDER BY coalesce(place, -1), v.category) - 1 AS position
    FROM v LEFT JOIN d ON v.category = d.category
""")
def category_order(spark, folder):
    """Undeclared categories first, sorted; then the declared ones that occur."""
    raw = T.load(spark, folder, "part")
    df, schema = fitting.fit(raw, TableSchema.of(Column("p_type", ORDERED, category_order=("STANDARD", "PROMO", "NO SUCH TYPE"))))
    dimension = fitting.category_dimension(df, schema, "p_type")
    return dimension.select("category", F.col("position").cast("long").alias("position"))


@query("""
    SELECT s_suppkey AS idx, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon
    FROM (SELECT idx AS s_suppkey, lat, lon FROM (""" + T.SUPPLIERS_SQL + "))")
def geospatial_fit(spark, folder):
    df, _ = T.suppliers(spark, folder)
    return df.select(F.col(INDEX).alias("idx"), "lat", "lon")


@query("SELECT o_orderkey AS idx, o_totalprice AS price, o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
def selective_refit(spark, folder):
    """The status column becomes categorical; everything else keeps its fitted values."""
    source = with_row_index(T.load(spark, folder, "orders"), "o_orderkey")
    columns = [Column("o_totalprice", CONTINUOUS), Column("o_orderdate", TEMPORAL, temporal_features=("year",))]
    before = TableSchema.of(*columns, Column("o_orderstatus", TEXTUAL))
    workspace, fitted = fitting.fit(source, before)
    after, _ = fitting.refit(fitted, TableSchema.of(*columns, Column("o_orderstatus", CATEGORICAL)), workspace, source)
    return after.select(
        F.col(INDEX).alias("idx"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
        F.year("`o_orderdate (Year)`").alias("y"),
    )


@query("""
    WITH s AS (SELECT count(*) AS n, count(DISTINCT text) AS dt, count(DISTINCT lang) AS dl, count(DISTINCT source) AS ds,
                      avg(length(text)) AS lt, avg(length(lang)) AS ll, avg(length(source)) AS ls FROM documents)
    SELECT 'doc_id' AS name, 'continuous' AS type, n AS count FROM s
    UNION ALL SELECT 'text', CASE WHEN dt < 0.1 * n THEN 'categorical' WHEN lt >= 20 THEN 'textual' ELSE 'unique' END, n FROM s
    UNION ALL SELECT 'lang', CASE WHEN dl < 0.1 * n THEN 'categorical' WHEN ll >= 20 THEN 'textual' ELSE 'unique' END, n FROM s
    UNION ALL SELECT 'source', CASE WHEN ds < 0.1 * n THEN 'categorical' WHEN ls >= 20 THEN 'textual' ELSE 'unique' END, n FROM s
    UNION ALL SELECT 'n_chars', 'continuous', n FROM s
""")
def infer_column_types(spark, folder):
    return infer.infer_schema(T.load(spark, folder, "documents"))


_DESCRIBE = """
    WITH t AS ({source}), q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM t)
    SELECT count(v) AS count, """ + r("avg(v)", 4) + " AS mean, " + r("any_value(q2)", 4) + " AS median, " + r("stddev_samp(v)", 4) + """ AS std,
           """ + r("min(v)", 4) + " AS min, " + r("any_value(q1)", 4) + " AS q1, " + r("any_value(q3)", 4) + " AS q3, " + r("max(v)", 4) + """ AS max,
           """ + r("any_value(q1 - 1.5 * (q3 - q1))", 4) + " AS inlier_low, " + r("any_value(q3 + 1.5 * (q3 - q1))", 4) + """ AS inlier_high,
           count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count
    FROM t, q WHERE v IS NOT NULL
"""


@query(_DESCRIBE.format(source="SELECT CAST(length(text) AS DOUBLE) AS v FROM documents"))
def profile_text_column(spark, folder):
    return rounded(infer.profile_column(T.load(spark, folder, "documents"), "text", TEXTUAL), 4)


@query(_DESCRIBE.format(source="SELECT CAST(p_size AS DOUBLE) AS v FROM part"))
def profile_continuous_column(spark, folder):
    return rounded(infer.profile_column(T.load(spark, folder, "part"), "p_size", CONTINUOUS), 4)


@query("SELECT nullif(p_brand, 'Brand#2') AS category, count(*) AS count FROM part WHERE p_brand <> 'Brand#2' GROUP BY 1")
def profile_ordered_column(spark, folder):
    part = T.load(spark, folder, "part").select(F.nullif("p_brand", F.lit("Brand#2")).alias("brand"))
    return infer.profile_column(part, "brand", ORDERED)


# Filters. Each query counts and lists the rows that pass.


def _kept(df, schema, flt):
    return filter_table(df, schema, flt).select(F.col(INDEX).alias("idx"), "status", "price_known")


def _rows_where(condition: str) -> str:
    return "SELECT idx, status, price_known FROM (" + ORDERS_SQL + f") WHERE {condition}"


@query(_rows_where("NOT coalesce(price_known > 400000, FALSE)"))
def filter_not_keeps_nulls(spark, folder):
    return _kept(*T.orders(spark, folder), NOT(GT("price_known", 400000)))


@query("SELECT count(*) AS with_or, count(*) AS with_and, 0::BIGINT AS with_not_or, 0::BIGINT AS with_no_values FROM orders")
def filter_empty_operands(spark, folder):
    df, schema = T.orders(spark, folder)
    return df.agg(
        F.count_if(to_column(OR(), schema)).alias("with_or"), F.count_if(to_column(AND(), schema)).alias("with_and"),
        F.count_if(to_column(NOT(OR()), schema)).alias("with_not_or"),
        F.count_if(to_column(IN("status"), schema)).alias("with_no_values"),
    )


@query(_rows_where("(status = 'F' AND NOT coalesce(status_known = 'O' OR price_known < 100000, FALSE)) OR coalesce(big, FALSE)"))
def filter_nested(spark, folder):
    low = {"type": "less_than", "target": "price_known", "value": 100000}
    flt = OR(AND(EQ("status", "F"), NOT(OR(EQ("status_known", "O"), low))), {"type": "is_true", "target": "big"})
    return _kept(*T.orders(spark, folder), flt)


@query(_rows_where("priority_known IN ('4-NOT SPECIFIED', '5-LOW') AND NOT coalesce(priority IN ('1-URGENT'), FALSE)"))
def filter_ordered_category(spark, folder):
    at_most = {"type": "less_than_or_equal_to", "target": "priority", "value": "1-URGENT"}
    return _kept(*T.orders(spark, folder), AND(GT("priority_known", "3-MEDIUM"), NOT(at_most)))


@query(_rows_where("date >= TIMESTAMP '1997-06-01 00:00:00' AND date < TIMESTAMP '1999-01-01 00:00:00'"))
def filter_temporal_range(spark, folder):
    since = {"type": "greater_than_or_equal_to", "target": "date", "value": "1997-06-01T00:00:00Z"}
    until = {"type": "less_than", "target": "date", "value": "1999-01-01"}
    return _kept(*T.orders(spark, folder), AND(since, until))


@query(_rows_where("status_known IS NULL AND price_known IS NOT NULL AND NOT (price_known IS NOT NULL AND price > 300000)"))
def filter_empty_values(spark, folder):
    flt = AND({"type": "empty", "target": "status_known"}, {"type": "not_empty", "target": "price_known"},
              NOT(AND({"type": "not_empty", "target": "price_known"}, GT("price", 300000))))
    return _kept(*T.orders(spark, folder), flt)


@query(_rows_where("status_known IN ('F', 'O') AND NOT coalesce(priority_known IN ('1-URGENT', '5-LOW'), FALSE)"))
def filter_is_one_of(spark, folder):
    return _kept(*T.orders(spark, folder), AND(IN("status_known", "F", "O"), NOT(IN("priority_known", "1-URGENT", "5-LOW"))))


@query("""
    SELECT count(*) FILTER (WHERE big) AS is_true, count(*) FILTER (WHERE NOT big) AS is_false,
           count(*) FILTER (WHERE NOT coalesce(big, FALSE)) AS not_true, count(*) FILTER (WHERE coalesce(big, TRUE)) AS not_false
    FROM (""" + ORDERS_SQL + ")")
def filter_flags(spark, folder):
    df, schema = T.orders(spark, folder)
    yes, no = {"type": "is_true", "target": "big"}, {"type": "is_false", "target": "big"}
    return df.agg(*[
        F.count_if(to_column(f, schema)).alias(n)
        for n, f in (("is_true", yes), ("is_false", no), ("not_true", NOT(yes)), ("not_false", NOT(no)))
    ])


@query("SELECT idx, lang FROM (" + GAPS_SQL + ") WHERE regexp_matches(text, '[Tt]he .*ing') AND NOT coalesce(regexp_matches(source, '1$'), FALSE)")
def filter_has_text(spark, folder):
    df, schema = T.documents_with_gaps(spark, folder)
    found = {"type": "has_text", "target": "text", "value": "[Tt]he .*ing"}
    kept = filter_table(df, schema, AND(found, NOT({"type": "has_text", "target": "source", "value": "1$"})))
    return kept.select(F.col(INDEX).alias("idx"), "lang")


@query("SELECT idx FROM (" + ORDERS_SQL + ") WHERE status = 'P' AND price > 450000")
def affected_row_ids(spark, folder):
    df, schema = T.orders(spark, folder)
    return affected_rows(df, schema, AND(EQ("status", "P"), GT("price", 450000))).withColumnRenamed(INDEX, "idx")


# Sorting and paging. The order is made visible as a position.


def _positions(page, offset=0):
    rows = page.collect()  # one page
    spark = page.sparkSession
    return spark.createDataFrame([(offset + i, row[INDEX]) for i, row in enumerate(rows)], "place int, idx long")


def _page_sql(order: str, page: int, limit: int, where: str = "TRUE") -> str:
    return f"""
        SELECT CAST(place AS INTEGER) AS place, idx FROM (
            SELECT row_number() OVER (ORDER BY {order}, idx) - 1 AS place, idx FROM ({ORDERS_SQL}) WHERE {where})
        WHERE place >= {page * limit} AND place < {(page + 1) * limit}"""


@query(_page_sql("big DESC NULLS LAST", 0, 40))
def sort_boolean(spark, folder):
    df, schema = T.orders(spark, folder)
    return _positions(table.paginate(df, schema, sort=("big", True), limit=40))


@query(_page_sql("price_known DESC NULLS LAST", 3, 25, "status = 'F'"))
def page_of_sorted_rows(spark, folder):
    df, schema = T.orders(spark, folder)
    return _positions(table.paginate(df, schema, EQ("status", "F"), ("price_known", False), page=3, limit=25), 75)


@query("""
    SELECT idx, ROW_NUMBER() OVER (ORDER BY l_returnflag DESC NULLS LAST, idx) - 1 + 20000 AS place FROM (
        SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS idx FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)
        ORDER BY l_returnflag DESC NULLS LAST, idx LIMIT 40 OFFSET 20000) x
""")
def deep_page(spark, folder):
    """A page far into a table that is sorted by three values only: one range of it is read and sorted."""
    items = T.load(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    df = cut_lineage(items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(INDEX), "flag"))
    schema = TableSchema.of(Column("flag", CATEGORICAL))
    return _positions(table.paginate(df, schema, sort=("flag", False), page=500, limit=40), 20000)


@query(_page_sql("priority_known ASC NULLS LAST", 2, 30))
def sort_ordered_category(spark, folder):
    df, schema = T.orders(spark, folder)
    return _positions(table.paginate(df, schema, sort=("priority_known", True), page=2, limit=30), 60)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 15.0) AS BIGINT) AS pages FROM orders WHERE o_orderstatus = 'O'")
def page_meta(spark, folder):
    return table.page_meta(*T.orders(spark, folder), EQ("status", "O"))


@query("SELECT idx, topic FROM (" + TOPIC_DOCUMENTS_SQL + ") WHERE topic <> -1")
def valid_rows_of_topic(spark, folder):
    df, schema = T.topic_documents(spark, folder)
    rows = table.valid_rows(df, schema, "text (Topic)")
    return rows.select(F.col(INDEX).alias("idx"), F.col("`text (Topic)`").alias("topic"))


@query("""
    WITH l AS (SELECT id, 'Theme ' || (id % 3) || CASE WHEN id // 3 > 0 THEN ' (' || (id // 3 + 1) || ')' ELSE '' END AS label
               FROM (SELECT DISTINCT label AS id FROM embeddings WHERE label <> 9))
    SELECT idx, l.label AS topic FROM (""" + TOPIC_DOCUMENTS_SQL + """) t LEFT JOIN l ON l.id = t.topic
""")
def display_topic_labels(spark, folder):
    df, schema = T.topic_documents(spark, folder)
    shown = table.display_column(df, schema, "text (Topic)", T.topic_table(spark, folder))
    return shown.select(F.col(INDEX).alias("idx"), F.col("`text (Topic)`").alias("topic"))


@query("SELECT idx, CASE WHEN big THEN 'True' WHEN NOT big THEN 'False' END AS big FROM (" + ORDERS_SQL + ")")
def display_boolean(spark, folder):
    df, schema = T.orders(spark, folder)
    return table.display_column(df, schema, "big").select(F.col(INDEX).alias("idx"), "big")


@query("SELECT idx, price_known FROM (" + ORDERS_SQL + ") WHERE price_known IS NOT NULL AND status = 'O'")
def column_values(spark, folder):
    df, schema = T.orders(spark, folder)
    return table.column_values(df, schema, "price_known", EQ("status", "O")).withColumnRenamed(INDEX, "idx")


@query("SELECT DISTINCT priority_known AS value FROM (" + ORDERS_SQL + ") WHERE priority_known IS NOT NULL AND price > 100000")
def unique_values(spark, folder):
    df, schema = T.orders(spark, folder)
    return table.unique_values(df, schema, "priority_known", GT("price", 100000)).withColumnRenamed("priority_known", "value")
