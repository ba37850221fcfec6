"""The given tables with semantic roles, fitted. NULLs and flags are derived from row keys.

Each ``*_SQL`` constant is the same table as a SQL expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fit import fit
from ..schema import (
    BOOLEAN, CATEGORICAL, CONTINUOUS, GEOSPATIAL, INDEX, ORDERED, TEMPORAL, TEXTUAL, TOPIC, UNIQUE, Column, TableSchema,
)
from ..sources import read_parquet, with_row_index

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")


def load(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """Read a table. ``spread`` is for costly per-row work: a table with fewer
    input splits than the session has slots is redistributed, a larger one is not."""
    df = read_parquet(spark, f"{folder}/{name}.parquet")
    slots = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < slots:
        df = df.repartition(slots)
    return df


def orders(spark: SparkSession, folder: str) -> tuple[DataFrame, TableSchema]:
    raw = load(spark, folder, "orders")
    key = F.col("o_orderkey")
    raw = raw.select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("priority"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("price_known"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status_known"),
        F.when(key % 11 != 0, F.col("o_totalprice") > 250000).alias("big"),
        F.when(key % 13 != 0, F.col("o_orderpriority")).alias("priority_known"),
    )
    return fit(
        with_row_index(raw, "o_orderkey"),
        TableSchema.of(
            Column("status", CATEGORICAL, categories=STATUSES), Column("price", CONTINUOUS),
            Column("date", TEMPORAL, temporal_features=("year",)),
            Column("priority", ORDERED, category_order=PRIORITIES, categories=PRIORITIES),
            Column("price_known", CONTINUOUS), Column("status_known", CATEGORICAL, categories=("F", "O")), Column("big", BOOLEAN),
            Column("priority_known", ORDERED, category_order=PRIORITIES, categories=PRIORITIES),
        ),
    )


ORDERS_SQL = """
    SELECT o_orderkey AS idx, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS date,
           o_orderpriority AS priority,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price_known,
           nullif(o_orderstatus, 'P') AS status_known,
           CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice > 250000 END AS big,
           CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS priority_known
    FROM orders
"""


def lineitem(spark: SparkSession, folder: str) -> tuple[DataFrame, TableSchema]:
    return fit(
        load(spark, folder, "lineitem"),
        TableSchema.of(
            Column("l_quantity", CONTINUOUS), Column("l_extendedprice", CONTINUOUS), Column("l_discount", CONTINUOUS),
            Column("l_returnflag", CATEGORICAL, categories=("A", "N", "R")),
            Column("l_linestatus", CATEGORICAL, categories=("F", "O")), Column("l_shipdate", TEMPORAL),
        ),
    )


def events(spark: SparkSession, folder: str) -> tuple[DataFrame, TableSchema]:
    return fit(
        with_row_index(load(spark, folder, "events"), "event_id"),
        TableSchema.of(
            Column("ts", TEMPORAL, temporal_features=("year", "month", "date", "monthly", "day_of_week", "hour")),
            Column("event_type", CATEGORICAL), Column("value", CONTINUOUS),
        ),
    )


def suppliers(spark: SparkSession, folder: str) -> tuple[DataFrame, TableSchema]:
    """Coordinates are derived from the nation; one nation lies outside the valid range, some names are missing."""
    nation = F.col("s_nationkey")
    raw = load(spark, folder, "supplier").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("name"),
        F.when(nation == 3, nation * 7 + 110).otherwise(nation * 7 - 90).alias("lat"),
        (nation * 13 - 180).alias("lon"), F.col("s_acctbal").alias("balance"),
    )
    return fit(
        with_row_index(raw, "s_suppkey"),
        TableSchema.of(
            Column("name", UNIQUE), Column("lat", GEOSPATIAL, role="latitude"),
            Column("lon", GEOSPATIAL, role="longitude"), Column("balance", CONTINUOUS),
        ),
    )


SUPPLIERS_SQL = """
    SELECT s_suppkey AS idx, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name,
           CASE WHEN CASE WHEN s_nationkey = 3 THEN s_nationkey * 7 + 110 ELSE s_nationkey * 7 - 90 END BETWEEN -90 AND 90
                THEN CASE WHEN s_nationkey = 3 THEN s_nationkey * 7 + 110 ELSE s_nationkey * 7 - 90 END END AS lat,
           CASE WHEN s_nationkey * 13 - 180 BETWEEN -180 AND 180 THEN s_nationkey * 13 - 180 END AS lon,
           s_acctbal AS balance
    FROM supplier
"""


def documents(spark: SparkSession, folder: str, text=None) -> tuple[DataFrame, TableSchema]:
    """Whole texts; the quality label is missing for unlabelled documents."""
    raw = load(spark, folder, "documents", spread=True)
    labels = load(spark, folder, "labels").select("doc_id", F.col("quality"))
    raw = raw.join(labels, "doc_id", "left").select(
        "doc_id", (F.col("text") if text is None else text).alias("text"), "lang", "source",
        F.col("n_chars"), (F.col("quality") == 1).alias("good"),
    )
    return fit(
        with_row_index(raw, "doc_id"),
        TableSchema.of(
            Column("text", TEXTUAL), Column("lang", CATEGORICAL), Column("source", CATEGORICAL),
            Column("n_chars", CONTINUOUS), Column("good", BOOLEAN),
        ),
    )


def documents_with_gaps(spark: SparkSession, folder: str) -> tuple[DataFrame, TableSchema]:
    """The same with every tenth text empty, for the handling of missing texts."""
    return documents(spark, folder, F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text")))


_DOCUMENTS = """
    SELECT d.doc_id AS idx, nullif({text}, '') AS text, d.lang, d.source,
           CAST(d.n_chars AS DOUBLE) AS n_chars, l.quality = 1 AS good
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""
DOCUMENTS_SQL = _DOCUMENTS.format(text="d.text")
GAPS_SQL = _DOCUMENTS.format(text="CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE d.text END")


def topic_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, TableSchema]:
    """Documents with a given topic: the vector's label, 9 being the outliers, NULL without a vector.

    The text stands in for its own preprocessed form.
    """
    vectors = load(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("text (Topic)")
    )
    raw = load(spark, folder, "documents", spread=True).join(vectors, "doc_id", "left")
    raw = raw.select(
        F.col("doc_id").alias(INDEX), "text", F.col("text").alias("text (Preprocessed)"),
        F.col("text (Topic)").cast("int").alias("text (Topic)"), "lang", "source",
    )
    schema = TableSchema.of(
        Column("text", TEXTUAL), Column("text (Preprocessed)", UNIQUE, internal=True, source_name="text"),
        Column("text (Topic)", TOPIC, internal=True, source_name="text"),
        Column("lang", CATEGORICAL), Column("source", CATEGORICAL),
    )
    return raw, schema


TOPIC_DOCUMENTS_SQL = """
    SELECT d.doc_id AS idx, d.text, d.text AS preprocessed,
           CASE WHEN e.label = 9 THEN -1 ELSE e.label END AS topic, d.lang, d.source
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
"""


def topic_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``id``, ``topic``, ``vec`` with label 9 as outliers."""
    return load(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("topic"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def topic_table(spark: SparkSession, folder: str) -> DataFrame:
    """``id``, ``label``, ``frequency`` of the given topics. Labels repeat on purpose."""
    return (
        topic_vectors(spark, folder).filter("topic >= 0").groupBy(F.col("topic").alias("id"))
        .agg(F.count(F.lit(1)).alias("frequency"))
        .select("id", F.concat(F.lit("Theme "), (F.col("id") % 3).cast("string")).alias("label"), "frequency")
    )


EQ = lambda target, value: {"type": "equal_to", "target": target, "value": value}
GT = lambda target, value: {"type": "greater_than", "target": target, "value": value}
IN = lambda target, *values: {"type": "is_one_of", "target": target, "values": list(values)}
NOT = lambda operand: {"type": "not", "operand": operand}
AND = lambda *operands: {"type": "and", "operands": list(operands)}
OR = lambda *operands: {"type": "or", "operands": list(operands)}

# Overlapping groups over orders.
OVERLAPPING = [
    {"name": "F orders", "filter": EQ("status", "F")},
    {"name": "large", "filter": GT("price", 250000)},
    {"name": "urgent", "filter": IN("priority", "1-URGENT", "2-HIGH")},
]
# Mutually exclusive groups that cover all orders.
BY_STATUS = [{"name": s, "filter": EQ("status", s)} for s in STATUSES]
