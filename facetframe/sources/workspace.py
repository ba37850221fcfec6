"""The fitted table on disk. Column meanings travel in the Parquet field metadata."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..schema import Column, TableSchema, quoted

_KEY = "semantic"


def write_workspace(df: DataFrame, schema: TableSchema, path: str) -> None:
    """Write the fitted table, replacing what is there.

    Files appear when the job commits. The path must not be one that ``df``
    itself reads from, because an overwrite empties it first.
    """
    target = path.rstrip("/")
    for source in df.inputFiles():
        if source.split("://")[-1].replace("file:", "").startswith(target + "/"):
            raise ValidationError(f"{path} is being read by the table that would replace it")
    known = {c.name: c for c in schema.columns}
    columns = []
    for name in df.columns:
        metadata = {_KEY: json.dumps(asdict(known[name]))} if name in known else {}
        columns.append(F.col(quoted(name)).alias(name, metadata=metadata))
    df.select(*columns).write.mode("overwrite").parquet(path)


def read_workspace(spark: SparkSession, path: str) -> tuple[DataFrame, TableSchema]:
    """The table and its schema; category orders come back without a refit."""
    df = spark.read.parquet(path)
    columns = []
    for field in df.schema.fields:
        if _KEY not in field.metadata:
            continue
        options = json.loads(field.metadata[_KEY])
        for name in ("category_order", "categories", "temporal_features"):
            if options[name] is not None:
                options[name] = tuple(options[name])
        columns.append(Column(**options))
    return df, TableSchema(tuple(columns))
