"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from .errors import ValidationError


def configure(spark: SparkSession) -> SparkSession:
    """Set the run-time options the operators rely on.

    All instants are UTC. AQE turns joins against small measured sides into
    broadcast joins and splits skewed partitions of the others.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Task functions travel with the job, so executors need no copy of the package.
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    return spark


def stage_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It comes from ``spark.checkpoint.dir``. Only a single-machine session may do
    without: executors elsewhere would not see a folder made here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValidationError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="stages-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_scopes: list[list[str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: What a written table was shuffled through is not read again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, outlive: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has a flat plan, survives lost executors, and carries its true
    size, by which Spark chooses join strategies. Tables written inside
    ``stage_scope`` go when it ends; with ``outlive``, when the scope around it ends.
    The shuffle files of the write go at once.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    if len(_scopes) > outlive:
        _scopes[-1 - outlive].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` gave, before its scope ends. Nothing may read it any more."""
    path = _paths.pop(table)
    for scope in _scopes:
        if path in scope:
            scope.remove(path)
    delete_table(table.sparkSession, path)


def delete_table(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the stage tables written inside, at the end. Write or collect the result before that."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_table(spark, path)


def keep_in_order(df: DataFrame) -> DataFrame:
    """Checkpoint a sorted frame; unlike files, the partitions keep their order."""
    stage_folder(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(stage_folder(df.sparkSession))
    return df.checkpoint(eager=True)
