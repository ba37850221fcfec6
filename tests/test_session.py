"""The folder of stage tables, and CSV files with line breaks in their cells."""

import glob
import time
import types

import pytest
from pyspark.sql import functions as F

from facetframe import session
from facetframe.errors import ValidationError
from facetframe.sources import prepare_source, read_csv, with_row_index


def pretend(master):
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None)
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValidationError):
            session.stage_folder(pretend(master))
    assert session.stage_folder(pretend("local[4]"))


def test_a_scope_leaves_no_stage_tables(spark):
    folder = session.stage_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/stage-*"))
    with session.stage_scope(spark):
        kept = session.cut_lineage(spark.range(5))
        with session.stage_scope(spark):
            assert session.cut_lineage(kept).count() == 5
        assert kept.count() == 5
        assert len(set(glob.glob(f"{folder}/stage-*")) - before) == 1
    assert set(glob.glob(f"{folder}/stage-*")) == before


def test_shuffle_files_go_with_the_write_of_a_stage_table(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f for f in files.getAllFiles().mkString(",").split(",") if "/shuffle_" in f}
    before, setting = names(), spark.conf.get(session.CLEANUP, None)
    stored = session.cut_lineage(spark.range(100).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):
        if not names() - before:
            break
        time.sleep(0.1)
    assert not names() - before and stored.count() == 7
    assert spark.conf.get(session.CLEANUP, None) == setting


def test_a_discarded_table_is_gone(spark):
    folder = session.stage_folder(spark).removeprefix("file:")
    with session.stage_scope(spark):
        before = set(glob.glob(f"{folder}/stage-*"))
        session.discard(session.cut_lineage(spark.range(5)))
        assert set(glob.glob(f"{folder}/stage-*")) == before


def test_line_breaks_quotes_and_delimiters_in_cells(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id;text\n1;"line one\nline two"\n2;"say ""yes""; or no"\n3;plain\n', encoding="utf-8")
    rows = prepare_source(read_csv(spark, str(path), delimiter=";"))
    got = sorted((r["id"], r["text"]) for r in rows.collect())
    assert got == [(1, "line one\nline two"), (2, 'say "yes"; or no'), (3, "plain")]
    assert dict(rows.dtypes)["id"] == "bigint"


@pytest.mark.parametrize("size", [7, 40, 100_000])
def test_quoted_cells_in_many_ranges(spark, tmp_path, size):
    """Ranges of a few bytes give the rows of the one-task reader, in the order of the files."""
    cells = ['"line one\nline two"', '"say ""yes""; or no"', '"""\n"""', "plain", '""', "", '"a\r\nb;"', '"\n\n"', '"é ""\n"""']
    for k, end in enumerate(("\n", "\r\n", "\n")):
        rows = [f"{i};{cells[(i * (k + 1)) % len(cells)]};{cells[(i + k) % len(cells)]}" for i in range(30)]
        body = end.join(['"id";"first ""cell""";second', *rows[:20], "", *rows[20:]])
        (tmp_path / f"part-{k}.csv").write_bytes((body + end * (k != 2)).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        split = read_csv(spark, str(tmp_path), delimiter=";", split_quoted=True, number="at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = []
    split = [[(v.replace("\r\n", "\n") if 30 <= r[0] < 60 and isinstance(v, str) else v) for v in r] for r in split]
    for k in range(3):  # in a file of CRLF lines, the one-task reader also changes the line breaks inside cells
        rows += [tuple(r) for r in read_csv(spark, str(tmp_path / f"part-{k}.csv"), delimiter=";").collect()]
    assert sorted(r[0] for r in split) == list(range(90))
    assert [tuple(r)[1:] for r in sorted(split, key=lambda r: r[0])] == rows


def test_row_ids_of_a_shuffled_frame(spark):
    df = with_row_index(spark.range(1000).repartition(7))
    assert sorted(r["__index"] for r in df.collect()) == list(range(1000))


def test_small_ranges_share_tasks(spark, tmp_path):
    """Ranges of 64 kB do not become a task each, however many a file has."""
    from facetframe.plans.catalogue import QUERIES

    rows = spark.range(4000).selectExpr("id AS doc_id", "concat('a \"b\"\n', repeat(concat(id, ';'), 300)) AS text", "'en' AS lang")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["csv_in_ranges"](spark, str(tmp_path))
    assert len(found.inputFiles()) <= 5 * spark.sparkContext.defaultParallelism
    assert found.agg(F.count_if(F.expr("doc_id = place")), F.sum(F.length("text"))).first() == rows.agg(F.count("*"), F.sum(F.length("text"))).first()
