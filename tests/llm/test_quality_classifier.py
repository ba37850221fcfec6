import zlib

import numpy as np
import pytest

from facetframe.llm import quality_classifier as q

SF = "/root/testdata/sf0.01"


def test_isotonic_is_the_least_squares_fit():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = r.integers(1, 5, 8).astype(float)
        y = r.random(8)
        got = q.isotonic(n, y)
        # The min-max formula of isotonic regression.
        mean = lambda a, b: (n[a : b + 1] * y[a : b + 1]).sum() / n[a : b + 1].sum()
        assert got == pytest.approx([max(min(mean(a, b) for b in range(i, 8)) for a in range(i + 1)) for i in range(8)])


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in q.score_quality(docs.selectExpr("*", "1 score", "2 y", "3 stats"), labels).collect()}
    assert len(rows) == docs.count()
    right = total = 0
    for r in labels.collect():
        got = rows[r["doc_id"]]
        held = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert got["held_out"] == held and got["predicted"] == int(got["score"] >= 0.3) and 0 <= got["score"] <= 1
        if held:
            total += 1
            right += got["predicted"] == r["quality"]
    assert right >= 0.95 * total


def test_held_out_labels_and_names_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", (1 - labels["quality"]).cast("int")).where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    changed = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").unionByName(other)
    one = {r["doc_id"]: r["score"] for r in q.score_quality(docs, labels).collect()}
    two = {r["doc_id"]: r["score"] for r in q.score_quality(docs.selectExpr("doc_id", "text", "'x' lang", "'y' source"), changed).collect()}
    assert one == pytest.approx(two, abs=1e-9)


def test_edges(spark):
    rows = [(i, ("good plain text number %d of this table. " % i) * 5) for i in range(40)] + [(100 + i, "BAD!!! " * 30) for i in range(40)]
    rows += [(500, None), (501, ""), (None, "x"), (502, "long " * 200_000), (502, "long " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows[:80]] + [(None, 1), (500, None)], "doc_id long, quality int")
    got = q.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert min(by[i] for i in range(40)) > max(by[100 + i] for i in range(40))
    kept = q.keep_good(docs.selectExpr("*", "1 score", "'q' `a.b`"), labels)
    assert kept.columns == ["doc_id", "text", "score", "a.b"]
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}
    assert {r["score"] > 0.2 for r in q.score_quality(docs, labels.limit(0)).collect()} == {True}
    assert q.score_quality(docs.limit(0), labels).count() == 0


def test_batches_of_texts_are_small(spark):
    import pyarrow as pa

    from facetframe.llm.common import prepare

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    found = [r["n"] for r in prepare(spark).range(2000).coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 2000 and max(found) <= 256
