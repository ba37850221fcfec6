"""Singular vectors and document vectors against dense solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetframe.errors import ValidationError
from facetframe.operators import spectral, vectors


def sparse(spark, dense, partitions=3):
    rows, cols = np.nonzero(dense)
    entries = spark.createDataFrame(
        [(int(i), f"c{j}", float(dense[i, j])) for i, j in zip(rows, cols)], "row long, col string, w double"
    ).repartition(partitions)
    columns = spectral.spread_columns(entries.groupBy("col").agg(F.count("*").alias("rows")))
    return spectral.salted(entries.join(columns, "col")), columns


def dense_tfidf(texts):
    words = sorted({w for t in texts for w in t.split()})
    tf = np.array([[t.split().count(w) for w in words] for t in texts], float)
    weight = tf * np.log((1 + len(texts)) / (1 + (tf > 0).sum(axis=0)))
    length = np.linalg.norm(weight, axis=1, keepdims=True)
    return weight / np.where(length > 0, length, 1)


def texts(n=60, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(40)]
    return [" ".join(rng.choice(words, int(rng.integers(2, 25)), p=np.arange(1, 41) / 820)) for _ in range(n)]


@pytest.mark.parametrize("copies", [100_000, 7])
def test_singular_values_equal_the_dense_ones(spark, monkeypatch, copies):
    monkeypatch.setattr(spectral, "ROWS_PER_COPY", copies)
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(90, 50)) * (rng.random((90, 50)) < 0.3)
    entries, columns = sparse(spark, dense)
    values, right = spectral.leading_vectors(entries, columns, 4)
    _, expected, rows = np.linalg.svd(dense)
    assert np.allclose(values, expected[:4], rtol=1e-6)
    found = {r["col"]: r["vec"] for r in right.collect()}
    v = np.array([found[f"c{j}"] for j in range(50)])
    assert np.allclose(np.abs(rows[:4] @ v), np.eye(4), atol=1e-4)
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8)


def test_equal_values_low_rank_and_one_column(spark):
    values, _ = spectral.leading_vectors(*sparse(spark, np.eye(12) * 2), 5)
    assert np.allclose(values, 2)
    rng = np.random.default_rng(2)
    low = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 20))
    values, right = spectral.leading_vectors(*sparse(spark, low), 5)
    assert np.allclose(values, np.linalg.svd(low)[1][:2], rtol=1e-6) and right.count() == 20
    values, _ = spectral.leading_vectors(*sparse(spark, np.array([[3.0], [4.0]])), 3)
    assert np.allclose(values, [5])


def test_lsa_equals_the_dense_decomposition(spark):
    given = texts()
    frame = spark.createDataFrame([*enumerate(given), (100, None), (101, "a b"), (102, "")], "id long, document string")
    made = {r["id"]: r["vec"] for r in vectors.embed_lsa(frame, 6).collect()}
    assert sorted(made) == list(range(60))
    u, s, _ = np.linalg.svd(dense_tfidf(given), full_matrices=False)
    mine = np.array([made[i] for i in range(60)])
    assert np.allclose(np.linalg.norm(mine, axis=0), s[:6], rtol=1e-6)
    assert np.allclose(np.abs(mine), np.abs(u[:, :6] * s[:6]), atol=1e-3)


def test_lsa_limits(spark):
    frame = spark.createDataFrame([(0, "aa bb cc"), (1, "aa bb dd"), (2, "aa cc ee"), (3, "aa aa zz")], "id long, document string")
    entries, columns = vectors.weighted_terms(frame, min_df=2)
    assert {r["col"] for r in columns.collect()} == {"bb", "cc"}  # "aa" is everywhere and weighs nothing
    assert {r["col"] for r in vectors.weighted_terms(frame, max_df=0.25)[1].collect()} == {"dd", "ee", "zz"}
    assert {r["col"] for r in vectors.weighted_terms(frame, max_df=0.5, max_terms=2)[1].collect()} == {"bb", "cc"}
    made = {r["id"]: r["vec"] for r in vectors.embed_lsa(frame, 1, min_df=2).collect()}
    assert made[3] == [0.0] and len(made) == 4
    with pytest.raises(ValidationError):
        vectors.embed_lsa(frame, 2, min_df=9)
    with pytest.raises(ValidationError):
        vectors.embed_lsa(frame.limit(0), 2)


def brute_silhouette(topics, points):
    out = {}
    for i, (t, x) in enumerate(zip(topics, points)):
        if t < 0:
            continue
        mean = {}
        for k in set(topics) - {-1}:
            far = [((x - points[j]) ** 2).sum() for j in range(len(points)) if topics[j] == k and j != i]
            mean[k] = np.mean(far) if far else 0.0
        others = [mean[k] for k in mean if k != t]
        alone = topics.count(t) == 1
        out[i] = 0.0 if alone or not others else (min(others) - mean[t]) / max(min(others), mean[t])
    return out


@pytest.mark.parametrize("shared", [4_000_000, 6])
def test_silhouette_per_topic(spark, monkeypatch, shared):
    monkeypatch.setattr(vectors, "MAX_SHARED_NUMBERS", shared)  # several blocks of topics
    rng = np.random.default_rng(8)
    topics = [int(t) for t in rng.integers(-1, 5, 80)] + [9]
    points = rng.normal(size=(81, 3)) + 1000 + np.array(topics)[:, None]
    rows = [(i, t, p.tolist()) for i, (t, p) in enumerate(zip(topics, points))] + [(500, 2, None), (501, None, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, topic int, vec array<double>").repartition(4)
    expected = brute_silhouette(topics, points)
    found = {r["id"]: r["silhouette"] for r in vectors.silhouette_per_document(frame).collect()}
    assert found == pytest.approx(expected)
    by_topic = {r["topic"]: (r["silhouette"], r["support"]) for r in vectors.silhouette_per_topic(frame).collect()}
    assert by_topic[9] == (0.0, 1)
    assert by_topic[3][0] == pytest.approx(np.mean([expected[i] for i in expected if topics[i] == 3]))
    assert vectors.silhouette(frame).first()[0] == pytest.approx(np.mean(list(expected.values())))


def test_silhouette_of_nothing_and_of_one_topic(spark):
    frame = spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (2, -1, [0.0, 0.0])], "id long, topic int, vec array<double>")
    assert vectors.silhouette(frame).first()[0] == 0.0
    assert vectors.silhouette(frame.filter("topic < 0")).first()[0] is None
    same = spark.createDataFrame([(i, i % 2, [1.0]) for i in range(6)], "id long, topic int, vec array<double>")
    assert vectors.silhouette(same).first()[0] == 0.0


def test_packed_rows_and_tables_give_the_same(spark, monkeypatch):
    """A small block of vectors goes to the tasks; without that, the entries are joined in every round."""
    rng = np.random.default_rng(8)
    dense = rng.normal(size=(80, 30)) * (rng.random((80, 30)) < 0.3)
    entries, columns = sparse(spark, dense)
    joins = []
    plain = spectral.times
    monkeypatch.setattr(spectral, "times", lambda *a: joins.append(1) or plain(*a))
    values, _ = spectral.leading_vectors(entries, columns, 3)
    assert not joins
    monkeypatch.setattr(spectral, "SHARED", 0)
    others, _ = spectral.leading_vectors(entries, columns, 3)
    assert joins and np.allclose(values, others) and np.allclose(values, np.linalg.svd(dense)[1][:3], rtol=1e-6)


def test_large_blocks_of_vectors_go_to_the_tasks_in_slices(spark, monkeypatch):
    """A block that is too large for a task is multiplied some vectors at a time; entries are never joined, and no stage table stays."""
    monkeypatch.setattr(spectral, "SHARED", 200)
    monkeypatch.setattr(spectral, "ENTRIES", 50)
    monkeypatch.setattr(spectral, "times", lambda *a: pytest.fail("entries were joined"))
    slices, plain = [], spectral._slices
    monkeypatch.setattr(spectral, "_slices", lambda *a: (slices.append(x.shape) or x for x in plain(*a)))
    given = texts()
    frame = spark.createDataFrame([*enumerate(given)], "id long, document string")
    made = {r["id"]: r["vec"] for r in vectors.embed_lsa(frame, 6).collect()}
    u, s, _ = np.linalg.svd(dense_tfidf(given), full_matrices=False)
    mine = np.array([made[i] for i in range(60)])
    assert np.allclose(np.linalg.norm(mine, axis=0), s[:6], rtol=1e-6)
    assert np.allclose(np.abs(mine), np.abs(u[:, :6] * s[:6]), atol=1e-3)
    assert max(a * b for a, b in slices) <= 200 and slices[:3] == [(5, 40), (5, 40), (4, 40)]


def test_packed_rows_count_as_the_tables_do(spark, monkeypatch):
    """Texts that share an id are one row, a missing id has no entries, and limits hold."""
    given = [*enumerate(texts(40)), (3, "word39 word38 word1"), (3, "word39"), (None, "word39 word5"), (7, ""), (8, None), (90, "unknown xx")]
    frame = spark.createDataFrame(given, "id long, document string").repartition(3)
    row = lambda made: sorted((r["id"] is None, r["id"] or 0, [round(abs(x), 6) for x in r["vec"]]) for r in made.collect())
    packed = [row(vectors.embed_lsa(frame, 4, 2, 0.9, most)) for most in (None, 12)]
    monkeypatch.setattr(vectors, "packed_terms", lambda *a: None)
    tables = [row(vectors.embed_lsa(frame, 4, 2, 0.9, most)) for most in (None, 12)]
    for mine, theirs in zip(packed, tables):
        assert [r[:2] for r in mine] == [r[:2] for r in theirs] and len(mine) == 44
        assert np.allclose([r[2] for r in mine], [r[2] for r in theirs], atol=1e-3)
        assert mine[-1] == (True, 0, [0.0] * 4) and mine[-2] == (False, 90, [0.0] * 4)
