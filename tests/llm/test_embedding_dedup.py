import numpy as np
import pytest
from facetframe.llm import embedding_dedup as e
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(vectors, least=e.SIMILARITY):
    """(links, component) of every vector by all pairs; ids are the places."""
    fit = [i for i, x in enumerate(vectors) if x is not None and len(x) and None not in x and np.isfinite(x).all() and np.any(x)]
    near = [[] for _ in vectors]
    for size in {len(vectors[i]) for i in fit}:
        same = [i for i in fit if len(vectors[i]) == size]
        x = np.array([vectors[i] for i in same])
        for k, i in enumerate(same):
            cosine = (x * x[k]).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (x[k] * x[k]).sum())
            near[i] = [same[j] for j in np.flatnonzero(cosine >= least) if j != k]
    root = list(range(len(vectors)))
    for i in range(len(vectors)):
        stack = [i] if root[i] == i else []
        while stack:
            for j in near[stack.pop()]:
                if root[j] == j and j > i:
                    root[j] = i
                    stack.append(j)
    return [(len(n), r) for n, r in zip(near, root)]


def result(spark, vectors, **options):
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").selectExpr("*", "1 node", "'x' key", "2 `a.b`")
    rows = {r["vec_id"]: r for r in e.near_vectors(frame, **options).collect()}
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())
    return [(rows[i]["n_links"], rows[i]["component_id"]) for i in range(len(vectors))]


def at_angle(r, x, cosine):
    z = r.normal(size=len(x))
    z -= np.dot(z, x) / np.dot(x, x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z)


@pytest.mark.parametrize("most, crowd", [(e.MOST, e.CROWD), (40, 10)])
def test_against_all_pairs(spark, most, crowd):
    r = np.random.default_rng(5)
    vectors = [r.normal(size=64).tolist() for _ in range(300)]
    for k in range(60):  # pairs at many angles, chains, scaled and exact copies
        base = np.array(vectors[k])
        vectors.append(at_angle(r, base, 0.93 + 0.0011 * k).tolist())
        vectors.append((base * (k + 1)).tolist())
    vectors += [vectors[7]] * 30
    for cosine in (0.97, 0.985, 0.995):  # crowds: wide, middle and close
        base = r.normal(size=64)
        vectors += [at_angle(r, base, cosine).tolist() for _ in range(150)]
    vectors += [None, [], [0.0] * 64, [None, *[1.0] * 63], [float("nan"), *[1.0] * 63], [float("inf")] * 64, [1.0], [2.0], [-3.0], [1e-200, 2e-200], [1e150, 2e150]]
    assert result(spark, vectors, most=most, crowd=crowd) == brute(vectors)


def test_recall_at_the_threshold(spark):
    r = np.random.default_rng(6)
    vectors = []
    for _ in range(600):
        base = r.normal(size=64)
        vectors += [base.tolist(), at_angle(r, base, 0.9500001).tolist()]
    assert sum(n for n, _ in result(spark, vectors)) >= 0.999 * 1200


def test_given_vectors_and_edge_tables(spark):
    given_ = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = given_.orderBy("vec_id").collect()
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_vectors(given_).collect()}
    assert [found[r["vec_id"]] for r in rows] == [(n, rows[c]["vec_id"]) for n, c in brute([np.array(r["embedding"]) .tolist() for r in rows])]
    assert e.near_vectors(given_.limit(0)).count() == 0
    twice = spark.createDataFrame([(4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [1.0, -0.0]), (None, None)], "vec_id long, embedding array<float>")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in e.near_vectors(twice).collect())
    assert got == [("4", 2, "4", True), ("4", 2, "4", True), ("None", 0, "None", True), ("None", 2, "4", False)]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 6), st.integers(0, 10**6))
def test_hadamard(power, seed):
    n = 1 << power
    x = np.random.default_rng(seed).normal(size=(3, n))
    matrix = np.array([[(-1) ** (i & j).bit_count() for j in range(n)] for i in range(n)])
    assert np.allclose(e.hadamard(x), x @ matrix)


def test_keys_depend_on_nothing_else():
    x = np.random.default_rng(1).normal(size=(50, 48))
    whole = e.keys(x)
    assert all((e.keys(x[i : i + 1])[0] == whole[i]).all() for i in range(50)) and (e.keys(x * 8.0) == whole).all()
    assert all(len(set(k)) == 1 + e.GUESTS for row in whole for k in row.tolist())
