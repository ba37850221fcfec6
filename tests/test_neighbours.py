"""Near neighbours against all pairs, and the map against dense eigenvectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetframe.operators import neighbours
from facetframe.session import cut_lineage


def frame(spark, points, more=()):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)] + list(more)
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(4)


def unit(points):
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def test_most_true_neighbours_are_found(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RUN", 60)
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(c, 0.4, (300, 16)) for c in rng.normal(0, 1, (5, 16))])
    found = neighbours.near_neighbours(frame(spark, points), 10).collect()
    x = unit(points)
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    true = {(i, j) for i in range(len(x)) for j in np.argsort(far[i])[:10].tolist()}
    mine = {(r["id"], r["other"]) for r in found}
    assert len(found) == len(mine) == 10 * len(x)
    assert len(true & mine) >= 0.9 * len(true)
    assert all(abs(r["distance"] - far[r["id"], r["other"]] ** 0.5) < 1e-9 for r in found)


def test_crowds_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RUN", 40)
    rng = np.random.default_rng(6)
    points = np.vstack([np.ones((150, 3)), rng.normal(size=(50, 3))])
    odd = [(900, None), (901, [0.0, 0.0, 0.0]), (902, [1.0, None, 2.0]), (903, [float("nan"), 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0])]
    found = neighbours.near_neighbours(frame(spark, points, odd), 5, orders=2, exchanges=1).collect()
    count = {}
    for r in found:
        count[r["id"]] = count.get(r["id"], 0) + 1
        assert r["id"] < 900 and r["other"] < 900 and r["id"] != r["other"]
        if r["id"] < 150:
            assert r["distance"] == 0
    assert set(count.values()) == {5} and len(count) == 200
    values, made = neighbours.layout(frame(spark, points, odd), 2, 5, 2, 1)
    rows = made.collect()
    assert len(rows) == 200 and all(np.isfinite(r["vec"]).all() and len(r["vec"]) == 2 for r in rows)


def test_the_map_solves_the_eigenproblem(spark, monkeypatch):
    seen = []
    links = neighbours._links

    def remember(*args):
        seen.append(cut_lineage(links(*args), outlive=True))
        return seen[-1]

    monkeypatch.setattr(neighbours, "_links", remember)
    rng = np.random.default_rng(9)
    points = np.vstack([rng.normal(c, 0.3, (30, 4)) for c in 2 * np.eye(4)[:3]])
    values, made = neighbours.layout(frame(spark, points), 2, 6, 2, 1, tolerance=1e-7)
    w = np.zeros((90, 90))
    for r in seen[0].collect():
        w[r["a"], r["b"]] = w[r["b"], r["a"]] = r["w"]
    degree = w.sum(axis=1)
    expected, axes = np.linalg.eigh(w / np.sqrt(np.outer(degree, degree)))
    assert np.allclose(values, expected[::-1][1:3], atol=1e-6)
    mine = {r["id"]: r["vec"] for r in made.collect()}
    y = np.array([mine[i] for i in range(90)])
    assert np.allclose((y**2).mean(axis=0), 1) and ((y**3).sum(axis=0) >= 0).all()
    assert np.abs(w @ y / degree[:, None] - y * values).max() < 1e-3
    # The three groups lie apart from each other in the map.
    centres = np.array([y[i : i + 30].mean(axis=0) for i in (0, 30, 60)])
    nearest = ((y[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == np.repeat([0, 1, 2], 30)).mean() > 0.95


def test_an_exchange_measures_only_what_may_replace_a_neighbour(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = unit(np.vstack([rng.normal(c, 0.5, (60, 8)) for c in rng.normal(0, 1, (3, 8))]))
    x[100:110] = x[100]  # a crowd: of equally near ones the lowest ids count
    table = cut_lineage(frame(spark, x))
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    near = {i: [int(j) for j in rng.permutation(np.delete(np.arange(180), i))[:6]] for i in range(180)}
    rows = [(i, j, float(far[i, j]), 0) for i, js in near.items() for j in js]
    given = cut_lineage(spark.createDataFrame(rows, "id long, other long, squared double, round int"))
    coarse = cut_lineage(table.select("id", F.transform("vec", lambda v: F.round(v * neighbours.STEPS).cast("smallint")).alias("steps")))
    seen, offered = [], neighbours._may_replace
    monkeypatch.setattr(neighbours, "REACH", 6)

    def brute(near):
        """All pairs of links of one document, as before."""
        links = {i: set(js) for i, js in near.items()}
        for j in range(180):
            heard = sorted((far[i, j], i) for i, js in near.items() if j in js)[:6]
            links[j] |= {i for _, i in heard}
        more = {i: set(js) for i, js in near.items()}
        for met in links.values():
            for a in met:
                more[a] |= met - {a}
        return {i: sorted(js, key=lambda j: (far[i, j], j))[:6] for i, js in more.items()}, links

    links = None
    for turn in (1, 2, 3):
        given, links = neighbours._exchanged(given, links, table, coarse, 6, turn)
        near, all_links = brute(near)
        mine = {}
        for r in given.orderBy("id", "squared", "other").collect():
            mine.setdefault(r["id"], []).append(r["other"])
        crowd = set(range(100, 110))
        assert all(mine[i] == near[i] for i in range(180) if not crowd & {i, *near[i]})
        assert all(np.allclose(far[i, mine[i]], far[i, near[i]]) for i in range(180))
        fresh = links.filter("fresh").count()
        seen.append(fresh / links.count())
        assert links.count() == sum(map(len, all_links.values()))
    assert seen[0] == 1 and seen[2] < 0.7
    # Links that met before do not meet again; far ones are not offered.
    places = [pa.array([[1, 2, 3, 4]], pa.list_(pa.int64())), pa.array([[False, False, True, True]])]
    steps = pa.array([[32767, 0, 32766, 100, 32760, 600, -32767, 0]], pa.list_(pa.int16()))
    batch = pa.RecordBatch.from_arrays([*places, pa.array([[0.1] * 4]), pa.array([[9] * 4], pa.list_(pa.int64())), steps], names=list("abcde"))
    out = next(offered(iter([batch])))
    assert set(zip(out.column(0).to_pylist(), out.column(1).to_pylist())) == {(1, 3), (3, 1), (2, 3), (3, 2)}


def test_large_blocks_are_multiplied_by_one_join(spark, monkeypatch):
    from facetframe.operators import spectral

    rng = np.random.default_rng(8)
    points = np.vstack([rng.normal(c, 0.3, (30, 4)) for c in 2 * np.eye(4)[:3]])
    shared, packed = neighbours.layout(frame(spark, points), 2, 6, 2, 1)
    packed = {r["id"]: r["vec"] for r in packed.collect()}
    monkeypatch.setattr(spectral, "SHARED", 0)
    monkeypatch.setattr(spectral, "times_transposed", None)  # the second join of a round
    values, joined = neighbours.layout(frame(spark, points), 2, 6, 2, 1)
    assert np.allclose(values, shared)
    assert all(np.allclose(r["vec"], packed[r["id"]], atol=1e-6) for r in joined.collect())


def test_rows_of_repeated_ids_stand_once_in_an_order(spark):
    twice = neighbours._rows(frame(spark, np.eye(4)).union(frame(spark, np.eye(4))))
    order = neighbours._order(twice, np.zeros(4), np.eye(4), np.random.default_rng(1))
    assert sorted(r["number"] for r in order.collect()) == list(range(8))
    found = neighbours._within_runs([order], twice, 7).groupBy("id", "other").count().collect()
    assert all(r["count"] == (2 if r["id"] == r["other"] else 4) for r in found) and len(found) == 16


def test_few_vectors(spark):
    empty = spark.createDataFrame([], "id long, vec array<double>")
    assert neighbours.near_neighbours(empty).count() == 0 and neighbours.layout(empty)[1].count() == 0
    one = frame(spark, [[1.0, 0.0]])
    assert neighbours.near_neighbours(one).count() == 0
    assert [r["vec"] for r in neighbours.layout(one)[1].collect()] == [[0.0, 0.0]]
    two = neighbours.layout(frame(spark, [[1.0, 0.0], [0.0, 1.0]]))[1].collect()
    assert [r["vec"] for r in two] == [[0.0, 0.0]] * 2


def test_discovery_places_documents_by_neighbours(spark):
    from facetframe.errors import ValidationError
    from facetframe.operators import discovery
    from facetframe.operators.text import TextConfig
    from facetframe.schema import INDEX, Column, TableSchema

    rng = np.random.default_rng(3)
    kinds = ["apple pear plum", "nail screw bolt"]
    docs = spark.createDataFrame([(i, " ".join(rng.permutation(kinds[i % 2].split() * 3))) for i in range(60)], f"`{INDEX}` long, t string")
    given = frame(spark, np.eye(3)[np.arange(60) % 2] + rng.normal(0, 0.05, (60, 3)))
    schema = TableSchema.of(Column("t", "textual"))
    plain = TextConfig(min_df=1, max_df=1.0, min_document_length=1, phrase_threshold=1e9)
    config = discovery.TopicConfig(embedding="column", min_topic_size=5, clustering_dimensions=2, text=plain, positions="neighbours")
    placed = {r["id"]: r["vec"][0] for r in discovery.discover_topics(docs, schema, "t", config, given).positions.collect()}
    assert len(placed) == 60
    assert len({placed[i] > 0 for i in range(0, 60, 2)}) == 1 and len({placed[i] > 0 for i in range(60)}) == 2
    with pytest.raises(ValidationError):
        wrong = discovery.TopicConfig(embedding="column", text=plain, positions="other")
        discovery.discover_topics(docs, schema, "t", wrong, given)
