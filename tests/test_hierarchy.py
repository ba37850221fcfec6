"""The density hierarchy against one built level by level with plain sets."""

import math
from collections import Counter

import numpy as np
import pytest

from facetframe.errors import ValidationError
from facetframe.operators import clustering, hierarchy


def parts_of(cells):
    """Connected parts of a set of cells that touch by a face."""
    left, out = set(cells), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            cell = todo.pop()
            part.add(cell)
            for d in range(len(cell)):
                for step in (1, -1):
                    near = (*cell[:d], cell[d] + step, *cell[d + 1 :])
                    if near in left:
                        left.remove(near)
                        todo.append(near)
        out.append(frozenset(part))
    return out


def brute_force(counts, least, smallest, largest, per_doubling, dimensions):
    """The cells of each kept cluster. Recursive: a component's best choice is itself or its parts' best choices."""
    density = lambda j: (least * 2 ** (j / per_doubling)) ** (1 / dimensions)
    floor = lambda n: math.floor(math.log2(n / least) * per_doubling + 1e-9)

    def mass(part):
        return sum(counts[c] for c in part)

    def inside(cells, j):
        return [p for p in parts_of(c for c in cells if counts[c] >= least and floor(counts[c]) >= j) if mass(p) >= smallest]

    def best(part, j):
        """(stability, clusters) of the best choice in a cluster that begins as ``part`` at level j."""
        own, at = mass(part) * (density(j) - density(j - 1)), part
        while True:
            j += 1
            further = inside(at, j)
            if len(further) != 1:
                break
            at = further[0]
            own += mass(at) * (density(j) - density(j - 1))
        below = [best(p, j) for p in further]
        total = sum(b[0] for b in below)
        return (own, [part]) if own >= total else (total, [c for b in below for c in b[1]])

    def fitting(part, j):
        if largest is None or mass(part) <= largest:
            return best(part, j)[1]
        return [c for p in inside(part, j + 1) for c in fitting(p, j + 1)] if any(floor(counts[c]) > j for c in part) else []

    return [c for p in inside(counts, 0) for c in fitting(p, 0)]


def varied():
    """Two narrow clouds that touch, a wide thin one, far points, and copies."""
    rng = np.random.default_rng(11)
    clouds = [rng.normal((0, 0), 0.35, (900, 2)), rng.normal((2.2, 0), 0.35, (600, 2)), rng.normal((9, 9), 1.6, (900, 2)), [[40, -40], [-40, 30]]]
    return np.vstack(clouds)


def table(spark, points):
    return spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(points)], "id long, vec array<double>")


def clusters_of(out):
    rows = out.collect()
    sets = {}
    for r in rows:
        sets.setdefault(r["topic"], set()).add(r["id"])
    return len(rows), sets


@pytest.mark.parametrize("resolution,share", [(2.0, None), (3.0, 0.3)])
def test_against_brute_force(spark, resolution, share):
    points = varied()
    vectors = table(spark, points)
    rows, found = clusters_of(hierarchy.density_hierarchy(vectors, 30, 4, share, resolution))
    assert rows == len(points)
    side, _ = clustering.cell_sides(vectors, 4, resolution)
    cells = [tuple(math.floor(x / s) for x, s in zip(p, side)) for p in points.tolist()]
    kept = brute_force(Counter(cells), 4, 30, share and int(share * len(points)), 4, 2)
    counts = Counter(cells)
    dense = {t: {i for i in ids if counts[cells[i]] >= 4} for t, ids in found.items() if t >= 0}
    expected = [{i for i, c in enumerate(cells) if c in part} for part in kept]
    assert sorted(map(sorted, dense.values())) == sorted(map(sorted, expected)) and len(kept) >= 2
    sizes = [len(found[t]) for t in range(len(kept))]
    assert sizes == sorted(sizes, reverse=True) and {2400, 2401} <= found[-1]
    # A thin cell belongs to a cluster if and only if it touches one.
    core = {c: t for t, ids in dense.items() for c in {cells[i] for i in ids}}
    for i, (x, y) in enumerate(cells):
        if counts[x, y] < 4:
            near = {core[c] for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if c in core}
            assert any(i in found[t] for t in near) if near else i in found[-1]


def test_varying_density_where_one_level_fails(spark):
    points = varied()
    _, found = clusters_of(hierarchy.density_hierarchy(table(spark, points), 60, 4, None, 1.0))
    homes = []
    for first, last in ((0, 900), (900, 1500), (1500, 2400)):
        topic, share = Counter(t for t, ids in found.items() for i in ids if first <= i < last).most_common(1)[0]
        assert topic >= 0 and share > 0.75 * (last - first)
        homes.append(topic)
    assert len(set(homes)) == 3
    # At one density, the clouds that touch are one cluster.
    _, flat = clusters_of(clustering.density_clusters(table(spark, points), 60, 4, None, 1.0))
    assert any({10, 910} <= ids for t, ids in flat.items() if t >= 0)


def test_odd_input(spark):
    empty = spark.createDataFrame([], "id long, vec array<double>")
    assert hierarchy.density_hierarchy(empty, 5).collect() == []
    rows = [(i, [1.0, 1.0]) for i in range(40)] + [(50, None), (51, [5.0, 5.0])]
    _, found = clusters_of(hierarchy.density_hierarchy(spark.createDataFrame(rows, empty.schema), 5, 2, None, 4.0))
    assert found == {0: set(range(40)), -1: {51}}
    with pytest.raises(ValidationError):
        hierarchy.density_hierarchy(empty, 1)


def test_components_of_winding_parts_take_few_rounds(spark, monkeypatch):
    from facetframe.operators import clustering

    rng = np.random.default_rng(2)
    path = rng.permutation(400).tolist()
    edges = [(a, b) for i, (a, b) in enumerate(zip(path, path[1:])) if i != 249]
    rounds = []

    class Counted(clustering.Observation):
        def __init__(self):
            super().__init__()
            rounds.append(1)

    monkeypatch.setattr(clustering, "Observation", Counted)
    nodes = spark.createDataFrame([(i,) for i in range(402)], "node long")
    found = clustering.connected_components(nodes, spark.createDataFrame(edges, "a long, b long"))
    labels = {r["node"]: r["label"] for r in found.collect()}
    first, second = path[:250], path[250:]
    assert all(labels[i] == min(first) for i in first) and all(labels[i] == min(second) for i in second)
    assert labels[400] == 400 and labels[401] == 401 and len(labels) == 402
    assert len(rounds) <= 20
