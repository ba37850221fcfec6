import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from facetframe.llm import decontamination as d


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def brute_tiles(run, item, least):
    """Greedy tiling by comparing every pair of places, longest matches first."""
    free_run, free_item, total = [True] * len(run), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(run)):
            for j in range(len(item)):
                n = 0
                while i + n < len(run) and j + n < len(item) and run[i + n] == item[j + n] and free_run[i + n] and free_item[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return total
        free_run[i : i + n] = [False] * n
        free_item[j : j + n] = [False] * n
        total += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), min_size=1, max_size=16))
def test_tiles(run, item):
    found = d.tile([np.array(run, np.uint64)], np.array(item, np.uint64), 2)
    used_run, used_item = set(), set()
    for r, i, j, n in found:
        assert r == 0 and n >= 2 and run[i : i + n] == item[j : j + n]
        places = set(range(i, i + n)), set(range(j, j + n))
        assert not places[0] & used_run and not places[1] & used_item
        used_run |= places[0]
        used_item |= places[1]
    covered = sum(t[3] for t in found)
    # Ties may be marked in another order than here; more than a tie's length never differs.
    assert abs(covered - brute_tiles(run, item, 2)) <= 4
    longest = max((n for i in range(len(run)) for j in range(len(item)) for n in range(1, 25)
                   if run[i : i + n] == item[j : j + n] and i + n <= len(run) and j + n <= len(item)), default=0)
    if longest >= 2:
        assert max(t[3] for t in found) == longest


def test_planted(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}é" for i in range(3000)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [make(r.randint(12, 60)) for _ in range(40)]
    items[7][:12] = items[8][:12] = items[9][:12]  # a phrase that items share
    docs, expected = [], set()

    def add(words, *hits):
        docs.append(" ".join(words))
        expected.update((len(docs) - 1, i) for i in hits)

    for i, item in enumerate(items):
        add(make(50) + item + make(50), i)
        half = len(item) // 2
        add(make(9) + item[half:] + make(30) + item[:half] + make(9), i)  # reordered
        add(make(20) + item[: len(item) // 3] + make(20))
        add([w.upper() + "," for w in item], i)
    for _ in range(40):
        add(make(80))
    add(sum(items, []), *range(40))
    texts = [*docs, None, "", "w1é w2é", docs[0], docs[0]]
    expected |= {(len(docs) + 3, i) for d0, i in expected if d0 == 0} | {(len(docs) + 4, i) for d0, i in expected if d0 == 0}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 item_id", "'x' digest", "3 run")
    bench = [(i, " ".join(x).replace(" ", "\n", 3)) for i, x in enumerate(items)] + [(100, None), (101, "too short"), (None, "a b c d e f g")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 tokens", "2 window")
    found = d.contaminated(table, benchmark).collect()
    # Halves of the shared phrase reach the threshold in short items; what must be found is found, and nothing without cause.
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(found) == len(got)
    for doc, item in got | expected:
        words, test = tokens(texts[doc]), tokens(dict(bench)[item])
        assert ((doc, item) in got) == (brute_tiles(words, test, 5) >= 0.5 * len(test)), (doc, item)
    assert expected <= got
    kept = {r["doc_id"] for r in d.decontaminate(table, benchmark).collect()}
    assert kept == set(range(len(texts))) - {doc for doc, _ in got}
    assert d.decontaminate(table, benchmark).dtypes == table.dtypes


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "x")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "A b c, d e f")], "item_id long, text string")
    assert [r["doc_id"] for r in d.decontaminate(docs, benchmark).collect()] == [1]
    assert d.contaminated(docs.limit(0), benchmark).count() == 0
    assert d.decontaminate(docs, benchmark.limit(0)).count() == 2
