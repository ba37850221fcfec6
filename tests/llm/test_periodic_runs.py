import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from facetframe.llm import periodic_runs as p
from hypothesis import given, settings
from hypothesis import strategies as st


def words_of(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]
    return words


def brute_runs(words):
    """All runs by trying every period at every place."""
    n, runs = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                runs.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in runs.items())


def brute(doc_id, text, plant=True):
    words = words_of(doc_id, text, plant)
    runs = brute_runs(words)
    dropped = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1])) if runs else None
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
        digest("".join(f"{s},{length},{q}\n" for s, q, length in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def result(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("first", [8, 16, p.FIRST])
def test_against_brute_force(spark, first):
    r = random.Random(first)
    texts = ["", None, " \n\t ", "one", "a " * 5, "a " * 6, "a " * 5000, "a b " * 900, "a b a b a b a", "x\xa0y " * 8, "é ü " * 4]
    for _ in range(120):
        words, n = [], r.choice([3, 50, 400, 1500])
        while len(words) < n:
            period = r.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 63, 64, 65, 127, 130])
            unit = [r.choice("abc") if r.random() < 0.5 else f"w{r.randrange(60)}" for _ in range(period)]
            words += (unit * 12)[: int(period * r.choice([1, 2, 3.9, 4, 4.2, 6, 11]))]
            if r.random() < 0.3:
                words += words[-r.randrange(1, 40) :]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 row", "2 period", "'x' `a.b`")
    got = result(p.collapse_runs(docs, True, first))
    assert got == {i: brute(i, t) for i, t in enumerate(texts)}
    assert sum(x[0] > 0 for x in got.values()) > 60


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 12000")
    got = result(p.collapse_runs(docs, True))
    assert got == {r["doc_id"]: brute(r["doc_id"], r["text"]) for r in docs.collect()}
    assert sum(x[0] for x in got.values()) > 5
    plain = result(p.collapse_runs(docs))
    assert plain == {r["doc_id"]: brute(r["doc_id"], r["text"], False) for r in docs.collect()}


def test_edge_tables(spark):
    docs = spark.createDataFrame([(1, "b a b a b a b a"), (1, "b a b a b a b a"), (None, None), (None, "a a a a a a")], "doc_id long, text string")
    rows = p.collapse_runs(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_runs"], r["length"], r["period"]) for r in rows if r["n_runs"]) == [("1", 1, 8, 2), ("1", 1, 8, 2), ("None", 1, 6, 1)]
    assert len(rows) == 4 and p.collapse_runs(docs.limit(0), True).count() == 0


def test_long_text_with_long_period(spark):
    """300,000 words: a period of 50,000 and, inside it, one word repeated."""
    unit = [f"w{i * i % 100_003}" for i in range(50_000)]
    unit[777:877] = ["same"] * 100
    docs = spark.createDataFrame([(3, " ".join(["start", *(unit * 6)[:290_000], "end"])), (4, "go " * 200_000)], "doc_id long, text string")
    got = result(p.collapse_runs(docs))
    assert got[3][0] == 7 and got[3][1:5] == (1 + 777, 100, 1, 100_000) and got[4][:5] == (1, 0, 200_000, 1, 200_000_000)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=90), st.integers(0, 90), st.sampled_from([2, 4, 8]))
def test_tile(window, boundary, octave):
    """Fragments are the stretches around the boundary, cut at two octaves, for periods that are no multiple."""
    boundary = min(boundary, len(window))
    got = {q: (i, j) for q, i, j in p.solve_tile(window, boundary, octave)}
    for q in range(octave, 2 * octave):
        low = high = boundary
        while low > max(0, boundary - 2 * octave) and low - 1 + q < len(window) and window[low - 1] == window[low - 1 + q]:
            low -= 1
        while high < boundary + 2 * octave and high + q < len(window) and window[high] == window[high + q]:
            high += 1
        if high - low >= 2 * octave:
            stretch = window[low : high + q]
            primitive = not any(q % d == 0 and all(a == b for a, b in zip(stretch, stretch[d:])) for d in range(1, q))
            assert (q in got) == primitive
            assert not primitive or got[q] == (low, high)
        else:
            assert q not in got


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.integers(1, 5))
def test_intervals(equal, least):
    low, high = p.intervals(np.array(equal, bool), least)
    text = "".join("ft"[x] for x in equal)
    assert list(zip(low.tolist(), high.tolist())) == [m.span() for m in re.finditer("t+", text) if len(m[0]) >= least]
