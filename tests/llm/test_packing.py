import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from facetframe.llm import packing as p

FILE = public_tokenizers.path("byte_bpe_50k.json")


def layout(places):
    bins = defaultdict(list)
    for q in places:
        for i in range(q.count):
            bins[q.sequence + i].append((q.offset, q.length))
    return bins


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(0, 30), max_size=12))
def test_plan_is_gapless_and_complete(histogram):
    places = p.plan(histogram, 24)
    bins = layout(places)
    for content in bins.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= 24
    for length, n in histogram.items():
        ranks = sorted(r for q in places if q.length == length for r in range(q.first, q.first + q.count))
        assert ranks == list(range(n))
    assert sorted(bins) == list(range(len(bins)))
    total = sum(k * n for k, n in histogram.items())
    large = sum(n for k, n in histogram.items() if 3 * k > 24)
    assert len(bins) >= max(-(-total // 24), -(-large // 2))
    # First-fit decreasing is never much better on these sizes.
    loads = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        i = next((i for i, x in enumerate(loads) if x + length <= 24), None)
        if i is None:
            loads.append(length)
        else:
            loads[i] += length
    assert len(bins) <= 1.25 * len(loads) + 1


def test_work_does_not_grow_with_the_counts():
    assert len(p.plan({k: 10**12 + k for k in range(1, 1025)})) < 10_000


def test_round_trip(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", "x", "x", "a <|endoftext|> b", "é" * 3000, "word " * 5000, " \n\t ", "don't 12345!!"]
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "7 length", "8 piece", "9 _rank")
    rows = p.pack(docs, FILE).collect()
    tokenizer = Tokenizer.from_file(FILE)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in zip(ids, texts):
        flat = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        found = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(len(found)))
        assert [r["start"] for r in found] == [0, *np.cumsum([r["length"] for r in found])[:-1].tolist()]
        assert sum(r["length"] for r in found) == len(flat)
        assert all(r["length"] == 1024 for r in found[1:])
        for r in found:
            assert r["ids_crc32"] == zlib.crc32(flat[r["start"] : r["start"] + r["length"]].tobytes())
    for content in bins.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= sum(r["length"] for r in rows) / 1024 * 1.02 + 2
    assert p.pack(docs.limit(0), FILE).count() == 0


def test_repeated_rows_are_packed_one_by_one(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (None, "same")], "doc_id long, text string")
    assert Counter(r["doc_id"] for r in p.pack(docs, FILE).collect()) == {1: 2, None: 1}
