import zlib
from collections import Counter, defaultdict

import numpy as np

from facetframe.llm import sharding as s


def sharded(docs, **kw):
    return s.shard(docs, **kw).collect()


def check(rows, texts, tolerance):
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) == len(by_id)
    for i, text in enumerate(texts):
        data = (text or "").encode()
        assert (by_id[i]["size"], by_id[i]["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(sizes.values()) / 8
    assert max(abs(sizes[k] - mean) for k in range(8)) <= tolerance * mean
    return by_id


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.collect()]
    by_id = check(sharded(docs.selectExpr("*", "1 shard", "2 size", "3 _parts", "4 tokens")), texts, 0.001)
    shards = defaultdict(set)
    for i, t in enumerate(texts):
        shards[t].add(by_id[i]["shard"])
    assert all(len(v) == 1 for v in shards.values())  # no group is heavy here
    tokens = Counter()
    for r in by_id.values():
        tokens[r["shard"]] += r["tokens"]
    assert max(tokens.values()) < 1.1 * min(tokens.values())


def test_a_group_with_most_rows_is_cut(spark):
    texts = ["the same text " * 5] * 1500 + [f"text number {i} " * (1 + i % 7) for i in range(900)] + [None, ""] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    by_id = check(sharded(docs, cells=256, heavy=512), texts, 0.02)
    assert len({by_id[i]["shard"] for i in range(1500)}) == 8


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a")], "doc_id long, text string")
    rows = sharded(docs)
    assert Counter(r["doc_id"] for r in rows) == {1: 2, None: 1}
    assert sharded(docs.limit(0)) == []
    assert s.shard(docs.limit(0)).columns == s.shard(docs).columns


def test_dot_product_prefers_what_is_missing():
    got = s.place(np.array([[10.0, 0, 1], [9, 9, 1], [1, 10, 1]]), 2)
    assert got[0] != got[1] and len(got) == 3


def test_a_heavy_group_without_ids_is_cut_too(spark):
    docs = spark.createDataFrame([(None, "same text")] * 400 + [(i, f"other {i}") for i in range(100)], "doc_id long, text string")
    rows = sharded(docs)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 8
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.2 * min(sizes.values())
