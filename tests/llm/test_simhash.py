import random
import re

import pytest
import xxhash

from facetframe.llm import graph
from facetframe.llm import simhash as s


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return [ids[root(i)] for i in range(len(ids))]


def sample_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()
    texts = [r["text"] for r in rows]
    r = random.Random(2)
    for text in list(texts[:60]):
        words = text.split(" ")
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return [*texts, None, "", " \n ", "One", "one", "two words", "É\x0bx\x1cy \x85z", texts[0], "w " * 70_000]


def test_documents_against_all_pairs(spark):
    texts = sample_texts(spark)
    ids = random.Random(1).sample(range(5000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "'x' fingerprint", "1 _print", "2 _root")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in s.near_duplicates(docs).collect()}
    prints = [fingerprint(t) for t in texts]
    assert {i: g[0] for i, g in got.items()} == {i: f"{p:016x}" for i, p in zip(ids, prints)}
    assert {i: g[1] for i, g in got.items()} == dict(zip(ids, roots(ids, prints)))


@pytest.mark.parametrize("most", [20_000, 3])
def test_links_of_planted_fingerprints(spark, most):
    r = random.Random(9)
    prints = [r.getrandbits(64) for _ in range(150)]
    for base in list(prints[:40]):
        for _ in range(4):
            prints.append(base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))))
    prints += [prints[0] ^ (b << 3) for b in range(40)]  # a crowd under one half
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "_print long")
    found = {r["node"]: r["root"] for r in graph.components(s.links(table, most)).collect()}
    assert [found.get(p, p) for p in signed] == roots(signed, prints)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (300, 100)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_stays(spark):
    rows = [(5, "same text here now", 1), (3, "Same text here now", 2), (3, "same text here now", 2), (None, "same text here now", 3),
            (9, "something quite different from it", 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").selectExpr("*", "'p' _print", "'q' `a.b`")
    got = s.keep_one(docs)
    assert got.dtypes == docs.dtypes
    kept = sorted((str(r["doc_id"]), r["_row"]) for r in got.collect())
    assert kept == [("3", 2), ("9", 4), ("None", 5)]
    assert s.keep_one(docs.limit(0)).count() == 0
    assert s.near_duplicates(docs.limit(0)).count() == 0


def jaccard(one, other):
    a, b = (set(zip(*(t.lower().split()[i:] for i in range(5)))) for t in (one, other))
    return len(a & b) / len(a | b)


def similar_roots(texts):
    """For every component of texts (by Jaccard similarity of 0.8) its first place, by all pairs."""
    sets = [set(zip(*(t.lower().split()[i:] for i in range(5)))) or {tuple(t.lower().split())} for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            if min(len(one), len(sets[j])) >= 0.8 * max(len(one), len(sets[j])) and 5 * len(one & sets[j]) >= 4 * len(one | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {root(i) for i in range(len(texts))}


def test_two_crowds_in_one_band(spark):
    """Members of a band that are not similar to its first text meet each other by their rarest shingles."""
    r = random.Random(9)
    base = [f"c{i}" for i in range(200)]
    texts = []
    for crowd in range(2):
        heart = [*base[:150], *(f"k{crowd}_{i}" for i in range(50))]  # the crowds are some 0.6 similar to each other
        for _ in range(120):
            words = list(heart)
            for _ in range(r.choice([1, 3, 6, 9])):
                words[r.randrange(200)] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(words))
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = similar_roots(texts)
    assert 2 <= len(expected) < 160
    assert {x["doc_id"] for x in s.keep_one(docs).collect()} == expected


def test_stage_keeps_one_of_similar_texts(spark):
    """Texts that are 0.8 similar or more are near copies, however many bits of their fingerprints differ."""
    r = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(120)]
        texts.append(" ".join(base))
        for edits in (1, 2, 2, 4, 8):
            words = list(base)
            for i in range(edits):
                words[r.randrange(120)] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(words))
    base = [f"c{i}" for i in range(300)]  # a crowd around one text
    texts += [" ".join([*base[:i], "y", *base[i + 1 :]]) for i in range(0, 300, 2)]
    some = texts[:72]
    assert sum((fingerprint(x) ^ fingerprint(y)).bit_count() > 3 and jaccard(x, y) >= 0.8 for i, x in enumerate(some) for y in some[:i]) > 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in s.keep_one(docs).collect()} == similar_roots(texts)


def test_stage_finds_candidates_by_fingerprints(spark, monkeypatch):
    """Without any shared band, near copies are still found by their fingerprints, and verified."""
    monkeypatch.setattr(s, "band_keys", lambda hashes: s.np.zeros(0, s.np.int64))
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:-1], "end"]), " ".join([*base, "more"]), "a b c d e f", "f e d c b a"]
    sets = [s.shingles(t) for t in texts]
    assert (s.set_fingerprint(sets[0]) ^ s.set_fingerprint(sets[1])).bit_count() <= s.DISTANCE
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in s.keep_one(docs).collect()} == {0, 3, 4}


def test_crowd_is_not_compared_in_pairs(spark, monkeypatch):
    """Where a crowd lies in many parts, few of its pairs are looked at, by shares first, and no link is lost."""
    r = random.Random(11)
    texts = []
    for _ in range(300):
        words = [f"c{i}" for i in range(200)]
        for _ in range(r.choice([2, 3])):
            words[r.randrange(200)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(s, "band_keys", lambda hashes: s.np.sort(hashes)[: s.BANDS].view(s.np.int64))  # crowded bands
    looked_at, similar = [], s._similar

    def counting(pairs, texts):
        looked_at.append(pairs.count())
        return similar(pairs, texts)

    monkeypatch.setattr(s, "_similar", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in s.keep_one(docs).collect()} == similar_roots(texts)
    assert sum(looked_at[1:]) < 8 * len(texts)


def test_sketches_differ_in_no_more_bits_than_sets(spark):
    r = random.Random(12)
    sets = {i: {r.randrange(60) * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63) for _ in range(30)} for i in range(20)}
    each = spark.createDataFrame([(i, len(x), y) for i, x in sets.items() for y in x], "node long, _n long, _shingle long")
    bits = {x["node"]: x["_bits"] for x in s._sketches(each).collect()}
    differ = lambda i, j: sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(bits[i], bits[j]))
    assert {len(b) for b in bits.values()} == {s.SKETCH}
    assert all(differ(i, j) <= len(sets[i] ^ sets[j]) for i in sets for j in sets)
    assert any(differ(i, j) > 5 for i in sets for j in sets)
