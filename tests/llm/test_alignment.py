import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from facetframe.llm import alignment
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """Rows in the order of ``texts``, by comparing all tokens' byte ranges."""
    one, other = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    printing = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printing)}
    found, counts = [], Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = other.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in one.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(other.id_to_piece(i)[3:5], 16)]) if other.is_byte(i) else other.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            found.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in a_bytes]).tolist(), np.cumsum([len(t) for t in b_bytes]).tolist()
        links = [
            (a[i], b[j]) for i in range(len(a)) for j in range(len(b))
            if max(ends_a[i] - len(a_bytes[i]), ends_b[j] - len(b_bytes[j])) < min(ends_a[i], ends_b[j])
        ]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            u, v = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[i:u])) + "|" + ",".join(map(str, b[j:v])))
            i, j = u, v
        counts.update(set(links))
        found.append((a, b, groups, links))
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    return [
        (len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for a, b, groups, links in found
    ]


TEXTS = [
    "The quick brown fox's den, 12345 times.", "", None, " ", "  two  blanks ", "naïve café — 東京 🙂\n\nline\ttab", "<|endoftext|> and <s> are text",
    "▁ is not given back", "x" * 3000, "The quick brown fox", "The quick brown fox", "aaaa bbbb " * 200, "\x00 nul", "é" * 50, "é combining",
    "<0x41> <unk>", "def f(x):\n    return x ** 2  # comment\n" * 20, "…" * 7,
]


@pytest.mark.parametrize("most", [alignment.MOST, 20, 0])
def test_against_all_pairs(spark, most):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 pairs", "'q' row", "2 n_a", "'z' `a.b`")
    rows = sorted(alignment.align_documents(docs, A, B, most).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r[c] for c in COLUMNS) for r in rows] == brute([t or "" for t in TEXTS])


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 2500")
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(docs, A, B, 500).collect()}
    data = docs.collect()
    assert len(data) > 50
    assert [rows[r["doc_id"]] for r in data] == brute([r["text"] for r in data])


def test_edge_tables(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text"), (None, None)], "doc_id long, text string")
    rows = alignment.align_documents(docs, A, B).collect()
    assert sorted((str(r["doc_id"]), r["n_a"], r["count_sum"] == 3 * r["n_links"]) for r in rows) == [("1", 2, True), ("1", 2, True), ("None", 0, True), ("None", 2, True)]
    assert alignment.align_documents(docs.limit(0), A, B).count() == 0
    assert alignment.align_documents(docs.where("text IS NULL"), A, B).count() == 1


def test_very_long_text(spark):
    text = " ".join(f"word{i % 977} and, {i}" for i in range(60_000))
    [row] = alignment.align_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).collect()
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] == row["count_sum"] and row["n_a"] > 200_000


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)), st.integers(-5, 400))
def test_gallop(one, other, guess):
    short, long = np.array(sorted(one), np.int64), np.array(sorted(other), np.int64)
    got = alignment.gallop(short, long, np.full(len(short), guess))
    assert got.tolist() == np.searchsorted(long, short).tolist()
