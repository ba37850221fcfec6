"""Best-fit packing of tokenised documents into sequences, with matching of large items.

Documents longer than a sequence are cut into full pieces (the first may be shorter).
What is left has at most ``capacity`` different lengths, so the packing is worked out
on the *histogram* of lengths: an item above a third of the capacity is large, at most
two of them fit together, and they are paired greedily from the longest down, each with
the longest partner that still fits. Smaller items then go, longest first, into the
smallest gap that holds them. The plan is a list of (length, rank range) to (sequence
range, offset) and has a few thousand rows at any number of documents; tasks look their
pieces up in it. Only counts per length reach the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import extended, numbered, whole_text

CAPACITY = 1024
END_ID = 2


class Placement(NamedTuple):
    """Pieces of ``length`` with ranks from ``first`` on: the i-th goes to sequence ``sequence + i`` at ``offset``."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Place ``histogram[length]`` pieces of every length; sequences are numbered from 0.

    Kinds of sequences with equal contents are handled together, so the work depends
    on the number of lengths and not on the number of pieces.
    """
    rest = {length: n for length, n in histogram.items() if n > 0}
    if any(length < 1 or length > capacity for length in rest):
        raise ValueError("a piece must have from 1 to capacity tokens")
    taken = dict.fromkeys(rest, 0)
    kinds: list[tuple[int, list[tuple[int, int]]]] = []  # how many sequences, and their (length, first rank)
    gaps: dict[int, list[int]] = {}  # free tokens -> kinds
    sizes: list[int] = []  # the free sizes in order

    def take(length: int, n: int) -> int:
        first = taken[length]
        taken[length] += n
        rest[length] -= n
        return first

    def add(n: int, content: list[tuple[int, int]]) -> None:
        free = capacity - sum(length for length, _ in content)
        kinds.append((n, content))
        if free:
            if free not in gaps:
                insort(sizes, free)
            gaps.setdefault(free, []).append(len(kinds) - 1)

    large = sorted((length for length in rest if 3 * length > capacity), reverse=True)
    for length in large:
        while rest[length]:
            partner = next((p for p in large if p <= capacity - length and p <= length and rest[p] > (p == length)), None)
            if partner is None:
                n = rest[length]
                add(n, [(length, take(length, n))])
            elif partner == length:
                n = rest[length] // 2
                add(n, [(length, take(length, n)), (length, take(length, n))])
            else:
                n = min(rest[length], rest[partner])
                add(n, [(length, take(length, n)), (partner, take(partner, n))])
    for length in sorted((length for length in rest if 3 * length <= capacity), reverse=True):
        while rest[length]:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                each = capacity // length
                n, more = divmod(rest[length], each)
                if n:
                    add(n, [(length, take(length, n)) for _ in range(each)])
                if more:
                    add(1, [(length, take(length, 1)) for _ in range(more)])
                continue
            free = sizes[at]
            kind = gaps[free].pop()
            if not gaps[free]:
                del gaps[free]
                sizes.pop(at)
            n, content = kinds[kind]
            fill = min(n, rest[length])
            first = take(length, fill)
            if fill < n:  # the others of this kind stay as they are, with ranks after the filled ones
                kinds[kind] = (0, [])
                add(n - fill, [(size, start + fill) for size, start in content])
            else:
                kinds[kind] = (0, [])
            add(fill, [*content, (length, first)])
    placed, sequence = [], 0
    for n, content in kinds:
        if not n:
            continue
        offset = 0
        for length, first in content:
            placed.append(Placement(length, first, n, sequence, offset))
            offset += length
        sequence += n
    return placed


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise whole texts and cut them: doc_id, piece, start, length, ids_crc32.

    ``tokenizer`` names a byte-level BPE file on every executor. A null or empty text
    is the closing id alone. Ids are those of the file's own tokenizer; texts without
    its special strings take a faster implementation of the same merges.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json
        import zlib

        import tiktoken
        from tokenizers import Tokenizer

        exact = None  # made when a text needs it
        with open(tokenizer, encoding="utf-8") as file:
            described = json.load(file)
        special = [x["content"] for x in described["added_tokens"]]
        # Byte-level vocabularies show bytes as printable characters: those that print stand for themselves.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {
            bytes(byte_of[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special
        }
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the vocabulary's
        fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        del described, ranks
        for batch in batches:
            ids, pieces, starts, lengths, sums = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if any(s in text for s in special):
                    exact = exact or Tokenizer.from_file(tokenizer)
                    tokens = exact.encode(text, add_special_tokens=False).ids
                else:
                    tokens = fast.encode_ordinary(text)
                flat = np.append(np.asarray(tokens, dtype="<u4"), np.uint32(END_ID)).astype("<u4")
                head = len(flat) % capacity if len(flat) > capacity else len(flat)
                edges = [0, *range(head or capacity, len(flat) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    ids.append(doc_id)
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(flat[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text()).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents: one row per piece with its sequence_id and offset.

    Null or empty text: one piece of one token (the closing id). Repeated rows are
    packed one by one. No documents: no rows. Columns other than doc_id and text play
    no part and are not returned.
    """
    pieces = numbered(token_pieces(docs, tokenizer, capacity), "length", "_rank")
    pieces = cut_lineage(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_length: dict[int, list[Placement]] = {}
    for p in plan(histogram, capacity):
        by_length.setdefault(p.length, []).append(p)
    lookup = {}
    for length, places in by_length.items():
        places.sort(key=lambda p: p.first)
        lookup[length] = tuple(np.array([p[k] for p in places], np.int64) for k in (1, 3, 4))
    shared = docs.sparkSession.sparkContext.broadcast(lookup)  # a few rows per possible length
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = extended(pieces.select(*names), "sequence_id long, offset long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            lengths, ranks = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                first, base, at = found[length]
                k = np.searchsorted(first, ranks[rows], side="right") - 1
                sequence[rows] = base[k] + ranks[rows] - first[k]
                offset[rows] = at[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    return pieces.select(*names, "_rank").mapInArrow(place, schema)
