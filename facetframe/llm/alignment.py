"""Alignment of two tokenizers' tokens over the bytes of the same text.

Both tokenizers cut a text's bytes into tokens, so each gives an increasing list of end
offsets. The shorter list is looked up in the longer by galloping: from a guessed place
in steps that double until the value is passed, then by binary search between the last
two steps. Ends found in both lists cut the tokens into groups. The ranks of
neighbouring ends differ by the number of tokens that a token overlaps, so all links come
from the ranks, without a second search. All documents of a batch gallop together, as
whole-array steps.

How many documents link a pair of ids is counted by a shuffle of pairs that are distinct
in a document. Counts are looked up in two ways that together are exact: pairs with high
counts (at most ``MOST`` of them) are sent to the tasks as sorted arrays; the others have
low counts, so a join on the pair has no hot key and moves only their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import whole_text

#: Pairs whose counts are sent to every task; 16 bytes each.
MOST = 500_000
#: Bytes of text that are aligned together; a longer text is aligned alone.
TOGETHER = 2_000_000


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each of ``short`` the number of entries of sorted ``long`` below it, searched outwards from ``guess``.

    Steps from the guess double until the value lies between the last two places; a
    binary search between them follows.
    """
    n = len(long)
    low, high = np.zeros(len(short), np.int64), np.full(len(short), n, np.int64)  # the answer is in [low, high]
    if not n or not len(short):
        return low
    at = np.clip(guess, 0, n - 1)
    right = long[at] < short
    going, step = np.arange(len(short)), 1
    low[right], high[~right] = at[right] + 1, at[~right]
    while len(going):
        ahead = right[going]
        place = np.where(ahead, at[going] + step, at[going] - step)
        inside = (place >= 0) & (place < n)
        going, place, ahead = going[inside], place[inside], ahead[inside]
        below = long[place] < short[going]
        low[going[below]] = np.maximum(low[going[below]], place[below] + 1)
        high[going[~below]] = np.minimum(high[going[~below]], place[~below])
        going = going[below == ahead]
        step *= 2
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        below = long[middle] < short[going]
        low[going[below]], high[going[~below]] = middle[below] + 1, middle[~below]
        going = going[low[going] < high[going]]
    return low


def joint(one: np.ndarray, other: np.ndarray, one_docs: np.ndarray, other_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of ``one``'s ends in ``other``'s, and which of them are there. Documents' slices are given by their starts.

    Ends increase over all documents. Within a document the guess is the place in proportion.
    """
    sizes, lengths = np.diff(one_docs), np.diff(other_docs)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(one)) - one_docs[doc]
    ranks = gallop(one, other, other_docs[doc] + inside * lengths[doc] // np.maximum(sizes[doc], 1))
    common = np.zeros(len(one), bool)
    there = ranks < len(other)
    common[there] = other[ranks[there]] == one[there]
    return ranks, common


def overlaps(ranks: np.ndarray, common: np.ndarray, docs: np.ndarray, other_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping (token, other token) as two index lists, from the ranks of the tokens' ends."""
    if not len(ranks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(len(ranks), np.int64)
    first[1:] = ranks[:-1] + common[:-1]
    starts = docs[:-1][np.diff(docs) > 0]
    first[starts] = other_docs[:-1][np.diff(docs) > 0]
    counts = ranks - first + 1
    token = np.repeat(np.arange(len(ranks)), counts)
    return token, np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts) + first[token]


def digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to size - 1 as right-aligned rows with one free place at the end, and their lengths with it."""
    width = len(str(max(size - 1, 0)))
    numbers = np.arange(size)
    table = np.zeros((size, width + 1), np.uint8)
    for place in range(width):
        table[:, width - 1 - place] = 48 + numbers // 10**place % 10
    return table, np.maximum(1, np.searchsorted(10 ** np.arange(width), numbers, side="right")) + 1


def spelled(a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray, table: np.ndarray, lengths: np.ndarray):
    """The groups of all documents as bytes, ``a1,a2|b1;``, and the end of every token in them.

    ``a_stops`` and ``b_stops`` hold the index after each group's last token.
    """
    group_a = np.repeat(np.arange(len(a_stops)), np.diff(a_stops, prepend=0))
    group_b = np.repeat(np.arange(len(b_stops)), np.diff(b_stops, prepend=0))
    before = np.concatenate([[0], b_stops])
    at_a, at_b = np.arange(len(a)) + before[group_a], np.arange(len(b)) + a_stops[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[a_stops - 1]], mark[at_b[b_stops - 1]] = ord("|"), ord(";")
    shown = table[ids]
    shown[:, -1] = mark
    sizes = lengths[ids]
    return shown[np.arange(table.shape[1]) >= table.shape[1] - sizes[:, None]], np.cumsum(sizes)


def vocabularies(byte_level: str, pieces: str):
    """Both tokenizers: functions from texts to ids, and the bytes of every id."""
    import json

    import sentencepiece
    import tiktoken

    with open(byte_level, encoding="utf-8") as file:
        described = json.load(file)
    special = {x["content"]: x["id"] for x in described["added_tokens"]}
    # Byte-level vocabularies show bytes as printable characters: those that print stand for themselves.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the vocabulary's
    one = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    a_bytes = [b""] * (1 + max([*ranks.values(), *special.values()]))
    for token, i in ranks.items():
        a_bytes[i] = token
    other = sentencepiece.SentencePieceProcessor(model_file=pieces)
    b_bytes = []
    for i in range(other.get_piece_size()):
        piece = other.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if other.is_byte(i) else piece.replace("▁", " ").encode())
    return one.encode_ordinary, lambda text: other.encode(text, num_threads=1) if isinstance(text, list) else other.encode(text), a_bytes, b_bytes


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs with their links.

    A pair is written as ``a * (size of B) + b``.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        encode_a, encode_b, a_bytes, b_bytes = vocabularies(byte_level, pieces)
        a_size, b_size = (np.array([len(t) for t in x], np.int64) for x in (a_bytes, b_bytes))
        table, lengths = digits(max(len(a_bytes), len(b_bytes)))

        def tokens(text: str) -> tuple[np.ndarray, np.ndarray, int]:
            if text:
                whole = (" " + text).encode()
                a, b = encode_a(" " + text), encode_b(text)
                if b"".join([a_bytes[i] for i in a]) == whole and b"".join([b_bytes[i] for i in b]) == whole:
                    return np.asarray(a, np.int64), np.asarray(b, np.int64), len(whole)
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def together(texts: list[str]) -> list[pa.Array]:
            found = [tokens(t) for t in texts]
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            a_docs, b_docs = (np.cumsum([0, *(len(f[k]) for f in found)]) for k in (0, 1))
            ends_a, ends_b = np.cumsum(a_size[a]), np.cumsum(b_size[b])  # both lists of a document end at the same place
            doc_a, doc_b = (np.repeat(np.arange(len(texts)), np.diff(x)) for x in (a_docs, b_docs))
            # The shorter list of each document looks into the longer.
            short = np.diff(a_docs) <= np.diff(b_docs)
            token_a, token_b, stops_a, stops_b = [], [], [], []
            for chosen, one_ends, other_ends, one_doc, other_doc, into in (
                (short, ends_a, ends_b, doc_a, doc_b, (token_a, token_b, stops_a, stops_b)),
                (~short, ends_b, ends_a, doc_b, doc_a, (token_b, token_a, stops_b, stops_a)),
            ):
                one_at, other_at = np.flatnonzero(chosen[one_doc]), np.flatnonzero(chosen[other_doc])
                slices = [np.concatenate([[0], np.cumsum(np.bincount(d[at], minlength=len(texts)))]) for d, at in ((one_doc, one_at), (other_doc, other_at))]
                ranks, common = joint(one_ends[one_at], other_ends[other_at], *slices)
                mine, theirs = overlaps(ranks, common, *slices)
                into[0].append(one_at[mine])
                into[1].append(other_at[theirs])
                into[2].append(one_at[common] + 1)
                into[3].append(other_at[ranks[common]] + 1)
            at_a, at_b = np.concatenate(token_a), np.concatenate(token_b)
            a_stops, b_stops = np.sort(np.concatenate(stops_a)), np.sort(np.concatenate(stops_b))
            text, ends = spelled(a, b, a_stops, b_stops, table, lengths)
            text, stops = text.tobytes(), np.concatenate([[0], ends])[a_docs + b_docs].tolist()
            shas = [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(stops, stops[1:])]
            n_groups = np.bincount(doc_a[a_stops - 1], minlength=len(texts))
            n_links = np.bincount(doc_a[at_a], minlength=len(texts))
            width = len(a_bytes) * len(b_bytes)
            pair, times = np.unique(doc_a[at_a] * width + a[at_a] * len(b_bytes) + b[at_b], return_counts=True)
            offsets = pa.array(np.searchsorted(pair, np.arange(len(texts) + 1) * width).astype(np.int32))
            return [
                *(pa.array(x.astype(np.int64)) for x in (np.diff(a_docs), np.diff(b_docs), n_groups, n_links)), pa.array(shas),
                pa.ListArray.from_arrays(offsets, pa.array(pair % width)),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            ]

        for batch in batches:
            texts, low = batch.column(1).to_pylist(), 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= TOGETHER):
                    size += len(texts[high])
                    high += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), *together(texts[low:high])],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                low = high

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text()).mapInArrow(
        align,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<int>",
    )


def align_documents(docs: DataFrame, byte_level: str, pieces: str, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``byte_level`` names a byte-level BPE file (A, over space + text) and ``pieces`` a
    sentencepiece model (B, which adds the space itself); every executor reads both.
    Groups end where tokens of both end. A link is a pair of token occurrences with
    overlapping bytes. A pair of ids counts the documents that link it; n_best is how
    many links have the highest count of their A id (ties included), count_sum the sum of
    counts over links.

    Texts that are null, empty, or not given back byte by byte by both tokenizers have no
    tokens: zeros, and an empty string for the digest. Special tokens' strings are plain
    text. Repeated rows count as documents of their own, also with equal or null ids. No
    documents: no rows. Other columns play no part and are not returned. A task needs
    some 300 bytes a token of the longest text.
    """
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    rows = cut_lineage(aligned(docs, byte_level, pieces).withColumn("row", F.monotonically_increasing_id()))
    counts = cut_lineage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy(F.expr(f"pair div {b_size}").alias("a")).agg(F.max("n").alias("n")).collect()  # a row per id of A
    highest = np.zeros(1 + max([0, *(r["a"] for r in best)]), np.int64)
    for r in best:
        highest[r["a"]] = r["n"]
    # From which count on the pairs are at most ``most``: counts by powers of two, at most 63 rows.
    sizes = {r["k"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, total = 1 << 62, 0
    for k in range(62, -1, -1):
        total += sizes.get(k, 0)
        if total > most:
            break
        least = 1 << k
    frequent = counts.where(F.col("n") >= least).toArrow()
    pair, n = (frequent.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(pair)
    known = docs.sparkSession.sparkContext.broadcast((pair[order], n[order], highest))  # 16 bytes of at most ``most`` pairs
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, highest = known.value
        for batch in batches:
            lists = batch.column(len(names))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            mine = lists.flatten().to_numpy()
            times = batch.column(len(names) + 1).flatten().to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            at = np.searchsorted(pair, mine)
            found = at < len(pair)
            found[found] = pair[at[found]] == mine[found]
            count = np.zeros(len(mine), np.int64)
            count[found] = n[at[found]]
            is_best = found & (count == highest[mine // b_size])

            def summed(values: np.ndarray) -> np.ndarray:
                running = np.concatenate([[0], np.cumsum(values)])
                return running[offsets[1:]] - running[offsets[:-1]]

            left = np.concatenate([[0], np.cumsum(~found)])[offsets].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(summed(is_best * times)), pa.array(summed(count * times)),
                 pa.ListArray.from_arrays(pa.array(left), pa.array(mine[~found])),
                 pa.ListArray.from_arrays(pa.array(left), pa.array(times[~found]))],
                names=[*names, "best", "total", "pairs", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    partly = cut_lineage(rows.select(*names, "pairs", "times").mapInArrow(
        look_up,
        f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best long, total long, "
        "pairs array<bigint>, times array<bigint>",
    ))
    tops = docs.sparkSession.createDataFrame([(int(r["a"]), int(r["n"])) for r in best], "a long, top long")
    rare = counts.where(F.col("n") < least).join(tops, F.expr(f"pair div {b_size}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("is_best"))
    rest = (
        partly.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e"))
        .select("row", "e.pairs", "e.times").join(cut_lineage(rare), F.col("pairs") == F.col("pair"))
        .groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
    )
    return partly.drop("pairs", "times").join(cut_lineage(rest), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("total") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
