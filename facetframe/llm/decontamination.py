"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased word sequences. Every five-word window of a text gets a running
Karp-Rabin hash; a bit array of bounded size, made from the benchmark's windows, lets
through the windows that may occur there (and a few more). Runs of such windows, with
their words, are all that is kept of a document. An exact join of windows finds the
candidate pairs of text and item; then the shared runs are tiled: the longest
non-overlapping matches are marked again and again, found by running hashes at falling
lengths. The share of the item's words under tiles is its coverage, whatever the order
of the tiles in the document.

An item is looked up by its rarer windows only: to reach the coverage, a document must
share a known number of windows with it, so that many less one of its most frequent
windows need no entry. No pair is lost, and phrases that are common to many items do not
bring all documents together with all items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import whole_text

SHINGLE = 5
COVERAGE = 0.5
#: Bits of the window filter at most; 32 MB. More windows make it less selective, not wrong.
MOST_BITS = 1 << 28
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(r"\w+")


def window_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows of ``length`` tokens."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(_BASE)
    for k in range(length):
        out = out * base + tokens[k : k + n]
    return out


def token_hasher():
    """A function from a text to the 64-bit hashes of its lower-cased words; it remembers frequent words."""
    import xxhash

    known: dict[str, int] = {}

    def tokens(text: str) -> list[int]:
        words = _WORD.findall(text.lower())
        if len(known) > 100_000:
            known.clear()
        out = []
        for word in words:
            h = known.get(word)
            if h is None:
                h = known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
            out.append(h)
        return out

    return tokens


def _slots(windows: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each window in a filter of ``bits`` (a power of two)."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return [(windows * np.uint64(odd)) >> shift for odd in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x9FB21C651E98DF25)]


def passes(table: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Places in ``windows`` of those that the filter lets through."""
    left = np.arange(len(windows))
    for k in range(3):
        slots = _slots(windows[left], len(table) * 64)[k]
        left = left[(table[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1]
    return left


def item_table(benchmark: DataFrame, shingle: int) -> DataFrame:
    """item_id, tokens and windows of every item of at least ``shingle`` words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = token_hasher()
        for batch in batches:
            ids, tokens, windows = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = np.array(tokens_of(text), np.uint64)
                if len(t) >= shingle:
                    ids.append(item)
                    tokens.append(t.view(np.int64))
                    windows.append(window_hashes(t, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(tokens, pa.list_(pa.int64())), pa.array(windows, pa.list_(pa.int64()))],
                names=["item_id", "tokens", "windows"],
            )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.where("item_id IS NOT NULL").select("item_id", whole_text()).mapInArrow(
        read, f"item_id {kind}, tokens array<long>, windows array<long>"
    )


def window_filter(items: DataFrame) -> np.ndarray:
    """The bit array of all windows. It is put together from 64-bit words, of which there are at most MOST_BITS / 64."""
    count = items.agg(F.coalesce(F.sum(F.size("windows")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, 1 << max(10, int(64 * max(1, count) - 1).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy().view(np.uint64)
            places = np.unique(np.concatenate(_slots(flat, bits)))
            at, first = np.unique(places >> np.uint64(6), return_index=True)
            values = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first) if len(at) else places
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(values.view(np.int64))], names=["at", "word"])

    found = items.select("windows").mapInArrow(words, "at long, word long").groupBy("at").agg(F.expr("bit_or(word)").alias("word")).toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[found["at"].to_numpy()] = found["word"].to_numpy(np.int64).view(np.uint64)
    return table


def shared_runs(docs: DataFrame, filter_words: np.ndarray, shingle: int) -> DataFrame:
    """doc_id, digest, run, start, tokens and windows of the runs that may occur in the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_words)  # at most MOST_BITS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        tokens_of, table = token_hasher(), shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lists = [tokens_of(t) for t in texts]
            sizes = np.array([len(t) for t in lists], np.int64)
            ends = np.cumsum(sizes)
            flat = np.fromiter((h for t in lists for h in t), np.uint64, int(ends[-1]) if len(ends) else 0)
            windows = window_hashes(flat, shingle)
            places = passes(table, windows)
            owner = np.searchsorted(ends, places, side="right")
            inside = places + shingle <= ends[owner] if len(places) else np.zeros(0, bool)  # not across two texts
            places, owner = places[inside], owner[inside]
            breaks = np.flatnonzero((np.diff(places) != 1) | (np.diff(owner) != 0)) + 1
            out: list[list] = [[], [], [], [], [], []]
            run, last = 0, -1
            for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(places)]):
                if a == b:
                    continue
                row, low, high = int(owner[a]), int(places[a]), int(places[b - 1]) + 1
                run, last = (run + 1 if row == last else 0), row
                values = (
                    batch.column(0)[row].as_py(), hashlib.md5(texts[row].encode("utf-8", "surrogatepass")).hexdigest(), run,
                    low - int(ends[row] - sizes[row]), flat[low : high + shingle - 1].view(np.int64), windows[low:high].view(np.int64),
                )
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "digest", "run", "start", "tokens", "windows"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text()).mapInArrow(
        read, f"doc_id {kind}, digest string, run int, start int, tokens array<long>, windows array<long>"
    )


def tile(runs: list[np.ndarray], item: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Greedy string tiling of ``item`` with ``runs``: (run, place in run, place in item, length).

    The search length starts at the item's and is halved down to ``least``; a much longer
    match than looked for sends it up again. Matches are marked from the longest down.
    """
    free_runs, free_item = [np.ones(len(r), bool) for r in runs], np.ones(len(item), bool)
    tiles: list[tuple[int, int, int, int]] = []
    length = max(least, min(len(item), max((len(r) for r in runs), default=0)))
    while True:
        longest, found = 0, []
        at: dict[int, list[int]] = {}
        for j, h in enumerate(window_hashes(item, length).tolist()):
            if free_item[j : j + length].all():
                at.setdefault(h, []).append(j)
        for r, run in enumerate(runs):
            for i, h in enumerate(window_hashes(run, length).tolist()):
                for j in at.get(h, ()) if free_runs[r][i : i + length].all() else ():
                    n = 0
                    while i + n < len(run) and j + n < len(item) and run[i + n] == item[j + n] and free_runs[r][i + n] and free_item[j + n]:
                        n += 1
                    if n >= length:
                        found.append((n, r, i, j))
                        longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        for n, r, i, j in sorted(found, key=lambda f: (-f[0], *f[1:])):
            if free_runs[r][i : i + n].all() and free_item[j : j + n].all():
                free_runs[r][i : i + n] = False
                free_item[j : j + n] = False
                tiles.append((r, i, j, n))
        if length == least:
            # Matches cut short by marks of this round may still hold free parts of the least length.
            if not found:
                return tiles
        else:
            length = max(least, length // 2)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, shingle: int = SHINGLE) -> DataFrame:
    """Pairs of documents and benchmark items they cover: doc_id, digest (md5 of the text), item_id, coverage, tiles.

    A pair is reported if tiles of at least ``shingle`` words cover at least ``coverage``
    of the item's words. Null and empty texts share nothing; items without an id or with
    fewer than ``shingle`` words are skipped. Equal texts are tiled once and reported for
    every row. Empty tables give no rows.
    """
    items = cut_lineage(item_table(benchmark, shingle))
    runs = cut_lineage(shared_runs(docs, window_filter(items), shingle))
    entries = items.select("item_id", F.size("tokens").alias("size"), F.explode("windows").alias("window"))
    common = entries.select("item_id", "window").distinct().groupBy("window").agg(F.count(F.lit(1)).alias("items"))
    ranked = entries.join(common, "window").selectExpr(
        "item_id", "window", "size", "row_number() OVER (PARTITION BY item_id ORDER BY items DESC, window) AS rank"
    )
    # Windows beyond the most frequent ones that a covered item can do without.
    index = cut_lineage(ranked.where(F.col("rank") >= F.ceil(F.col("size") * coverage / shingle)).select("item_id", "window").distinct())
    texts = runs.dropDuplicates(["digest", "run"]).select("digest", "run", "tokens", "windows")
    texts = cut_lineage(texts)
    seeds = texts.select("digest", "run", F.explode("windows").alias("window"))
    pairs = cut_lineage(seeds.select("digest", "window").distinct().join(index, "window").select("digest", "item_id").distinct())
    near = (
        pairs.join(items.select("item_id", F.explode("windows").alias("window")), "item_id")
        .join(seeds, ["digest", "window"]).select("digest", "item_id", "run").distinct()
    )
    grouped = (
        near.join(texts.select("digest", "run", "tokens"), ["digest", "run"])
        .groupBy("digest", "item_id").agg(F.sort_array(F.collect_list(F.struct("run", "tokens"))).alias("runs"))
        .join(items.select("item_id", F.col("tokens").alias("item")), "item_id")
        .select("digest", "item_id", F.transform("runs", lambda r: r["tokens"]).alias("runs"), "item")
    )

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shares, counts = [], []
            for found, item in zip(batch["runs"], batch["item"]):
                tiles = tile([np.asarray(r, np.int64).view(np.uint64) for r in found], np.asarray(item, np.int64).view(np.uint64), shingle)
                shares.append(sum(t[3] for t in tiles) / len(item))
                counts.append(len(tiles))
            out = batch[["digest", "item_id"]].assign(coverage=shares, tiles=counts)
            yield out[out["coverage"] >= coverage]

    kind = benchmark.schema["item_id"].dataType.simpleString()
    covered = cut_lineage(grouped.mapInPandas(cover, f"digest string, item_id {kind}, coverage double, tiles long"))
    return runs.where("run = 0").select("doc_id", "digest").join(covered, "digest").select("doc_id", "digest", "item_id", "coverage", "tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, shingle: int = SHINGLE) -> DataFrame:
    """The documents that cover no benchmark item, with all their columns. Decisions go by text, so null ids do not matter."""
    found = cut_lineage(contaminated(docs, benchmark, coverage, shingle).select(F.col("digest").alias("_digest")).distinct())
    digest = F.md5(whole_text().cast("binary"))
    return docs.join(found, digest == found["_digest"], "left_anti")
