"""Periodic runs of words, found in tiles per octave of periods and stitched by Spark.

A run of period q is a stretch of words in which words q apart are equal. With M_q the
places i where word i equals word i + q, a run is an interval of M_q, and q more words.

For every octave [P, 2P) of periods a document has a boundary at each multiple of P, with
a tile of words around it that overlaps its neighbours' tiles. Two Z-functions at the
boundary tell for all periods of the octave at once how far M_q goes on to the right and
to the left, at most 2P places each way. A run of four periods or more shows at least 2P
places at *every* boundary inside it, so shorter fragments are dropped, and fragments of
one document and period that touch are stitched to the interval. All octaves together
cost a document of n words O(n log n), of a period of any length.

Tiles travel as rows of a table, so one document's tiles are solved by many tasks. A tile
is written only if eight words at the boundary are found again at a distance of the
octave, which every run guarantees. The octaves of the shortest periods have the whole
batch as their tile: there shifted arrays are compared, which needs no boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import whole_text

#: The first octave that is solved by boundaries; shorter periods by shifted arrays. At least GRAM.
FIRST = 64
#: Words compared before a tile is written.
GRAM = 8
#: The least run: so many words, and so many periods.
WORDS, PERIODS = 6, 4
#: Bytes of text searched together; a longer text is searched alone.
TOGETHER = 2_000_000


def z_function(text: list[int], until: int) -> list[int]:
    """For each place below ``until`` how many items from there on equal those from the start on; in linear time."""
    n = len(text)
    z = [0] * min(until, n)
    if z:
        z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and text[k] == text[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(window: list[int], boundary: int, octave: int) -> list[tuple[int, int, int]]:
    """Fragments (period, low, high) of M_q around ``boundary`` for all primitive periods of the octave, in places of the window."""
    far = 2 * octave
    ahead = window[boundary : boundary + 2 * far]
    z = z_function(ahead, far)
    before = window[max(0, boundary - far) : boundary][::-1]
    shifted = window[max(0, boundary - far) : boundary + far - 1][::-1]
    missing = far - 1 - (len(window[: boundary + far - 1]) - boundary)  # words that the window lacks on the right
    back = z_function([*before, -1, *shifted], len(before) + 1 + octave)
    found = {}
    for period in range(octave, min(far, len(z))):
        at = len(before) + 1 + far - 1 - missing - period
        left = back[at] if len(before) < at < len(back) else 0
        right = min(z[period], far)
        if left + right >= far:
            found[period] = (boundary - left, boundary + right)
    # A period is a multiple of a shorter one if the words after the boundary are.
    for d in range(1, octave):
        if not found:
            break
        if z[d] + d >= octave:
            for period in range(-(-octave // d) * d, far, d):
                if z[d] >= period - d:
                    found.pop(period, None)
    return [(period, low, high) for period, (low, high) in found.items()]


def intervals(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of true values that are at least so long: their starts and ends."""
    places = np.flatnonzero(equal)
    if not len(places):
        return places, places
    breaks = np.flatnonzero(np.diff(places) > 1)
    low, high = places[np.concatenate([[0], breaks + 1])], places[np.concatenate([breaks, [len(places) - 1]])] + 1
    long = high - low >= least
    return low[long], high[long]


def short_periods(codes: np.ndarray, first: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Intervals (period, low, high) of M_q for all periods below ``first``, long enough for a run."""
    out = []
    for period in range(1, min(first, len(codes))):
        low, high = intervals(codes[:-period] == codes[period:], max((PERIODS - 1) * period, WORDS - period))
        if len(low):
            out.append((np.full(len(low), period), low, high))
    return out


def boundaries(codes: np.ndarray, longest: int, first: int) -> list[tuple[int, np.ndarray]]:
    """Per octave the boundaries where the words after or before are found again at a distance of the octave."""
    out = []
    n = len(codes) - GRAM + 1
    if n <= 0:
        return out
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64)  # wraps; equal words give equal sums
    octave = first
    while PERIODS * octave <= longest:
        rows = -(-n // octave)
        again = np.zeros(rows + 1, bool)
        for shift in (0, GRAM):  # the words after the boundary, and those before it
            moved = np.zeros(rows * octave + octave, np.uint64)
            held = np.zeros(len(moved), bool)
            moved[shift : shift + n], held[shift : shift + n] = gram[: len(moved) - shift], True
            grid, there = moved.reshape(-1, octave), held.reshape(-1, octave)
            again[: len(grid) - 1] |= ((grid[1:] == grid[:-1, :1]) & there[1:] & there[:-1, :1]).any(axis=1)
        at = np.flatnonzero(again) * octave
        if len(at):
            out.append((octave, at))
        octave *= 2
    return out


def planted(words: list, key: int) -> list:
    """The words, with a periodic tail in a tenth of the documents; ``key`` is the checksum of the document's id."""
    n, g = len(words), key // 10
    if key % 10 or not n:
        return words
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    tail = words[start : start + period]
    return words[:start] + (tail * (-(-(n - start) // period)))[: n - start]


_PARTS = (
    "kind int, row long, doc_id {kind}, digest string, text binary, period long, low long, high long, octave long, at long, window array<int>"
)


def _parts(docs: DataFrame, plant: bool, first: int) -> DataFrame:
    """Rows of three kinds: 0 documents (words only of those that may hold runs), 1 fragments, 2 tiles."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        from pyspark import TaskContext

        schema, row = None, TaskContext.get().partitionId() << 40

        def together(ids: list, texts: list[str], row: int) -> Iterator[dict]:
            documents, parts, base = [], [], 0
            for doc_id, text in zip(ids, texts):
                words = text.encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space only
                if plant:
                    words = planted(words, zlib.crc32(("" if doc_id is None else str(doc_id)).encode()))
                seen: dict = {}
                parts.append(np.array([seen.setdefault(w, len(seen)) for w in words], np.int64) + base)
                documents.append(words)
                base += len(seen)  # no two documents share a code
            codes = np.concatenate(parts)
            starts = np.cumsum([0, *map(len, documents)])
            open_ = np.zeros(len(documents), bool)
            pieces = short_periods(codes, first)
            if pieces:
                period, low, high = (np.concatenate([p[k] for p in pieces]) for k in range(3))
                doc = np.searchsorted(starts, low, side="right") - 1
                open_[doc] = True
                yield {"kind": np.full(len(doc), 1), "row": row + doc, "period": period, "low": low - starts[doc], "high": high - starts[doc]}
            for octave, at in boundaries(codes, int(np.diff(starts).max()), first):
                doc = np.searchsorted(starts, at, side="right") - 1
                # The words before a boundary may belong to the document that ends there; no run crosses it.
                fits = (doc < len(documents)) & (np.diff(np.append(starts, starts[-1]))[doc] >= PERIODS * octave)
                at, doc = at[fits], doc[fits]
                open_[doc] = True
                for low in range(0, len(at), 256):
                    b, d = at[low : low + 256], doc[low : low + 256]
                    begin, end = np.maximum(b - 2 * octave, starts[d]), np.minimum(b + 4 * octave, starts[d + 1])
                    flat = np.concatenate([codes[i:j] - codes[starts[k] : starts[k] + 1] for i, j, k in zip(begin, end, d)])
                    windows = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(end - begin)]).astype(np.int32)), pa.array(flat.astype(np.int32)))
                    yield {"kind": np.full(len(b), 2), "row": row + d, "octave": np.full(len(b), octave), "at": b - begin, "low": begin - starts[d], "window": windows}
            joined = [b" ".join(words) for words in documents]
            yield {
                "kind": np.zeros(len(documents), np.int32), "row": row + np.arange(len(documents)), "doc_id": pa.array(ids, schema.field(0).type),
                "digest": pa.array([None if o else hashlib.sha256(t).hexdigest() for o, t in zip(open_, joined)], pa.string()),
                "text": pa.array([t if o else None for o, t in zip(open_, joined)], pa.binary()),
            }

        for batch in batches:
            schema = batch.schema
            types = [("kind", pa.int32()), ("row", pa.int64()), ("doc_id", schema.field(0).type), ("digest", pa.string()), ("text", pa.binary()),
                     *((c, pa.int64()) for c in ("period", "low", "high", "octave", "at")), ("window", pa.list_(pa.int32()))]
            ids, texts, low = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= TOGETHER):
                    size += len(texts[high])
                    high += 1
                for part in together(ids[low:high], texts[low:high], row):
                    n = len(part["kind"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(n, t) if c not in part else part[c] if isinstance(part[c], pa.Array) else pa.array(part[c], t) for c, t in types],
                        names=[c for c, _ in types],
                    )
                row += high - low
                low = high

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text()).mapInArrow(search, _PARTS.format(kind=kind))


def _fragments(tiles: DataFrame) -> DataFrame:
    """Fragments (row, period, low, high) of all tiles (row, octave, at, low, window)."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, octave, at, low, window in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                out += [(row, q, low + i, low + j) for q, i, j in solve_tile(window.values.to_numpy().tolist(), at, octave)]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "period", "low", "high"])

    # Dealt out again: the tiles of one long document go to many tasks.
    return tiles.select("row", "octave", "at", "low", "window").repartition("row", "octave", "at", "low").mapInArrow(
        solve, "row long, period long, low long, high long"
    )


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs (row, start, length, period) from fragments (row, period, low, high) of the intervals of M_q."""
    joined = fragments.selectExpr(
        "*", "max(high) OVER (PARTITION BY row, period ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _until"
    ).selectExpr(
        "row", "period", "low", "high",
        "sum(IF(_until >= low, 0, 1)) OVER (PARTITION BY row, period ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _island",
    )
    whole = joined.groupBy("row", "period", "_island").agg(F.min("low").alias("start"), F.max("high").alias("_high")).select(
        "row", "start", (F.col("_high") - F.col("start") + F.col("period")).alias("length"), "period"
    ).where((F.col("length") >= WORDS) & (F.col("length") >= PERIODS * F.col("period")))
    # A stretch that also has a shorter period is the run of the shortest.
    return whole.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def periodic_runs(docs: DataFrame, plant: bool = False, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(documents, runs). runs: row, start, length, period. documents: row, doc_id, and either the digest of the
    words joined by one space, or (where there may be runs) these words as ``text``."""
    parts = cut_lineage(_parts(docs, plant, first))
    fragments = parts.where("kind = 1").select("row", "period", "low", "high").unionByName(_fragments(parts.where("kind = 2")))
    return parts.where("kind = 0").select("row", "doc_id", "digest", "text"), cut_lineage(stitched(fragments))


def collapse_runs(docs: DataFrame, plant: bool = False, first: int = FIRST) -> DataFrame:
    """One row per document: doc_id, n_runs, the strongest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    A run has six words and four of its smallest periods at least and cannot be extended.
    The strongest has the greatest length / period (exactly; ties: smallest start, then
    period). Collapsed texts drop every word that some run holds after its first period.
    ``plant`` first gives a tenth of the documents a periodic tail, by their id.

    Null and empty texts have no words: no runs, nulls, digests of nothing. A null id
    counts as the empty string for ``plant``. Repeated rows are judged each. No documents:
    no rows. Other columns play no part and are not returned.
    """
    documents, runs = periodic_runs(docs, plant, first)
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = (
        f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    )
    names = [f.split()[0] for f in result.split(", ")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            columns: list = [[] for _ in names[1:]]
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words, lost, best = text.split(b" "), None, None
                for r in found or []:
                    lost = np.zeros(len(words) + 1, np.int64) if lost is None else lost
                    lost[r["start"] + r["period"]] += 1
                    lost[r["start"] + r["length"]] -= 1
                    # In order of start and period: only a greater exponent replaces the best.
                    if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
                        best = r
                if lost is not None:
                    words = [w for w, drop in zip(words, (np.cumsum(lost) > 0).tolist()) if not drop]
                listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in found or [])
                values = (
                    len(found or []), *((best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4),
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(),
                )
                for column, value in zip(columns, values):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    listed = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    listed = cut_lineage(listed)
    searched = documents.where("text IS NOT NULL").join(listed, "row", "left").select("doc_id", "text", "runs").mapInArrow(finish, result)
    nothing = F.lit(None).cast("long")
    clear = documents.where("text IS NULL").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *(nothing.alias(c) for c in names[2:6]),
        F.sha2(F.lit(""), 256).alias("runs_sha256"), F.col("digest").alias("collapsed_sha256"),
    )
    return searched.unionByName(clear)
