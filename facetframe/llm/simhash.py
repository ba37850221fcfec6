"""SimHash near-duplicates by multi-index hashing.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit in
one of their 32-bit halves. Every distinct fingerprint is filed under its two halves and
looks in the Hamming ball of radius one around each half: itself, and each zero bit set.
(The partner with the set bit is found from the one without, so half of the ball is
enough.) Entries that meet under a key are verified on all 64 bits; a key gives back
only enough links to connect what it proves connected, never all pairs.

A key with very many fingerprints is refined before any task gathers it: its entries
are filed a second time under the 16-bit quarters of the *other* half, again with balls
of radius one, which loses no pair.

The pipeline's stage (``keep_one``) has a rule of its own, the Jaccard similarity of sets
of five-word shingles. Fingerprints of texts that are 0.8 similar differ in up to a dozen
bits, too many for such an index alone: its first candidates are the links of the
fingerprints of five-word shingles, further ones share a band of MinHash values, and
every link is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, stage_scope
from .common import arrow_map, extended, fresh, key_filter, whole_text
from .graph import components

WORDS = 3
DISTANCE = 3
SEED = 42
#: The pipeline's stage: words of a shingle, and the least Jaccard similarity of near copies as a fraction.
STAGE_WORDS, SIMILARITY = 5, (4, 5)
#: Bands of MinHash and permutations in each: at a similarity of 0.8 a pair shares no band with probability 0.0002.
BANDS, ROWS = 16, 4
#: How many of a text's earlier shingles tell whether a pair has met already.
BEFORE = 16
#: Longs of a sketch of a text's shingles (a power of two).
SKETCH = 16
#: One in so many pairs is looked at, in turn; the last turn looks at all, the others need as many pairs an entry.
SHARES = (1024, 32, 1)
#: A half with more distinct fingerprints than this is refined.
MOST = 20_000
#: Shingles hashed at a time, so that a very long text needs no more memory than a short one.
CHUNK = 1 << 16


def text_fingerprint(text: str, words: int = WORDS) -> int:
    """The fingerprint of one whole text; see ``fingerprints``."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    total, digest = max(1, len(tokens) - words + 1), xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for low in range(0, total, CHUNK):
        high = min(total, low + CHUNK)
        hashes = np.array([digest(b" ".join(tokens[i : i + words]), SEED) for i in range(low, high)], dtype=">u8")
        set_bits += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > total).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: bool = False, name: str = "_print") -> DataFrame:
    """Fingerprints of whole texts: doc_id (or, with ``keep``, all columns) and ``name``, a signed long.

    A-Z are lower-cased, words split at ASCII white space, three-word shingles joined by
    one space (fewer words: the whole sequence) and hashed by XXH64. A bit is set if more
    than half of the hashes set it. Null and empty texts: zero.
    """
    kept = docs if keep else docs.select("doc_id")
    names = [*kept.columns, name]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([text_fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(prints.view(np.int64))], names=names
            )

    rows = docs.select(*(F.col(f"`{c}`") for c in kept.columns), whole_text().alias("_text"))
    return arrow_map(rows, measure, extended(kept, f"`{name}` long"))


def _filed(prints: DataFrame) -> DataFrame:
    """Entries (_half, _key, _print, _home): a fingerprint's own halves, and the halves one set bit away."""
    entries = None
    for half, value in enumerate((F.shiftrightunsigned("_print", 32), F.col("_print").bitwiseAND(F.lit(0xFFFFFFFF)))):
        near = F.expr("filter(sequence(0, 31), i -> (_value & shiftleft(1L, i)) = 0)")
        part = prints.withColumn("_value", value)
        ball = part.select(
            F.lit(half).alias("_half"), F.col("_print"),
            F.explode(F.concat(F.array(F.lit(-1)), near)).alias("_bit"), "_value",
        ).select(
            "_half", F.when(F.col("_bit") < 0, F.col("_value")).otherwise(F.expr("_value | shiftleft(1L, _bit)")).alias("_key"),
            "_print", (F.col("_bit") < 0).alias("_home"),
        )
        entries = ball if entries is None else entries.union(ball)
    return entries


def _refined(entries: DataFrame) -> DataFrame:
    """The entries of very full keys, filed again under the quarters of the other half with balls of radius one."""
    other = F.when(F.col("_half") == 0, F.col("_print").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("_print", 32))
    quarters = None
    for quarter, shift in enumerate((16, 0)):
        part = entries.withColumn("_value", F.shiftright(other, shift).bitwiseAND(F.lit(0xFFFF)))
        own = part.where("_home").withColumns({"_own": F.lit(True), "_bit": F.lit(-1)})
        # Entries of the key itself look around too: they may be partners of each other.
        around = part.withColumns({"_own": F.lit(False), "_bit": F.explode(F.sequence(F.lit(-1), F.lit(15)))})
        filed = own.unionByName(around).select(
            "_half", "_key", F.lit(quarter).alias("_quarter"),
            F.when(F.col("_bit") < 0, F.col("_value")).otherwise(F.expr("_value ^ shiftleft(1L, _bit)")).alias("_fine"),
            "_print", F.col("_own").alias("_home"),
        )
        quarters = filed if quarters is None else quarters.union(filed)
    return quarters


def _forest(prints: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the entries of one key as far as distances of at most DISTANCE do (to a home entry)."""
    homes = np.unique(prints[home])
    guests = np.setdiff1d(prints[~home], homes)
    nodes = np.concatenate([homes, guests])
    if len(nodes) < 2 or not len(homes):
        return []
    label, out = np.arange(len(nodes)), []
    for i in range(len(homes)):
        near = np.flatnonzero(np.bitwise_count(nodes[i + 1 :] ^ nodes[i]) <= DISTANCE) + i + 1
        # In a crowd nearly all are connected already; only new connections are followed up.
        near = near[label[near] != label[i]]
        if len(near):
            others, first = np.unique(label[near], return_index=True)
            out += [(int(nodes[i]), int(nodes[j])) for j in near[first].tolist()]
            label[np.isin(label, others)] = label[i]
    return out


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) between distinct fingerprints (``_print``) that connect exactly what distances up to three connect."""
    entries = _filed(prints)
    full = cut_lineage(entries.where("_home").groupBy("_half", "_key").count().where(F.col("count") > most).select("_half", "_key"))
    plain = entries.withColumns({"_quarter": F.lit(-1), "_fine": F.lit(0).cast("long")})
    if not full.isEmpty():
        fine = _refined(entries.join(full, ["_half", "_key"], "left_semi"))
        plain = plain.join(full, ["_half", "_key"], "left_anti").unionByName(fine)
    key = F.xxhash64("_half", "_key", "_quarter", "_fine").alias("_at")
    # Hashing the key only brings more entries together; every link is verified on its own.
    filed = plain.select(key, "_print", "_home")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

        def found(keys: np.ndarray, prints: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
            out = []
            if len(keys):
                homes = np.add.reduceat(home.astype(np.int64), starts)
                for i in np.flatnonzero((ends - starts > 1) & (homes > 0)).tolist():
                    out += _forest(prints[starts[i] : ends[i]].view(np.uint64), home[starts[i] : ends[i]])
            ends_of = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends_of[:, 0]), pa.array(ends_of[:, 1])], names=["a", "b"])

        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            rest = [np.concatenate([r, n]) for r, n in zip(rest, now)]
            cut = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0  # the last key may go on
            if cut:
                yield found(*(r[:cut] for r in rest))
                rest = [r[cut:] for r in rest]
        yield found(*rest)

    return filed.repartition("_at").sortWithinPartitions("_at").mapInArrow(connect, "a long, b long")


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id.

    Documents link if their fingerprints differ in at most three bits; component_id is
    the smallest doc_id that can be reached. Null and empty texts share fingerprint zero
    and link like any other. A null doc_id never names a component unless all ids of it
    are null. Repeated rows stay repeated. No documents: no rows.
    """
    rows = cut_lineage(fingerprints(docs))
    return classes(rows, "doc_id", most).select(
        "doc_id", F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), F.col("_root").alias("component_id")
    )


def classes(rows: DataFrame, identity: str, most: int = MOST) -> DataFrame:
    """``rows`` (with ``_print``) and ``_root``: the smallest ``identity`` of the row's component."""
    distinct = cut_lineage(rows.groupBy("_print").agg(F.min(identity).alias("_least")))
    linked = components(links(distinct.select("_print"), most))
    # Components are named by a fingerprint first, and then by their smallest identity.
    named = distinct.join(linked, distinct["_print"] == linked["node"], "left").select(
        "_print", "_least", F.coalesce("root", "_print").alias("_name")
    )
    named = cut_lineage(named)
    least = cut_lineage(named.groupBy("_name").agg(F.min("_least").alias("_root")))
    roots = cut_lineage(named.join(least, "_name").select("_print", "_root"))
    return rows.join(roots, "_print", "left")


def shingles(text: str, words: int = STAGE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; words as for fingerprints."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    total, digest, parts = max(1, len(tokens) - words + 1) if tokens else 0, xxhash.xxh64_intdigest, [np.zeros(0, np.uint64)]
    for low in range(0, total, CHUNK):
        high = min(total, low + CHUNK)
        parts.append(np.unique(np.array([digest(b" ".join(tokens[i : i + words]), SEED) for i in range(low, high)], np.uint64)))
    return np.unique(np.concatenate(parts))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes; no hashes: zero."""
    set_bits = np.zeros(64, np.int64)
    for low in range(0, len(hashes), CHUNK):
        some = hashes[low : low + CHUNK].astype(">u8")
        set_bits += np.unpackbits(some.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: the least hashes of ROWS permutations each. No shingles: no keys."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    r = np.random.default_rng(SEED)
    flips, factors = (r.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[low : low + 4096, None] ^ flips) * factors).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * factors[0]
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, _text) have a Jaccard similarity of SIMILARITY or more."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            kept = []
            for row, (a, one, other) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))):
                if a != last:
                    last, mine = a, shingles(one)
                theirs = shingles(other)
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                if SIMILARITY[1] * both >= SIMILARITY[0] * (len(mine) + len(theirs) - both):
                    kept.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], names=["a", "b"])

    other = texts.select(F.col("node").alias("b"), F.col("_text").alias("_other"))
    joined = pairs.join(other, "b").join(texts.withColumnRenamed("node", "a"), "a")
    return cut_lineage(joined.select("a", "b", "_text", "_other").mapInArrow(verify, "a long, b long"))


def _shingled(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The shingles of ``nodes`` (node) as rows: node, _n (how many), _shingle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(*(c.to_pylist() for c in batch.columns)):
                mine = shingles(text).view(np.int64)
                for low in range(0, len(mine), CHUNK):
                    some = mine[low : low + CHUNK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), v)) for v in (node, len(mine))] + [pa.array(some)], names=["node", "_n", "_shingle"]
                    )

    held = texts.join(nodes, "node", "left_semi").select("node", "_text")
    return cut_lineage(held.mapInArrow(cut, "node long, _n long, _shingle long"))


def _sketches(each: DataFrame) -> DataFrame:
    """Per node of ``each`` an array of SKETCH longs: every shingle flips one of their bits.

    Two sketches differ in no more bits than their sets differ in shingles.
    """
    word, bit = F.col("_shingle").bitwiseAND(F.lit(SKETCH - 1)), F.expr("shiftleft(1L, cast(shiftrightunsigned(_shingle, 32) & 63 as int))")
    return cut_lineage(each.groupBy("node").agg(F.array(*(F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(SKETCH))).alias("_bits")))


def _rarest(each: DataFrame, parts: DataFrame) -> DataFrame:
    """Entries (node, _part, _n, _shingle, _left, _before, _bits) of the nodes (node, _part): each under its rarest shingles.

    All shingles have one order: those that occur in one part only come first, then the
    others by how many texts hold them. Of n shingles the first n // 5 + 1 are looked at:
    two texts that are 0.8 similar have their first common shingle among these on both
    sides. Shingles of one part join nothing, so a crowd around one text costs its own
    differences only.
    """
    sketches = _sketches(each)
    each = each.join(parts, "node")
    known = each.groupBy("_shingle").agg(F.count(F.lit(1)).alias("_texts"), F.min("_part").alias("_low"), F.max("_part").alias("_high"))
    across = each.join(cut_lineage(known.where("_low < _high").select("_shingle", "_texts")), "_shingle")
    listed = across.groupBy("node", "_part", "_n").agg(F.array_sort(F.collect_list(F.struct("_texts", "_shingle"))).alias("_s"))
    room = F.floor(F.col("_n") / 5).cast("int") + 1 - (F.col("_n").cast("int") - F.size("_s"))
    cut_off = listed.where(room > 0).join(sketches, "node").select(
        "node", "_part", "_n", (F.col("_n") - F.size("_s")).alias("_own"), F.slice("_s", F.lit(1), room)["_shingle"].alias("_s"), "_bits"
    )
    return cut_lineage(cut_off.select("node", "_part", "_n", "_own", "_s", "_bits", F.posexplode("_s").alias("_at", "_shingle")).select(
        "node", "_part", "_n", "_shingle", (F.col("_n") - F.col("_own") - F.col("_at")).alias("_left"),
        F.slice("_s", F.greatest(F.col("_at") - (BEFORE - 1), F.lit(1)), F.least("_at", F.lit(BEFORE))).alias("_before"), "_bits",
    ))


def _all_that_meet(filed: DataFrame, share: int = 1) -> DataFrame:
    """Pairs (a, b) of different parts that may be similar: every similar pair, and few others; or one in ``share`` of these."""
    names = {"node": "", "_part": "_part", "_n": "_n", "_left": "_left", "_before": "_before", "_bits": "_bits"}
    one, other = (filed.select("_shingle", *(F.col(c).alias(f"{x}{name}") for c, name in names.items())) for x in "ab")
    meet = (F.col("a") < F.col("b")) & (F.col("a_part") != F.col("b_part")) & (SIMILARITY[1] * F.least("a_n", "b_n") >= SIMILARITY[0] * F.greatest("a_n", "b_n"))
    if share > 1:
        meet = meet & (F.pmod(F.xxhash64("a", "b"), F.lit(share)) == 0)
    both = F.col("a_n") + F.col("b_n")
    # Where a pair meets first, nothing before is common: what is left must be enough for the similarity.
    meet = meet & (sum(SIMILARITY) * F.least("a_left", "b_left") >= SIMILARITY[0] * both)
    # Similar sets differ in a ninth of their shingles at most, and sketches in no more bits.
    differ = sum(F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(SKETCH))
    meet = meet & (sum(SIMILARITY) * differ <= (SIMILARITY[1] - SIMILARITY[0]) * both)
    # Pairs that met just before, in the order of the shingles, need not meet again.
    meet = meet & ~F.arrays_overlap("a_before", "b_before")
    return one.join(other, (one["_shingle"] == other["_shingle"]) & meet).select("a", "b").distinct()


def _between_parts(texts: DataFrame, parts: DataFrame, tried: DataFrame) -> DataFrame:
    """Links (a, b) that connect what similar pairs of different parts (node, _part) connect, without the pairs ``tried``.

    Where shingles are crowded, a share of the pairs comes first: one link joins two
    parts as well as a thousand, so most pairs of a crowd lie in one part by the turn
    that looks at all.
    """
    filed = _rarest(_shingled(texts, parts), parts)
    pairs, entries = filed.groupBy("_shingle").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2")), F.sum("n")).first()
    found = None
    for share in SHARES:
        if share > 1 and (pairs or 0) < share * (entries or 1):
            continue
        candidates = cut_lineage(_all_that_meet(filed, share).join(tried, ["a", "b"], "left_anti"))
        more = _similar(candidates, texts)
        found = more if found is None else found.union(more)
        if share > 1:
            tried = cut_lineage(tried.union(candidates))
            ends = more
            for x in "ab":
                ends = ends.join(parts.select(F.col("node").alias(x), F.col("_part").alias(f"_{x}")), x)
            merged = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).withColumnRenamed("node", "_part")
            parts = cut_lineage(parts.join(merged, "_part", "left").select("node", F.coalesce("root", "_part").alias("_part")))
            # The order of the shingles stays: any one order for all will do.
            filed = cut_lineage(filed.drop("_part").join(parts, "node"))
    return found


def _printed(distinct: DataFrame) -> DataFrame:
    """Candidates (a, b) among the nodes of ``distinct`` (node, _print): fingerprints that link, and equal ones, by their least nodes."""
    known = cut_lineage(distinct.groupBy("_print").agg(F.min("node").alias("a")))
    equal = distinct.join(known, "_print").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))
    near = links(known.select("_print"))
    ends = (known.select(F.col("_print").alias(x), F.col("a").alias(f"_{x}")) for x in "ab")
    for end, x in zip(ends, "ab"):
        near = near.join(end, x)
    return cut_lineage(equal.union(near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))).distinct())


def similar_links(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of ``distinct`` (node, _print, _keys, _n) that connect what similar candidates connect.

    Candidates have fingerprints that link, or share a band. First the fingerprints' links are
    verified; then all of a band meet the least one, if their numbers of
    shingles allow the similarity; where members of a band are still in several parts, these
    members meet by their rarest shingles. Only candidates' texts are moved.
    """
    entries = cut_lineage(distinct.select("node", "_n", F.explode("_keys").alias("_key")))
    least = F.min(F.struct("node", "_n")).alias("_least")
    groups = entries.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), least).where("n > 1")
    shared = cut_lineage(entries.join(groups.select("_key", F.col("_least.node").alias("a"), F.col("_least._n").alias("a_n")), "_key"))
    alike = SIMILARITY[1] * F.least("a_n", "_n") >= SIMILARITY[0] * F.greatest("a_n", "_n")
    printed = _printed(distinct.select("node", "_print"))
    star = cut_lineage(shared.where((F.col("node") != F.col("a")) & alike).select("a", F.col("node").alias("b")).union(printed).distinct())
    ends = star.select(F.explode(F.array("a", "b")).alias("node"))
    may_hold = key_filter(shared.select("node").union(ends).distinct(), "node")
    texts = cut_lineage(texts.where(may_hold(F.col("node"))))
    found = _similar(star, texts)
    linked = components(found).withColumnRenamed("root", "_root")
    placed = cut_lineage(shared.join(linked, "node", "left").select("_key", "node", F.coalesce("_root", "node").alias("_part")))
    apart = placed.groupBy("_key").agg(F.min("_part").alias("low"), F.max("_part").alias("high")).where("low < high").select("_key")
    rest = cut_lineage(placed.join(apart, "_key", "left_semi").select("node", "_part").distinct())
    return found.union(_between_parts(texts, rest, star))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id stays (one row, also of repeated ids).

    Texts link if the Jaccard similarity of their sets of five-word shingles is 0.8 or
    more. Null and empty texts are one component. Null ids come last. All columns are
    kept as they are.
    """
    set_, keys, row, many, print_ = (fresh(docs, c) for c in ("_set", "_keys", "_row", "_n", "_print"))
    names = [*docs.columns, set_, keys, many, print_]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = [shingles(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            sets = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary())
            bands = pa.array([band_keys(h) for h in found], pa.list_(pa.int64()))
            sizes = pa.array([len(h) for h in found], pa.int64())
            prints = pa.array(np.array([set_fingerprint(h) for h in found], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sets, bands, sizes, prints], names=names)

    source = docs.select(*(F.col(f"`{c}`") for c in docs.columns), whole_text().alias("_text"))
    rows = arrow_map(source, measure, extended(docs, f"`{set_}` binary, `{keys}` array<bigint>, `{many}` bigint, `{print_}` bigint"))
    rows = cut_lineage(rows.withColumn(row, F.monotonically_increasing_id()))
    # A struct orders by its first field first: null ids come last.
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    with stage_scope(docs.sparkSession):
        mine = rows.select(F.col(set_).alias("_set"), F.col(row).alias("_row"), who.alias("who"), F.col(keys).alias("keys"), F.col(many).alias("n"), F.col(print_).alias("print"))
        distinct = mine.groupBy("_set").agg(F.min(F.struct("who", "keys", "n", "print")).alias("_least"))
        distinct = cut_lineage(distinct.select(
            "_set", F.col("_least.who.row").alias("node"), F.col("_least.who").alias("_who"), F.col("_least.keys").alias("_keys"), F.col("_least.n").alias("_n"), F.col("_least.print").alias("_print")
        ))
        texts = rows.select(F.col(row).alias("node"), whole_text().alias("_text"))
        linked = components(similar_links(distinct.select("node", "_print", "_keys", "_n"), texts)).withColumnRenamed("node", "_node")
        named = cut_lineage(distinct.join(linked, distinct["node"] == linked["_node"], "left").select("node", "_who", F.coalesce("root", "node").alias("_name")))
        first = cut_lineage(named.groupBy("_name").agg(F.min("_who").alias("_first")).select(F.col("_first.row").alias("node")))
        # Rows that go: other rows of a set, and sets that are not the first of their component.
        again = mine.select("_set", "_row").join(distinct.select("_set", "node"), "_set").where(F.col("_row") != F.col("node")).select("_row")
        later = named.join(first, "node", "left_anti").select(F.col("node").alias("_row"))
        gone = cut_lineage(again.union(later), outlive=True)
    # Only rows that may have to go are moved; at every size by one plan.
    may_go = key_filter(gone, "_row")
    kept = rows.where(~may_go(F.col(row)))
    lost = gone.select(F.col("_row").alias(row))
    asked = rows.where(may_go(F.col(row))).join(lost.hint("shuffle_hash"), row, "left_anti")
    return kept.unionByName(asked).select(*(F.col(f"`{c}`") for c in docs.columns))
