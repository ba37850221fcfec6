"""Text clean-up for topic words and for embeddings.

A document is one row with an array of tokens. Words, pairs and document
frequencies are counted by exploding the arrays, which combines counts before the
shuffle. Phrase and word lists that were measured and found small go to the tasks,
which merge and prune the arrays in place: no token is shuffled. A larger list
meets a *token table* (document id, position, token, next token) in an equi-join
with salted keys, because a frequent word may make up a large share of all tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import EmptyDataError, ValidationError
from ..filters import Filter, filter_table
from ..functions import tokens as K
from ..schema import INDEX, TableSchema, quoted
from ..session import cut_lineage, discard, stage_scope

SALTS = 16
BROADCAST_BYTES = 64 * 1024 * 1024
#: Documents whose tokens are Python objects at a time.
SLICE = 256


# English articles, prepositions and conjunctions that join words to a phrase.
CONNECTORS = ("a", "an", "the", "for", "of", "with", "without", "at", "from", "to", "in", "on", "by", "and", "or")


@dataclass(frozen=True)
class TextConfig:
    """Preprocessing options. ``stopwords`` extends the default English list.

    ``connectors`` are words that may stand inside a phrase (``point of sale``) but
    neither begin nor end one; ``CONNECTORS`` has the usual English ones.
    """

    ignore_tokens: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    remove_email: bool = True
    remove_url: bool = True
    remove_number: bool = True
    min_df: int = 5
    max_df: float = 0.5
    max_unique_words: int | None = None
    min_document_length: int = 5
    min_word_length: int = 3
    default_stopwords: str | None = "english"
    phrase_threshold: float = 10.0
    connectors: tuple[str, ...] = ()

    def __post_init__(self):
        if min(self.min_df, self.min_document_length, self.min_word_length) <= 0:
            raise ValidationError("min_df, min_document_length and min_word_length must be positive")
        if not 0 < self.max_df <= 1:
            raise ValidationError("max_df must be a share between 0 and 1")

    def stop_list(self) -> list[str]:
        base = StopWordsRemover.loadDefaultStopWords(self.default_stopwords) if self.default_stopwords else []
        words = {w.lower() for w in base} | {w.lower() for w in self.stopwords}
        return sorted(words - {w.lower() for w in self.ignore_tokens})


def measured_bytes(table: DataFrame, *columns: str) -> int:
    """A generous estimate of the size of a word table in memory, from its count and its text lengths."""
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return table.agg(F.coalesce(F.sum(text + 64 * len(columns)), F.lit(0))).first()[0]


def lookup(tokens: DataFrame, table: DataFrame, keys: list[str], how: str = "left", size: int | None = None) -> DataFrame:
    """Join a token table with a table that has one row per key.

    ``size`` is the measured size of ``table`` in bytes; without it, or beyond
    the bound, each key is spread over salts.
    """
    if size is not None and size <= BROADCAST_BYTES:
        return tokens.join(F.broadcast(table), keys, how)
    salted = tokens.withColumn("__salt", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def clean_arrays(df: DataFrame, name: str, config: TextConfig = TextConfig()) -> DataFrame:
    """``id`` and ``t``, the tokens that remain of each text.

    E-mail addresses, links and numbers become EMAIL, URL and NUMBER (each
    optional) before anything is dropped; then stop words, punctuation and short
    tokens go and the rest is lower-cased.
    """
    stop = config.stop_list()
    ignore = [t.lower() for t in config.ignore_tokens]

    def replace(token):
        out = F.lower(token)
        if config.remove_number:
            out = F.when(K.is_number(token), "NUMBER").otherwise(out)
        if config.remove_url:
            out = F.when(K.is_link(token), "URL").otherwise(out)
        if config.remove_email:
            out = F.when(K.is_email(token), "EMAIL").otherwise(out)
        return out

    def keep(token):
        marker = token.isin("EMAIL", "URL", "NUMBER")
        plain = (F.length(token) >= config.min_word_length) & ~K.is_punctuation(token)
        if stop:
            plain = plain & ~token.isin(*stop)
        return (marker | plain | token.isin(*ignore)) if ignore else (marker | plain)

    ref = F.col(quoted(name))
    # Symbols that stand alone are too short, unless they are asked for.
    symbols = config.min_word_length < 2 or any(len(t) == 1 for t in ignore)
    kept = F.filter(F.transform(K.tokenize(ref, symbols), replace), keep)
    return df.filter(ref.isNotNull()).select(F.col(INDEX).alias("id"), kept.alias("t"))


def tokens_of(arrays: DataFrame) -> DataFrame:
    """``id``, ``pos``, ``token``, ``next``: the token table of some arrays."""
    # The next token is paired up inside the document, before it is taken apart.
    following = F.slice(F.col("t"), F.lit(2), F.greatest(F.size("t"), F.lit(1)))
    zipped = F.posexplode(F.arrays_zip(F.col("t").alias("token"), following.alias("next")))
    return arrays.select("id", zipped.alias("pos", "z")).select("id", "pos", "z.token", "z.next")


def pairs_of(arrays: DataFrame, connectors: tuple[str, ...]) -> DataFrame:
    """``tokens_of`` without the connectors; ``between`` joins those up to the next token with ``_``."""
    words = F.filter(F.transform("t", lambda t, i: F.struct(i.alias("pos"), t.alias("token"))), lambda w: ~w["token"].isin(*connectors))
    return (
        arrays.select("id", "t", words.alias("w"))
        .select("id", F.explode(F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.struct(
            a["pos"].alias("pos"), a["token"].alias("token"), b["token"].alias("next"),
            F.array_join(F.slice("t", a["pos"] + 2, F.coalesce(b["pos"] - a["pos"] - 1, F.lit(0))), "_").alias("between"),
        ))).alias("p"))
        .select("id", "p.*")
    )


def clean_tokens(df: DataFrame, name: str, config: TextConfig = TextConfig(), lemmas: DataFrame | None = None) -> DataFrame:
    """The token table of ``clean_arrays``. ``lemmas`` is an optional table (``token``, ``lemma``).

    Texts are cleaned once: the arrays are stored, and each use of the table reads them.
    """
    tokens = tokens_of(cut_lineage(clean_arrays(df, name, config)))
    if lemmas is None:
        return tokens
    stop = config.stop_list()
    table = cut_lineage(lemmas.groupBy("token").agg(F.min(F.lower("lemma")).alias("lemma")))
    size = measured_bytes(table, "token", "lemma")
    joined = lookup(tokens.drop("next"), table, ["token"], size=size).withColumn("token", F.coalesce("lemma", "token"))
    joined = joined.filter(~F.col("token").isin(*stop)) if stop else joined
    order = W.partitionBy("id").orderBy("pos")
    return joined.select("id", "pos", "token", F.lead("token").over(order).alias("next"))


def phrases(tokens: DataFrame, min_count: int, threshold: float = 10.0, words: DataFrame | None = None) -> DataFrame:
    """Word pairs that occur together more than chance: ``token``, ``next``, ``score``.

    score = (count(ab) - min_count) * V / (count(a) * count(b)), where V counts
    the distinct words and pairs. Pairs with different words ``between`` are
    different pairs. ``words`` (``token``) are the words to count, if they are not
    those of the pairs.
    """
    key = ["token", "between", "next"] if "between" in tokens.columns else ["token", "next"]
    # Both counts are read more than once, so they are stored.
    single = cut_lineage((tokens if words is None else words).groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("n")))
    pair = cut_lineage(tokens.filter("next IS NOT NULL").groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("n_pair")))
    vocabulary = single.agg(F.count(F.lit(1)).alias("v")).scalar()
    pairs = pair.agg(F.count(F.lit(1)).alias("v")).scalar()
    scored = (
        pair.filter(F.col("n_pair") > min_count)
        .join(single.withColumnRenamed("n", "n_first"), "token")
        .join(single.select(F.col("token").alias("next"), F.col("n").alias("n_second")), "next")
        .withColumn("v", vocabulary + pairs)
    )
    score = (F.col("n_pair") - min_count) * F.col("v") / (F.col("n_first") * F.col("n_second"))
    return scored.select(*key, score.alias("score")).filter(F.col("score") > threshold)


def merge_phrases(tokens: DataFrame, found: DataFrame, size: int | None = None, arrays: DataFrame | None = None) -> DataFrame:
    """Join phrase words with ``_``, left to right, each word used once.

    Where phrases overlap (a-b, b-c, c-d) the leftmost wins; along an unbroken run
    of pairs that is every second one, counted from where the run starts. ``arrays``
    are the documents that ``tokens`` come from: those with an id of their own are merged
    where they lie, and only tokens of rows that share an id are shuffled.
    """
    if size is None:
        found = cut_lineage(found)
        size = measured_bytes(found, "token", "next")
    if arrays is None:
        return _merged_by_windows(tokens, found, size)
    several = cut_lineage(arrays.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__id")))
    same = F.col("id").eqNullSafe(F.col("__id"))
    alone = arrays.join(several, same, "left_anti")
    if size <= BROADCAST_BYTES:
        merged = merge_in_place(alone, found, positions=True)
    else:
        merged = merge_in_place(merge_by_join(alone, tokens, found), None, positions=True)
    placed = merged.select("id", F.explode(F.arrays_zip("pos", F.col("t").alias("token"))).alias("z")).select("id", "z.pos", "z.token")
    return placed.unionByName(_merged_by_windows(tokens.join(several, same, "left_semi"), found, size))


def _merged_by_windows(tokens: DataFrame, found: DataFrame, size: int) -> DataFrame:
    order = W.partitionBy("id").orderBy("pos")
    table = found.select("token", "next", F.lit(True).alias("is_phrase"))
    flagged = lookup(tokens, table, ["token", "next"], "left", size).withColumn(
        "is_phrase", F.coalesce("is_phrase", F.lit(False))
    )
    nth = F.row_number().over(order)
    flagged = flagged.withColumn("nth", nth)
    last_break = F.max(F.when(~F.col("is_phrase"), F.col("nth"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    flagged = flagged.withColumn(
        "merged", F.col("is_phrase") & ((F.col("nth") - F.coalesce(last_break, F.lit(0))) % 2 == 1)
    )
    consumed = F.coalesce(F.lag("merged").over(order), F.lit(False))
    return (
        flagged.withColumn("consumed", consumed).filter(~F.col("consumed"))
        .select("id", "pos", F.when(F.col("merged"), F.concat_ws("_", "token", "next")).otherwise(F.col("token")).alias("token"))
    )


def merge_in_place(arrays: DataFrame, found: DataFrame | None, connectors: tuple[str, ...] = (), positions: bool = False) -> DataFrame:
    """``merge_phrases`` on arrays, with connectors inside phrases.

    ``found`` must have been measured: it goes to every task. Without it, ``arrays``
    has the places ``hits`` where phrases begin. ``positions`` adds ``pos``, where each
    token began. A task holds few documents as Python objects at a time.
    """
    firsts: set[str] = set()
    known: set[str] = set()  # one text per phrase takes less memory than tuples
    for row in found.toLocalIterator() if found is not None else ():
        firsts.add(row["token"])
        known.add("\0".join((row["token"], row["between"] if "between" in row else "", row["next"])))
    shared, inside = arrays.sparkSession.sparkContext.broadcast((firsts, known)), frozenset(connectors)
    by_place = found is None
    used = arrays.select("id", "t", "hits") if by_place else arrays.select("id", "t")
    made = arrays.select("id", "t", F.array().cast("array<int>").alias("pos")) if positions else arrays.select("id", "t")
    names = made.columns

    def merge(batches):
        firsts, known = shared.value
        for whole in batches:
            for low in range(0, len(whole), SLICE):
                batch = whole.slice(low, SLICE)
                merged, began = [], []
                hits = batch.column(2).to_pylist() if by_place else [None] * len(batch)
                for tokens, places in zip(batch.column(1).to_pylist(), hits):
                    out, starts, at, size, places = [], [], 0, len(tokens), set(places or ())
                    while at < size:
                        token, end = tokens[at], at + 1
                        starts.append(at)
                        may = at in places if by_place else token in firsts and token not in inside
                        if may:
                            while end < size and tokens[end] in inside:
                                end += 1
                        if may and end < size and (by_place or "\0".join((token, "_".join(tokens[at + 1 : end]), tokens[end])) in known):
                            out.append("_".join(tokens[at : end + 1]))
                            at = end + 1
                        else:
                            out.append(token)
                            at += 1
                    merged.append(out)
                    began.append(starts)
                columns = [batch.column(0), pa.array(merged, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(began, pa.list_(pa.int32()))] * positions, names=names)

    return used.mapInArrow(merge, made.schema)


def merge_by_join(arrays: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``arrays`` with ``hits``, the places where phrases begin, for a list of phrases of any length."""
    key = [c for c in ("token", "between", "next") if c in found.columns]
    begun = lookup(pairs, found.select(*key), key, "inner").groupBy("id").agg(F.collect_list("pos").alias("hits"))
    return arrays.join(begun, "id", "left")


def prune_in_place(arrays: DataFrame, vocab: DataFrame) -> DataFrame:
    """Arrays without the tokens outside a vocabulary that was measured: it goes to every task."""
    words = vocab.select("token").toArrow().column(0).combine_chunks()
    shared = arrays.sparkSession.sparkContext.broadcast(words)

    def prune(batches):
        known = shared.value
        for batch in batches:
            lists = batch.column(1)
            kept = pc.is_in(lists.flatten(), value_set=known)
            before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
            ends = before[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
            pruned = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.flatten().filter(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pruned], names=["id", "t"])

    return arrays.select("id", "t").mapInArrow(prune, arrays.select("id", "t").schema)


def to_arrays(tokens: DataFrame) -> DataFrame:
    """``id`` and ``t`` of a token table, in order of position."""
    joined = tokens.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return joined.select("id", F.transform("t", lambda x: x["token"]).alias("t"))


def vocabulary(tokens: DataFrame, documents: DataFrame, config: TextConfig) -> DataFrame:
    """Tokens worth keeping, with their document frequency: ``token``, ``df``.

    ``documents`` is the frame whose rows count as documents, empty ones included.
    """
    return known_tokens(tokens.select("id", "token").distinct(), documents, config)


def known_tokens(pairs: DataFrame, documents: DataFrame, config: TextConfig) -> DataFrame:
    """``vocabulary`` from one row per document and distinct token."""
    seen = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    protected = F.col("token").isin(*config.ignore_tokens) if config.ignore_tokens else F.lit(False)
    kept = seen.withColumn("total", total).filter(
        protected | ((F.col("df") >= config.min_df) & (F.col("df") <= F.lit(config.max_df) * F.col("total")))
    )
    if config.max_unique_words is not None:
        kept = kept.orderBy(protected.desc(), F.col("df").desc(), "token").limit(config.max_unique_words)
    return kept.select("token", "df")


def prune_vocabulary(tokens: DataFrame, vocab: DataFrame, size: int | None = None) -> DataFrame:
    """Drop tokens outside the vocabulary; it may be large, so this is a join."""
    return lookup(tokens, vocab.select("token"), ["token"], "inner", size).select("id", "pos", "token")


def to_documents(tokens: DataFrame, min_length: int) -> DataFrame:
    """``id``, ``document``: tokens joined by spaces, documents that are too short left out."""
    return joined_arrays(to_arrays(tokens), min_length)


def joined_arrays(arrays: DataFrame, min_length: int) -> DataFrame:
    return arrays.filter(F.size("t") >= min_length).select("id", F.array_join("t", " ").alias("document"))


def preprocess_heavy(df: DataFrame, name: str, config: TextConfig = TextConfig(), lemmas: DataFrame | None = None) -> DataFrame:
    """``id``, ``document`` for every text that survives clean-up, phrases and pruning.

    The stages are stored: each is read several times, and the sizes of the
    phrase and word lists decide how they are looked up.
    """
    documents = df.filter(F.col(quoted(name)).isNotNull())
    arrays = clean_arrays(df, name, config) if lemmas is None else to_arrays(clean_tokens(df, name, config, lemmas))
    arrays = cut_lineage(arrays)
    pairs = pairs_of(arrays, config.connectors) if config.connectors else tokens_of(arrays)
    words = arrays.select(F.explode("t").alias("token"))
    with stage_scope(df.sparkSession):
        found = cut_lineage(phrases(pairs, config.min_df, config.phrase_threshold, words), outlive=True)
    if measured_bytes(found, "token", "next") <= BROADCAST_BYTES:
        merged = cut_lineage(merge_in_place(arrays, found, config.connectors))
    else:
        merged = cut_lineage(merge_in_place(merge_by_join(arrays, pairs, found), None, config.connectors))
    discard(arrays)
    vocab = cut_lineage(known_tokens(merged.select(F.explode(F.array_distinct("t")).alias("token")), documents, config))
    if measured_bytes(vocab, "token") <= BROADCAST_BYTES:
        pruned = prune_in_place(merged, vocab)
    else:
        pruned = to_arrays(prune_vocabulary(tokens_of(merged), vocab))
    return joined_arrays(pruned, config.min_document_length)


def preprocess_light(df: DataFrame, name: str, config: TextConfig = TextConfig()) -> DataFrame:
    """``id``, ``document`` for embeddings: ASCII tokens only, case kept."""

    def replace(token):
        out = token
        if config.remove_url:
            out = F.when(K.is_link(token), "url").otherwise(out)
        if config.remove_email:
            out = F.when(K.is_email(token), "email").otherwise(out)
        return out

    ref = F.col(quoted(name))
    ascii_only = F.filter(K.tokenize(ref), lambda t: t.rlike(r"^\p{ASCII}+$"))
    return df.filter(ref.isNotNull()).select(
        F.col(INDEX).alias("id"), F.array_join(F.transform(ascii_only, replace), " ").alias("document")
    )


def preprocess(
    df: DataFrame, schema: TableSchema, name: str, config: TextConfig = TextConfig(),
    lemmas: DataFrame | None = None, strict: bool = False,
) -> DataFrame:
    """Add ``X (Preprocessed)``; NULL where nothing usable is left. An existing column is kept."""
    column = schema.get(name, (S.TEXTUAL,))
    target = column.derived()[0].name
    if target in df.columns:
        return df
    cleaned = preprocess_heavy(df, name, config, lemmas)
    if strict and cleaned.isEmpty():
        raise EmptyDataError(f'no document of "{name}" survives preprocessing')
    cleaned = cleaned.select(F.col("id").alias(INDEX), F.col("document").alias(target))
    return df.join(cleaned, INDEX, "left")


def word_frequencies(
    df: DataFrame, schema: TableSchema, name: str, flt: Filter | None = None, n: int = 50,
    vocab: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` most frequent words under a filter: ``word``, ``frequency``.

    Counts the preprocessed text if the column has one. ``vocab`` (``token``)
    restricts the words to those of a model.
    """
    column = schema.get(name, (S.TEXTUAL, S.UNIQUE))
    source = name
    if column.type == S.TEXTUAL and column.derived()[0].name in df.columns:
        source = column.derived()[0].name
    words = filter_table(df, schema, flt).select(F.explode(K.words(F.col(quoted(source)))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    if vocab is not None:
        counts = counts.join(vocab.select(F.col("token").alias("word")), "word", "left_semi")
    return counts.orderBy(F.col("frequency").desc(), "word").limit(n)
