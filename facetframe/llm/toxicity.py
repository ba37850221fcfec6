"""Toxicity: text restored from obfuscation by a noisy-channel decoder, then scored.

A character language model (four letters) is counted over the words of all documents.
Tokens that look disguised (signs or digits among letters, letters in runs of three or
more, single letters set apart) become lattices: every sign may stand for itself, for
the letters it imitates or for nothing, and repeats may collapse. Runs of short pieces
become one lattice each, in which a gap is nothing or a word break. Viterbi search takes
the path of least channel cost under the language model.

The restored words and the beginnings of long words are hashed into buckets. Their log
odds between toxic and other labelled documents are counted in Spark; a document's
evidence is the sum over its strong buckets, turned into a probability by a one-variable
logistic fit on a fold of its own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fold, utf8, whole_text

CUT = 0.5
#: Buckets of words and word beginnings.
BUCKETS = 1 << 20
#: Lengths of word beginnings that count as features of their own.
BEGINNINGS = (4, 5)
#: A bucket is evidence if the lower bound of its toxic share (at DEVIATIONS) lifts the log odds by STRONG.
DEVIATIONS = 2.0
STRONG = 1.5
#: A document's evidence is the sum over this many of its strongest buckets, so that length does not count.
STRONGEST = 3
#: About this many labelled rows are used for fitting, chosen by a hash of the id.
SAMPLE = 400_000
#: Evidence is counted in steps of this size for the logistic fit, up to MOST_EVIDENCE.
STEP, MOST_EVIDENCE = 0.25, 25.0

#: Fixed: letters that signs and digits imitate.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
#: A gap inside a word, and one between words.
GAP, BREAK = 0.1, 0.0
LETTER = 2.6  # what the language model pays for a usual letter; given back, so that short and long paths compare
SWAP, STRAY, REPEAT, VOWEL = 1.0, 2.2, 0.4, 2.0

_TOKEN = re.compile(r"\S+")
#: Single letters set apart by the same kind of gap, at least four of them.
_APART = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_*/])[^\W\d_])(?:\1[^\W\d_]){2,}(?![^\W_])")
_SIGN = r"(?:[^\W_]|[@$!|+(€£¡])"
#: A piece of a word that is set apart, and runs of pieces with signs of one kind for gaps.
_PIECE = re.compile(_SIGN + "{1,3}")
_PIECES = {
    gap: (re.compile(gap + _SIGN), re.compile(rf"(?<![^\W_@$]){_SIGN}{{1,3}}(?:{gap}+{_SIGN}{{1,3}}){{2,}}(?![^\W_])"))
    for gap in (r"\.", "-", "_", r"\*", "/")
}
#: Pieces decoded at a time, and how many of them the next stretch sees again: words of so many pieces are found whole.
STRETCH, AGAIN = 64, 24
_RUN = re.compile(r"([^\W\d_])\1\1")
_MIXED = re.compile(r"[^\W\d_][0-9@$!|+(€£¡*.\-_~^]+[^\W\d_]|[@$0-9!|€£¡][^\W\d_]+|[^\W\d_]{2,}[0-9@$€£]")


def folded_letters() -> np.ndarray:
    """Letters of Latin-1 to 1..26 (accents dropped), everything else to 0, by code point below 256."""
    out = np.zeros(256, np.int64)
    for point in range(256):
        base = unicodedata.normalize("NFD", chr(point).lower())[0]
        if "a" <= base <= "z":
            out[point] = ord(base) - 96
    return out


def letter_counts(docs: DataFrame) -> DataFrame:
    """Counts of four-letter sequences (27-letter alphabet, 0 between words) over all whole texts: gram, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = folded_letters()
        counts = np.zeros(27**4, np.int64)
        for batch in batches:
            flat, starts = utf8(batch.column(0))
            # Two-byte Latin-1 letters: the lead byte is dropped, the second one shifted by it.
            lead = flat == 0xC3
            points = flat.astype(np.int64)
            points[1:][lead[:-1]] += 64
            letters = np.where(flat < 128, table[np.minimum(flat, 127)], table[np.minimum(points, 255)])
            letters[starts[1:-1]] = 0  # the first letter of a text is lost as one, words do not run across texts
            letters = letters[~lead]
            if len(letters) > 3:
                grams = ((letters[:-3] * 27 + letters[1:-2]) * 27 + letters[2:-1]) * 27 + letters[3:]
                counts += np.bincount(grams, minlength=27**4)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["gram", "n"])

    text = F.concat(F.lit(" "), whole_text())
    return docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a letter after three others, smoothed by shorter contexts: 27**4 numbers."""
    found = letter_counts(docs).toPandas()  # at most 27**4 rows
    counts = np.zeros(27**4)
    counts[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    counts = counts.reshape(27, 27, 27, 27)
    p = (counts.sum(axis=(0, 1, 2)) + 1) / (counts.sum() + 27)
    for context in (counts.sum(axis=(0, 1)), counts.sum(axis=0), counts):
        p = (context + 5 * np.broadcast_to(p, context.shape)) / (context.sum(axis=-1, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


def decoder(model: np.ndarray) -> Callable[[str], str]:
    """A function that restores one disguised token or, with blanks for gaps, a run of pieces (lower case).

    A blank is nothing or a word break; words of the result are parted by one blank.
    """
    logs = model.reshape(-1)
    table = {chr(i): int(v) for i, v in enumerate(folded_letters()) if v}

    def decode(token: str) -> str:
        # State: the last three letters, the last character read. Value: cost and the letters so far.
        states: dict[tuple[int, str], tuple[float, str]] = {(0, ""): (0.0, "")}
        for char in token:
            options = [(char, 0.0)] if char in table else []
            options += [(c, VOWEL if char == "*" else SWAP) for c in LOOKS_LIKE.get(char, "")]
            following: dict[tuple[int, str], tuple[float, str]] = {}

            def offer(key: tuple[int, str], cost: float, letters: str, into: dict = following) -> None:
                old = into.get(key)
                if old is None or (cost, letters) < old:
                    into[key] = (cost, letters)

            for (context, last), (cost, letters) in states.items():
                if char == " ":
                    offer((context, ""), cost + GAP, letters)
                    offer((0, ""), cost + BREAK - float(logs[context * 27]), letters + " ")
                    continue
                for letter, price in options:
                    code = table[letter]
                    offer(((context % 729) * 27 + code, letter), cost + price - LETTER - float(logs[context * 27 + code]), letters + letter)
                    if letters and letters[-1] == letter and last == letter:
                        offer((context, letter), cost + REPEAT + price / 2, letters)
                if char not in table:
                    offer((context, ""), cost + (STRAY if char in LOOKS_LIKE else 0.2), letters)
            states = following
        ends = [(cost - float(logs[context * 27]), letters) for (context, _), (cost, letters) in states.items()]
        return min(ends)[1] if ends else ""

    return decode


def runs(text: str) -> Iterator[list[str]]:
    """Runs of three or more short pieces that stand apart by blanks (any number) or by signs of one kind."""
    tokens = text.split()
    end = 0
    for i in [k for k, token in enumerate(tokens) if len(token) == 1]:
        if i < end or not _PIECE.fullmatch(tokens[i]):
            continue
        low, high = i, i + 1
        while low > end and len(tokens[low - 1]) <= 3 and _PIECE.fullmatch(tokens[low - 1]):
            low -= 1
        while high < len(tokens) and len(tokens[high]) <= 3 and _PIECE.fullmatch(tokens[high]):
            high += 1
        parts, end = tokens[low:high], high
        # At the edges there may be quotes and stops.
        if low and _PIECE.fullmatch(first := tokens[low - 1].lstrip("\"'([{")):
            parts = [first, *parts]
        if high < len(tokens) and _PIECE.fullmatch(last := tokens[high].rstrip("\"')]}.,;:?!")):
            parts = [*parts, last]
        if len(parts) > 2:
            yield parts
    for gap, (hint, pattern) in _PIECES.items():
        if hint.search(text):
            for found in pattern.finditer(text):
                yield re.split(f"{gap}+", found[0])


def restorer(model: np.ndarray) -> Callable[[str], set[str]]:
    """A function from a whole text to its restored words; disguised words are added to the plain ones."""
    decode = decoder(model)
    known: dict[str, str] = {}

    def restored(token: str) -> str:
        word = known.get(token)
        if word is None:
            if len(known) > 50_000:
                known.clear()
            word = known[token] = decode(token)
        return word

    def words(text: str) -> set[str]:
        lowered = text.lower()
        out: set[str] = set()
        for token in set(lowered.split()):
            plain = token.strip(".,;:!?\"'()[]{}<>|#%&*$-_=~`")
            if plain.isalpha():
                out.add(plain)
                if _RUN.search(plain):
                    out.add(restored(plain))
                if token[0] not in "$!|(*" or token[0] == plain[0]:
                    continue
            elif plain:
                out.add(plain)
            # Signs behind a word are decoration when there are two or more of them; at its edges they may be letters.
            bare = re.sub(r"[#*$%&|<>!?.,;:]{2,}$|[.,;:?\"')\]}]+$", "", token).lstrip("\"'([{<#&%.,;:?-")
            if bare and _MIXED.search(bare):
                letters = sum(c.isalpha() for c in bare)
                if letters >= 2 and 3 * letters >= len(bare):
                    out.add(restored(bare))
        for parts in runs(lowered):
            for low in range(0, max(1, len(parts) - AGAIN), STRETCH - AGAIN):
                run = " ".join(parts[low : low + STRETCH])
                # Signs alone, and short words without a single letter among them, are no disguise.
                if sum(c.isalpha() for c in run) >= 2 and len(run.replace(" ", "")) >= 4 and any(len(x) == 1 for x in run.split()):
                    out.update(restored(run).split())
        for found in _APART.finditer(lowered):
            joined = "".join(c for c in found[0] if c.isalpha())
            out.add(joined)
            out.add(restored(joined))
        out.discard("")
        return out

    return words


def bucket_features(words: set[str]) -> np.ndarray:
    """The distinct buckets of words and of the beginnings of longer words."""
    import zlib

    features = set()
    for word in words:
        features.add(zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS)
        for n in BEGINNINGS:
            if len(word) >= n:
                features.add(zlib.crc32(f"{word[:n]}~".encode("utf-8", "surrogatepass")) % BUCKETS)
    return np.fromiter(features, np.int64, len(features))


def feature_counts(labelled: DataFrame, model: np.ndarray) -> DataFrame:
    """bucket, toxic and other: labelled documents (text, y) of either kind that have the bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = restorer(model)
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y, bucket_features(words(text))] += 1
        some = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])], names=["bucket", "toxic", "other"])

    return (
        labelled.select("text", "y").mapInArrow(count, "bucket long, toxic long, other long")
        .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    )


def evidence_column(docs: DataFrame, model: np.ndarray, weights: dict[int, float]) -> DataFrame:
    """doc_id and the evidence of every document (columns ``doc_id`` and ``_text``)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))  # 27**4 and at most BUCKETS numbers

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, table = shared.value
        words = restorer(logs)
        weight = np.zeros(BUCKETS)
        weight[list(table)] = list(table.values())
        for batch in batches:
            found = (weight[bucket_features(words(t))] for t in batch.column(1).to_pylist())
            sums = [float(np.sort(w)[-STRONGEST:].sum()) for w in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64())], names=["doc_id", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "_text").mapInArrow(measure, f"doc_id {kind}, evidence double")


def wilson_bound(hits: Column, trials: Column, z: float = DEVIATIONS) -> Column:
    """Lower confidence bound of a share (Wilson's)."""
    share = hits / trials
    spread = z * F.sqrt(share * (1 - share) / trials + F.lit(z * z / 4) / (trials * trials))
    return (share + F.lit(z * z / 2) / trials - spread) / (1 + F.lit(z * z) / trials)


def logistic(levels: np.ndarray, sizes: np.ndarray, positives: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a weakly penalised logistic fit on counted levels.

    Newton's method with halved steps: the objective rises with every step, also where
    the classes are apart and an unpenalised fit would not end.
    """
    x = np.column_stack([np.ones(len(levels)), levels])

    def objective(b: np.ndarray) -> float:
        z = x @ b
        return float(positives @ z - sizes @ np.logaddexp(0, z) - 0.05 * b @ b)

    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        gradient = x.T @ (positives - sizes * p) - 0.1 * b
        hessian = (x * (sizes * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step, before = np.linalg.solve(hessian, gradient), objective(b)
        while objective(b + step) < before and np.abs(step).max() > 1e-12:
            step = step / 2
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), max(0.0, float(b[1]))


def score_toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out (fold 0), score and predicted (score at least ``cut``).

    Folds 1 to 3 of the labelled rows give the weights of words, fold 4 the logistic fit.
    Null and empty texts have no evidence and the lowest score. Null labels are ignored;
    without labels all scores are equal and low. Repeated rows are scored each. No
    documents: no rows.
    """
    model = language_model(docs)
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_known"), F.col("toxic").cast("int").alias("y"))
    known = known.where(fold("_known") != 0)
    share = min(1.0, sample / max(1, known.count()))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("_known"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # At most about SAMPLE ids of 16 bytes: small enough to send to every task, so the texts stay where they are.
    texts = docs.select("doc_id", whole_text().alias("_text"))
    labelled = texts.join(F.broadcast(known), F.col("doc_id") == F.col("_known"))
    counts = cut_lineage(feature_counts(labelled.where(fold("doc_id") != 4).select(F.col("_text").alias("text"), "y"), model))
    sizes = known.where(fold("_known") != 4).groupBy("y").count().collect()
    size = {r["y"]: r["count"] for r in sizes}
    prior = (size.get(1, 0) + 0.5) / (sum(size.values()) + 1.0)
    least = wilson_bound(F.col("toxic"), F.col("toxic") + F.col("other"))
    odds = F.log(least / (1 - least)) - F.lit(float(np.log(prior / (1 - prior))))
    strong = counts.where("toxic > 0").select("bucket", odds.alias("w")).where(F.col("w") >= STRONG)
    weights = {r["bucket"]: r["w"] for r in strong.collect()}  # at most BUCKETS
    evidence = cut_lineage(evidence_column(texts, model, weights))
    level = F.least(F.floor(F.col("evidence") / STEP), F.lit(int(MOST_EVIDENCE / STEP))).alias("level")
    fitted = (
        evidence.join(F.broadcast(known), F.col("doc_id") == F.col("_known")).where(fold("doc_id") == 4)
        .groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic")).orderBy("level").collect()
    )
    at = np.array([r["level"] * STEP for r in fitted], float)
    intercept, slope = logistic(at, np.array([r["n"] for r in fitted], float), np.array([r["toxic"] for r in fitted], float)) if fitted else (-3.0, 0.5)
    score = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.least(F.col("evidence"), F.lit(4 * MOST_EVIDENCE)))))
    return evidence.select("doc_id", (fold("doc_id") == 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int")
    )
