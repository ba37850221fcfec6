import random

import numpy as np
import pytest

from facetframe.llm import toxicity as t

WORDS = "the idiot loser stupid moron pathetic trash clown disgusting scum worthless and of with people were going home again".split()


@pytest.fixture(scope="module")
def model():
    counts = np.zeros((27,) * 4)
    table = t.folded_letters()
    for word in WORDS:
        letters = [0, 0, 0, *(int(table[ord(c)]) for c in word), 0]
        for i in range(len(letters) - 3):
            counts[tuple(letters[i : i + 4])] += 50
    p = (counts.sum(axis=(0, 1, 2)) + 1) / (counts.sum() + 27)
    for context in (counts.sum(axis=(0, 1)), counts.sum(axis=0), counts):
        p = (context + 5 * np.broadcast_to(p, context.shape)) / (context.sum(axis=-1, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


@pytest.mark.parametrize("written, meant", [
    ("1d10t", "idiot"), ("l0ser", "loser"), ("$tupid", "stupid"), ("m0r0n", "moron"), ("p4th3t1c", "pathetic"), ("tr@sh", "trash"),
    ("cl0wn", "clown"), ("idiooooot", "idiot"), ("d1sgust1ng", "disgusting"), ("sc*m", "scum"), ("", ""),
])
def test_decoded(model, written, meant):
    assert t.decoder(model)(written) == meant


def test_decoder_finds_the_cheapest_path(model):
    """All readings of short tokens, priced one by one."""
    table = {chr(i): int(v) for i, v in enumerate(t.folded_letters()) if v}
    logs = model.reshape(-1)

    def cheapest(token):
        best = (float("inf"), "")

        def go(at, context, last, cost, letters):
            nonlocal best
            if at == len(token):
                best = min(best, (cost - float(logs[context * 27]), letters))
                return
            char = token[at]
            options = [(char, 0.0)] if char in table else []
            options += [(c, t.VOWEL if char == "*" else t.SWAP) for c in t.LOOKS_LIKE.get(char, "")]
            for letter, price in options:
                code = table[letter]
                go(at + 1, context % 729 * 27 + code, letter, cost + price - t.LETTER - float(logs[context * 27 + code]), letters + letter)
                if letters and letters[-1] == letter and last == letter:
                    go(at + 1, context, letter, cost + t.REPEAT + price / 2, letters)
            if char not in table:
                go(at + 1, context, "", cost + (t.STRAY if char in t.LOOKS_LIKE else 0.2), letters)

        go(0, 0, "", 0.0, "")
        return best[1]

    r, decode = random.Random(6), t.decoder(model)
    for _ in range(300):
        token = "".join(r.choice("ab1l0o$s-e3") for _ in range(r.randint(1, 6)))
        assert decode(token) == cheapest(token), token


def test_restored_words(model):
    words = t.restorer(model)("People are i d i o t s, s-t-u-p-i-d L.0.S.E.R M0R0N!!! Going, loooser; 1d10t*** home")
    assert {"idiots", "stupid", "moron", "loser", "idiot", "going", "home", "people"} <= words
    assert t.restorer(model)("") == set()


def test_wilson_bound(spark):
    got = spark.range(1).select(t.wilson_bound(t.F.lit(8.0), t.F.lit(8.0), 3.0)).first()[0]
    assert got == pytest.approx(1 / (1 + 9 / 8))


def test_letter_counts(spark):
    texts = ["Aé b", None, "", "ßx€y", "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    n = sum(r["n"] for r in t.letter_counts(docs).collect())
    assert n > 0
    a, b, c = 1, 2, 3
    found = {r["gram"]: r["n"] for r in t.letter_counts(docs).collect()}
    assert found[((0 * 27 + a) * 27 + b) * 27 + c] == 1


def test_disguised_insults_are_found(spark):
    r = random.Random(8)
    plain = [f"{a}{b}" for a in "ba be bi bo bu da de di do du la le li lo lu".split() for b in "ran ren rin ron sal sel sil".split()]
    bad = ["idiot", "loser", "moron"]

    def text(insult=None):
        words = [r.choice(plain) for _ in range(40)]
        if insult:
            words[r.randrange(40)] = insult
        return " ".join(words)

    rows = [(i, text(r.choice(bad) if i % 3 == 0 else None)) for i in range(900)]
    labels = [(i, int(i % 3 == 0)) for i in range(900)]
    disguised = [(1000 + i, text(w)) for i, w in enumerate(["1d10t", "l0s3r", "m0ron", "m o r o n", "l-o-s-e-r", "idiooooot", "LOSER!!!"] * 3)]
    clean = [(2000 + i, text()) for i in range(60)] + [(3000, None), (3001, ""), (None, "x"), (3002, text()), (3002, text())]
    docs = spark.createDataFrame(rows + disguised + clean, "doc_id long, text string").selectExpr("*", "1 y", "2 score", "3 evidence")
    table = spark.createDataFrame([*labels, (None, 1), (2000, None)], "doc_id long, toxic int")
    got = t.score_toxicity(docs, table).collect()
    assert len(got) == len(rows + disguised + clean)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == y for i, y in labels)
    assert all(by[i]["predicted"] for i, _ in disguised)
    assert not any(by[i]["predicted"] for i, _ in clean)
    assert not any(r["predicted"] for r in t.score_toxicity(docs, table.limit(0)).collect())
    assert t.score_toxicity(docs.limit(0), table).count() == 0


def test_logistic_fit_of_separate_classes():
    levels = np.array([0, 1, 2, 4, 18, 20, 24], float)
    intercept, slope = t.logistic(levels, np.array([9e4, 500, 300, 90, 30, 500, 9000]), np.array([0, 0, 0, 0, 30, 500, 9000.0]))
    assert 4 < -intercept / slope < 18
    intercept, slope = t.logistic(np.array([0.0, 1.0]), np.array([1000.0, 1000.0]), np.array([100.0, 700.0]))
    assert intercept == pytest.approx(np.log(1 / 9), abs=0.01) and intercept + slope == pytest.approx(np.log(7 / 3), abs=0.01)


@pytest.mark.parametrize("written, meant", [
    ("1 d 1 0 t", ["idiot"]), ("i d 1 o t", ["idiot"]), ("m 0 r 0 n", ["moron"]), ("l 0 s 3 r", ["loser"]), ("i  d  i  o  t", ["idiot"]),
    ("i d i o t m o r o n", ["idiot", "moron"]), ("you i-d-1-0-t here", ["idiot"]), ("i d  io   t", ["idiot"]), ("m-0--r-0-n", ["moron"]),
    ("l o s e r " * 60, ["loser"]), ("i di ot", ["idiot"]),
])
def test_spacing_is_decoded(model, written, meant):
    assert set(meant) <= t.restorer(model)(written)
