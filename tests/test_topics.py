"""Text clean-up, clusters and coherence on small hand-made inputs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetframe.operators import clustering, evaluation, text, topics, vectors
from facetframe.schema import INDEX, Column, TableSchema


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), f"`{INDEX}` long, t string")


def test_heavy_tokens(spark):
    df = frame(spark, ["Write to A.B@example.org or see https://example.org/x?y=1, it costs 1,000.50 and twenty.", None, "the of a"])
    config = text.TextConfig(stopwords=("costs",), ignore_tokens=("it",))
    tokens = [r["token"] for r in text.clean_tokens(df, "t", config).orderBy("id", "pos").collect()]
    assert tokens == ["write", "EMAIL", "see", "URL", "it", "NUMBER", "NUMBER"]


def test_light_text(spark):
    df = frame(spark, ["Mail me@x.org: Ünïcode goes, Case stays!"])
    assert text.preprocess_light(df, "t").first()["document"] == "Mail email : goes , Case stays !"


@pytest.mark.parametrize("known_size", [2, None])
def test_phrases_merge_left_to_right(spark, known_size):
    docs = [["a", "b", "c", "d", "e"], ["a", "b", "a", "b"], ["x", "a"]]
    rows = [(i, p, w, d[p + 1] if p + 1 < len(d) else None) for i, d in enumerate(docs) for p, w in enumerate(d)]
    tokens = spark.createDataFrame(rows, "id long, pos int, token string, next string")
    found = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "token string, next string")
    merged = text.merge_phrases(tokens, found, known_size)
    out = {r["id"]: r["d"] for r in text.to_documents(merged, 1).withColumnRenamed("document", "d").collect()}
    assert out == {0: "a_b c_d e", 1: "a_b a_b", 2: "x a"}


def test_short_documents_and_protected_tokens(spark):
    df = frame(spark, ["apple banana cherry"] * 4 + ["apple rare"] * 1 + ["banana cherry"] * 3)
    config = text.TextConfig(min_df=2, max_df=0.9, min_document_length=2, ignore_tokens=("rare",), phrase_threshold=1e9)
    out = {r["id"]: r["document"] for r in text.preprocess_heavy(df, "t", config).collect()}
    assert out[0] == "apple banana cherry" and out[4] == "apple rare" and out[7] == "banana cherry"
    schema = TableSchema.of(Column("t", "textual"))
    strict = text.TextConfig(min_df=2, max_df=0.9, min_document_length=3, phrase_threshold=1e9)
    table = text.preprocess(df, schema, "t", strict)
    assert table.filter("`t (Preprocessed)` IS NULL").count() == 4


def test_ctfidf_by_hand(spark):
    docs = spark.createDataFrame([(0, "red red blue"), (1, "blue green"), (None, "lost")], "c int, t string")
    out = {(r["class"], r["term"]): r["weight"] for r in topics.ctfidf(topics.class_terms(docs, "c", "t")).collect()}
    idf = lambda f: math.log(1 + (2 - f + 0.5) / (f + 0.5))  # noqa: E731  mean class size 2.5, as an integer 2
    assert out[0, "red"] == pytest.approx(math.sqrt(2 / 3) * idf(2))
    assert out[1, "green"] == pytest.approx(math.sqrt(1 / 2) * idf(1))
    assert len(out) == 4


def test_top_words_limit_before_the_shuffle(spark):
    weights = spark.range(1000).select((F.col("id") % 3).alias("class"), F.col("id").cast("string").alias("term"), (F.rand(1) + 1).alias("weight"))
    top = topics.top_words(weights, 5)
    assert top.count() == 15
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def blobs(spark, copies=0):
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(0, 0.3, (150, 2)), rng.normal(8, 0.3, (90, 2)), [[30, -30], [-40, 25], [60, 60]]])
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(10_000 + i, [8.0, 8.0]) for i in range(copies)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def test_blobs_and_outliers(spark):
    out = clustering.density_clusters(blobs(spark), 15, 5, resolution=4.0)
    assert {r["topic"]: r["count"] for r in out.groupBy("topic").count().collect()} == {0: 150, 1: 90, -1: 3}


def test_many_copies_change_only_the_sizes(spark):
    out = clustering.density_clusters(blobs(spark, 2000), 15, 5, resolution=4.0)
    sizes = {r["topic"]: r["count"] for r in out.groupBy("topic").count().collect()}
    assert sum(sizes.values()) == 2243 and sizes[0] == 2090 and sizes[1] == 150


def test_oversized_clusters_are_split_and_nothing_is_lost(spark):
    out = clustering.density_clusters(blobs(spark), 10, 3, max_topic_size=0.45, resolution=4.0)
    sizes = {r["topic"]: r["count"] for r in out.groupBy("topic").count().collect()}
    assert sum(sizes.values()) == 243 and max(v for k, v in sizes.items() if k >= 0) <= 0.45 * 243


def test_components_of_a_long_chain(spark):
    n = 300
    nodes = spark.range(n + 5).withColumnRenamed("id", "node")
    edges = spark.range(n - 1).select(((F.col("id") * 7) % n).alias("a"), (((F.col("id") + 1) * 7) % n).alias("b"))
    labels = {r["node"]: r["label"] for r in clustering.connected_components(nodes, edges).collect()}
    assert {labels[i] for i in range(n)} == {0} and [labels[n + i] for i in range(5)] == list(range(n, n + 5))


def test_outliers_by_join_and_by_shared_means_agree(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(-1, 4)), rng.normal(size=6).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, topic int, vec array<double>")
    shared = {r["id"]: r["topic"] for r in vectors.reduce_outliers(df).collect()}
    monkeypatch.setattr(vectors, "MAX_SHARED_NUMBERS", 3)
    joined = {r["id"]: r["topic"] for r in vectors.reduce_outliers(df).collect()}
    assert shared == joined and -1 not in shared.values()


def test_window_counts_by_brute_force(spark):
    rng = np.random.default_rng(9)
    docs = [" ".join(rng.choice(["aa", "bb", "cc", "dd"], n)) for n in (3, 12, 40)]
    words = spark.createDataFrame([(0, 0, "aa"), (0, 1, "bb"), (1, 0, "bb"), (1, 1, "cc")], "topic int, place int, word string")
    df = spark.createDataFrame([(d,) for d in docs], "document string")
    out = {(r["w1"], r["w2"]): r["n"] for r in evaluation.window_counts(df, words, 5).collect()}
    windows = []
    for d in docs:
        t = d.split()
        windows += [set(t[s:s + 5]) for s in range(max(len(t) - 4, 1))]
    for a, b in itertools.combinations_with_replacement(["aa", "bb", "cc"], 2):
        expected = sum(a in w and b in w for w in windows)
        if (a, b) == ("aa", "cc"):
            assert (a, b) not in out
        else:
            assert out[a, b] == expected


def test_sweep_settings():
    assert evaluation.candidates((12, 10), None, 5) == [(10, None), (11, None), (12, None)]
    drawn = evaluation.candidates((2, 60), (2, 20), 6)
    assert len(set(drawn)) == 6 and drawn == evaluation.candidates((2, 60), (2, 20), 6)


def test_a_dense_spot_is_split_more_than_six_times(spark):
    rng = np.random.default_rng(3)
    near = rng.normal(0, 1e-5, (120, 2))
    points = np.vstack([rng.normal(50, 20, (120, 2)), near + [3, 3], near + [3 + 4e-4, 3]])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>")
    out = clustering.density_clusters(df, 10, 3, max_topic_size=0.4)
    topics_of = {r["id"]: r["topic"] for r in out.collect()}
    assert len(topics_of) == 360
    spots = {topics_of[i] for i in range(120, 360)} - {-1}
    assert spots and sum(topics_of[i] >= 0 for i in range(120, 360)) > 200


def test_only_one_place_above_the_limit_becomes_outliers(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100 + i, [50.0 + i % 3 * 1e-3, 9.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    out = {r["id"]: r["topic"] for r in clustering.density_clusters(df, 5, 2, max_topic_size=0.5).collect()}
    assert len(out) == 100 and {out[i] for i in range(60)} == {-1} and -1 not in {out[100 + i] for i in range(40)}


def test_outliers_without_a_vector_stay(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, -1, None), (4, -1, [0.1, 0.9]), (5, -1, [1.0, 1.0])], "id long, topic int, vec array<double>")
    assert {r["id"]: r["topic"] for r in vectors.reduce_outliers(df).collect()} == {1: 0, 2: 1, 3: -1, 4: 1, 5: 0}


def test_merge_order_against_all_pairs():
    rng = np.random.default_rng(5)
    for n in (2, 7, 40):
        means, weight = rng.normal(size=(n, 4)), rng.integers(1, 9, n).astype(float)
        groups = {i: [i] for i in range(n)}
        m, w = means.copy(), weight.copy()
        while len(groups) > 2:
            live = sorted(groups)
            unit = {i: m[i] / np.linalg.norm(m[i]) for i in live}
            i, j = max(itertools.combinations(live, 2), key=lambda p: (unit[p[0]] @ unit[p[1]], -p[0], -p[1]))
            m[i] = (m[i] * w[i] + m[j] * w[j]) / (w[i] + w[j])
            w[i] += w[j]
            groups[i] += groups.pop(j)
        expected = {k: i for i, members in groups.items() for k in members}
        assert dict(enumerate(vectors.merge_order(means, weight, 2).tolist())) == expected


def test_more_than_five_hundred_topics_merge_by_the_same_rule(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i, (rng.normal(0, 1e-3, 3) + (np.eye(3)[i % 3])).tolist()) for i in range(501)]
    df = spark.createDataFrame(rows, "id long, topic int, vec array<double>")
    out = {r["id"]: r["topic"] for r in vectors.merge_topics(df, 3).collect()}
    assert all(out[i] == out[i % 3] for i in range(501)) and len(set(out.values())) == 3


def test_small_and_large_word_lists_give_the_same_documents(spark, monkeypatch):
    rng = np.random.default_rng(12)
    words = [f"word{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, 30)) + " new york city hall" * int(rng.integers(0, 4)) for _ in range(120)] + [None, "a b"]
    df = frame(spark, texts)
    config = text.TextConfig(min_df=3, max_df=0.9, min_document_length=3, phrase_threshold=1.0)
    small = {r["id"]: r["document"] for r in text.preprocess_heavy(df, "t", config).collect()}
    monkeypatch.setattr(text, "BROADCAST_BYTES", -1)
    large = {r["id"]: r["document"] for r in text.preprocess_heavy(df, "t", config).collect()}
    assert small == large and any("_" in d for d in small.values())


def test_connectors_stand_inside_phrases(spark, monkeypatch):
    texts = ["point of sale terminal broke"] * 6 + ["of point of sale here"] * 3 + [f"word{i} of thing{i} sale" for i in range(30)] + ["the point of of sale", "sale of"]
    df = frame(spark, texts)
    config = text.TextConfig(default_stopwords=None, min_word_length=2, min_df=1, max_df=1.0, min_document_length=1, phrase_threshold=2.0, connectors=text.CONNECTORS)
    small = {r["id"]: r["document"] for r in text.preprocess_heavy(df, "t", config).collect()}
    assert small[0] == "point_of_sale terminal_broke" and small[6] == "of point_of_sale here" and small[40] == "sale of"
    assert small[39] == "the point of of sale"  # other words between make another pair
    monkeypatch.setattr(text, "BROADCAST_BYTES", -1)
    assert small == {r["id"]: r["document"] for r in text.preprocess_heavy(df, "t", config).collect()}


def test_sweep_reads_the_texts_once_for_all_settings(spark, monkeypatch):
    """Each setting scores as its own topics would, also where ids repeat; windows and words are counted by one pass each."""
    rng = np.random.default_rng(8)
    words = [f"w{a}{b}" for a in "abcdef" for b in "abcdef"]
    texts = [(i % 90, None if i == 7 else " ".join(rng.choice(words[i % 4 * 8 : i % 4 * 8 + 14], 6 + i % 9))) for i in range(100)]
    points = [(i, (rng.normal(0, 0.3, 2) + [i % 4 * 4, i % 3]).tolist()) for i in range(120)] + [(5, [4.0, 2.0])]
    docs = spark.createDataFrame(texts, "id long, document string")
    given = spark.createDataFrame(points, "id long, vec array<double>")
    calls, counting, terms = [], evaluation._window_counts, topics.class_terms
    monkeypatch.setattr(evaluation, "_window_counts", lambda *a: calls.append("windows") or counting(*a))
    for module in (topics, evaluation):
        monkeypatch.setattr(module, "class_terms", lambda *a: calls.append("words") or terms(*a), raising=False)
    got = evaluation.sweep(docs, given, given, (1, 5), (2, 3), (2, 5), trials=3, seed=1).collect()
    assert sorted(calls) == ["windows", "words"] and len(got) == 3
    for row in got:
        if row["error"]:
            continue
        found = clustering.density_clusters(given, row["min_topic_size"], row["topic_confidence_threshold"])
        labelled = docs.join(vectors.merge_topics(found.join(given, "id"), 5), "id")
        own = evaluation.evaluate_topics(labelled, topics.extract_topics(labelled, "topic", "document"), labelled).first()
        assert row["topics"] == own["topics"] and row["topics"] > 0
        assert row["coherence"] == pytest.approx(own["coherence_v"], abs=1e-9)
        assert row["diversity"] == pytest.approx(own["topic_diversity"])


def test_window_counts_of_a_long_text_in_steps(spark, monkeypatch):
    rng = np.random.default_rng(10)
    terms = rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"], 50).tolist()
    monkeypatch.setattr(evaluation, "_STARTS", 7)
    words = spark.createDataFrame([(0, 0, "aa"), (0, 1, "bb")], "topic int, place int, word string")
    out = {(r["w1"], r["w2"]): r["n"] for r in evaluation.window_counts(spark.createDataFrame([(" ".join(terms),)], "document string"), words, 4).collect()}
    windows = [set(terms[k : k + 4]) for k in range(47)]
    assert out == {(None, None): 47, **{(a, b): sum(a in w and b in w for w in windows) for a, b in (("aa", "aa"), ("aa", "bb"), ("bb", "bb"))}}


def test_discovery_keeps_the_cleaned_texts_only(spark, monkeypatch):
    """What led to the cleaned texts is gone before they are embedded; rows that share an id meet each other's texts."""
    import glob

    from facetframe import session
    from facetframe.operators import discovery

    folder = session.stage_folder(spark).removeprefix("file:")
    stored = lambda: set(glob.glob(f"{folder}/stage-*"))
    seen = []

    def embed(words, size):
        seen.append((len(stored() - before), sorted((r["id"], r["document"]) for r in words.collect())))
        raise InterruptedError

    monkeypatch.setattr(discovery, "embed_lsa", embed)
    plain = text.TextConfig(min_df=1, max_df=1.0, min_document_length=1, phrase_threshold=1e9)
    config, schema = discovery.TopicConfig(text=plain), TableSchema.of(Column("t", "textual"))
    once = [(0, "apple pear"), (1, None), (2, "nail screw"), (None, "bolt")]
    for rows in (once, [*once, (2, "plum")]):
        df = spark.createDataFrame(rows, f"`{INDEX}` long, t string")
        with session.stage_scope(spark), pytest.raises(InterruptedError):
            before = stored()
            discovery.discover_topics(df, schema, "t", config)
    assert seen[0] == (1, [(0, "apple pear"), (2, "nail screw")])
    assert seen[1] == (2, [(0, "apple pear"), *[(2, "nail screw")] * 2, *[(2, "plum")] * 2])
