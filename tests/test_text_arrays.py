"""Texts are cleaned once, and phrases merged where the documents lie."""

from pyspark.sql import functions as F

from facetframe.functions import tokens as K
from facetframe.operators import text as X
from facetframe.schema import INDEX

CONFIG = X.TextConfig(default_stopwords=None)


def test_the_token_table_reads_stored_arrays(spark):
    df = spark.createDataFrame([(1, "some words from a text")], f"{INDEX} long, text string")
    tokens = X.clean_tokens(df, "text", CONFIG)
    assert "regexp_extract_all" not in tokens._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r["token"] for r in tokens.orderBy("pos").collect()] == ["some", "words", "from", "text"]


def test_merging_where_the_documents_lie_equals_windows(spark):
    texts = ["red sea port red sea", "old red sea port", "port red", "", "sea"] * 120
    rows = [(i % 590, t.split()) for i, t in enumerate(texts)]  # ten ids are shared by two rows each
    rows += [(None, ["red", "sea"]), (600, ["old", "red", "sea", "port", "red", "sea"])]
    arrays = spark.createDataFrame(rows, "id long, t array<string>").repartition(3)
    found = spark.createDataFrame([("red", "sea"), ("sea", "port")], "token string, next string")
    tokens = X.tokens_of(arrays)
    count = lambda d: sorted((r["token"], r["count"]) for r in d.groupBy("token").count().collect())
    assert count(X.merge_phrases(tokens, found, arrays=arrays)) == count(X.merge_phrases(tokens, found))
    alone = arrays.where("id = 600")
    merged = X.merge_phrases(X.tokens_of(alone), found, arrays=alone).orderBy("pos").collect()
    assert [(r["pos"], r["token"]) for r in merged] == [(0, "old"), (1, "red_sea"), (3, "port"), (4, "red_sea")]


def test_pruning_keeps_the_order_and_empty_documents(spark):
    arrays = spark.createDataFrame([(1, ["b", "a", "c", "a"]), (2, []), (3, ["c"])], "id long, t array<string>")
    vocab = spark.createDataFrame([("a",), ("b",)], "token string")
    assert {r["id"]: r["t"] for r in X.prune_in_place(arrays, vocab).collect()} == {1: ["b", "a", "a"], 2: [], 3: []}
    assert X.prune_in_place(arrays, vocab.limit(0)).select(F.sum(F.size("t"))).first()[0] == 0


def test_the_quick_tokenizer_finds_the_same(spark):
    texts = ["mail a.b+c@d-e.org, +@-.- x@y z@@q.r.s", "see www.a.b http://c.d/e?f FTP://g 3.5 1,2/3 it's _ — ok", "", "@", "no sign: 4th, v2"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.regexp_extract_all("text", F.lit(K.TOKEN), F.lit(1))
    for a, b, words in df.select(plain, K.tokenize(F.col("text")), K.tokenize(F.col("text"), symbols=False)).collect():
        assert a == b
        assert [t for t in a if len(t) > 1 or t.isalnum() or t == "_"] == words
