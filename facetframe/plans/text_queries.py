"""Text clean-up, word statistics and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import text as X
from ..operators import topics as M
from ..schema import INDEX
from ..session import cut_lineage
from ..sources import with_row_index
from . import tables as T
from .registry import query, r, rounded
from .tables import DOCUMENTS_SQL, EQ, GAPS_SQL, IN, TOPIC_DOCUMENTS_SQL

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in X.TextConfig(default_stopwords=None, stopwords=("the", "of", "and", "to")).stop_list())
_CONFIG = X.TextConfig(default_stopwords=None, stopwords=("the", "of", "and", "to"))
_TOKEN = K.TOKEN.replace("'", "''")
_NUMBERS = ", ".join(f"'{w}'" for w in K.NUMBER_WORDS)


def _tokens_sql(table: str, key: str, column: str) -> str:
    """Tokens with their position among all tokens of the text, replaced and filtered."""
    return f"""
        w AS (SELECT {key} AS id, unnest(regexp_extract_all({column}, '{_TOKEN}', 1)) AS t,
                     generate_subscripts(regexp_extract_all({column}, '{_TOKEN}', 1), 1) AS raw FROM {table} WHERE {column} IS NOT NULL),
        x AS (SELECT id, raw, CASE
                  WHEN regexp_full_match(t, '{K.EMAIL}') THEN 'EMAIL'
                  WHEN regexp_full_match(t, '{K.LINK}') AND lower(t[1:4]) IN ('http', 'ftp:', 'www.') THEN 'URL'
                  WHEN regexp_full_match(t, '{K.NUMBER}') OR lower(t) IN ({_NUMBERS}) THEN 'NUMBER' ELSE lower(t) END AS token FROM w),
        tok AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY raw) - 1 AS pos, token FROM x
                WHERE token IN ('EMAIL', 'URL', 'NUMBER')
                   OR (NOT regexp_full_match(token, '{K.SYMBOL}+') AND length(token) >= 3 AND token NOT IN ({_STOP})))"""


@query("WITH " + _tokens_sql("pages", "page_id", "html") + " SELECT token, count(*) AS n, count(DISTINCT id) AS texts FROM tok GROUP BY 1")
def clean_tokens_of_pages(spark, folder):
    """Web pages hold links and numbers; counted per token."""
    pages = with_row_index(T.load(spark, folder, "pages", spread=True), "page_id")
    tokens = X.clean_tokens(pages, "html", _CONFIG)
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("texts"))


@query("WITH " + _tokens_sql("documents", "doc_id", "text") + """,
    lem AS (SELECT DISTINCT token, left(token, 4) AS lemma FROM tok WHERE token LIKE '%s' AND length(token) > 4)
    SELECT coalesce(lemma, tok.token) AS token, count(*) AS n FROM tok LEFT JOIN lem ON lem.token = tok.token GROUP BY 1""")
def clean_tokens_with_lemmas(spark, folder):
    """A lemma table looked up per token: here every word in -s is cut to four letters."""
    docs = with_row_index(T.load(spark, folder, "documents", spread=True), "doc_id")
    plain = X.clean_tokens(docs, "text", _CONFIG).select("token").distinct()
    lemmas = plain.filter(F.col("token").endswith("s") & (F.length("token") > 4)).select("token", F.substring("token", 1, 4).alias("lemma"))
    return X.clean_tokens(docs, "text", _CONFIG, lemmas).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_PHRASES = """,
    pr AS (SELECT id, pos, token, lead(token) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM tok),
    uni AS (SELECT token, count(*)::DOUBLE AS n FROM tok GROUP BY 1),
    bi AS (SELECT token, nxt, count(*)::DOUBLE AS n FROM pr WHERE nxt IS NOT NULL GROUP BY ALL),
    ph AS (SELECT bi.token, bi.nxt, (bi.n - 5) * ((SELECT count(*) FROM uni) + (SELECT count(*) FROM bi)) / (a.n * b.n) AS score
           FROM bi JOIN uni a ON a.token = bi.token JOIN uni b ON b.token = bi.nxt
           WHERE bi.n > 5 AND (bi.n - 5) * ((SELECT count(*) FROM uni) + (SELECT count(*) FROM bi)) / (a.n * b.n) > 10)"""
_MERGED = _PHRASES + """,
    fl AS (SELECT pr.*, ph.score IS NOT NULL AS f FROM pr LEFT JOIN ph ON ph.token = pr.token AND ph.nxt = pr.nxt),
    br AS (SELECT *, pos - coalesce(max(CASE WHEN NOT f THEN pos END) OVER (PARTITION BY id ORDER BY pos), -1) AS along FROM fl),
    mg AS (SELECT *, f AND along % 2 = 1 AS m FROM br),
    cs AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY id ORDER BY pos), FALSE) AS gone FROM mg),
    mtok AS (SELECT id, pos, CASE WHEN m THEN token || '_' || nxt ELSE token END AS token FROM cs WHERE NOT gone)"""


@query("WITH " + _tokens_sql("documents", "doc_id", "text") + _PHRASES + " SELECT token, nxt AS next, " + r("score", 4) + " AS score FROM ph")
def phrases(spark, folder):
    docs = with_row_index(T.load(spark, folder, "documents", spread=True), "doc_id")
    return rounded(X.phrases(X.clean_tokens(docs, "text", _CONFIG), 5), 4)


@query("WITH " + _tokens_sql("documents", "doc_id", "text") + _MERGED + " SELECT token, count(*) AS n FROM mtok GROUP BY 1")
def merged_phrases(spark, folder):
    docs = with_row_index(T.load(spark, folder, "documents", spread=True), "doc_id")
    arrays = cut_lineage(X.clean_arrays(docs, "text", _CONFIG))
    tokens = X.tokens_of(arrays)
    merged = X.merge_phrases(tokens, X.phrases(tokens, 5), arrays=arrays)
    return merged.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_CONNECTORS = ("for", "with", "from", "des", "von")


@query("WITH " + _tokens_sql("documents", "doc_id", "text") + """,
    cn AS (SELECT *, token IN ('for', 'with', 'from', 'des', 'von') AS c FROM tok),
    st AS (SELECT id, pos, token, lead(token) OVER w AS nxt, lead(pos) OVER w AS npos FROM cn WHERE NOT c WINDOW w AS (PARTITION BY id ORDER BY pos)),
    pr AS (SELECT st.id, st.pos, st.token, nxt, coalesce(string_agg(cn.token, '_' ORDER BY cn.pos), '') AS between
           FROM st LEFT JOIN cn ON cn.id = st.id AND cn.pos > st.pos AND cn.pos < st.npos WHERE nxt IS NOT NULL GROUP BY ALL),
    uni AS (SELECT token, count(*)::DOUBLE AS n FROM tok GROUP BY 1),
    bi AS (SELECT token, between, nxt, count(*)::DOUBLE AS n FROM pr GROUP BY ALL),
    ph AS (SELECT bi.*, (bi.n - 5) * ((SELECT count(*) FROM uni) + (SELECT count(*) FROM bi)) / (a.n * b.n) AS score
           FROM bi JOIN uni a ON a.token = bi.token JOIN uni b ON b.token = bi.nxt)
    SELECT token, between, nxt AS next, """ + r("score", 4) + " AS score FROM ph WHERE n > 5 AND score > 10")
def phrases_with_connectors(spark, folder):
    """Words that may stand inside a phrase, here of several languages."""
    docs = with_row_index(T.load(spark, folder, "documents", spread=True), "doc_id")
    arrays = cut_lineage(X.clean_arrays(docs, "text", _CONFIG))
    found = X.phrases(X.pairs_of(arrays, _CONNECTORS), 5, words=arrays.select(F.explode("t").alias("token")))
    return rounded(found, 4)


_VOCABULARY = """,
    dfs AS (SELECT token, count(DISTINCT id) AS df FROM mtok GROUP BY 1),
    voc AS (SELECT token, df FROM dfs WHERE df >= 5 AND df <= 0.5 * (SELECT count(*) FROM documents))"""


@query("WITH " + _tokens_sql("documents", "doc_id", "text") + _MERGED + _VOCABULARY + """,
    kept AS (SELECT m.* FROM mtok m JOIN voc v ON v.token = m.token)
    SELECT id, string_agg(token, ' ' ORDER BY pos) AS document FROM kept GROUP BY 1 HAVING count(*) >= 5""")
def preprocess_for_topics(spark, folder):
    docs = with_row_index(T.load(spark, folder, "documents", spread=True), "doc_id")
    return X.preprocess_heavy(docs, "text", _CONFIG)


@query("WITH " + _tokens_sql("documents", "doc_id", "text").replace("tok AS", "mtok AS") + """,
    dfs AS (SELECT token, count(DISTINCT id) AS df FROM mtok GROUP BY 1)
    SELECT token, df FROM dfs WHERE df >= 5 AND df <= 0.5 * (SELECT count(*) FROM documents) ORDER BY df DESC, token LIMIT 200""")
def vocabulary_pruning(spark, folder):
    docs = with_row_index(T.load(spark, folder, "documents", spread=True), "doc_id")
    config = X.TextConfig(default_stopwords=None, stopwords=("the", "of", "and", "to"), max_unique_words=200)
    return X.vocabulary(X.clean_tokens(docs, "text", config), docs, config)


@query(f"""
    WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '{_TOKEN}', 1)) AS t,
                      generate_subscripts(regexp_extract_all(text, '{_TOKEN}', 1), 1) AS pos FROM documents),
         x AS (SELECT id, pos, CASE WHEN regexp_full_match(t, '{K.EMAIL}') THEN 'email'
                                    WHEN regexp_full_match(t, '{K.LINK}') AND lower(t[1:4]) IN ('http', 'ftp:', 'www.') THEN 'url' ELSE t END AS t
               FROM w WHERE regexp_full_match(t, '[\\x00-\\x7F]+'))
    SELECT d.doc_id AS id, coalesce(string_agg(t, ' ' ORDER BY pos), '') AS document FROM documents d LEFT JOIN x ON x.id = d.doc_id GROUP BY 1
""")
def preprocess_for_embedding(spark, folder):
    docs = with_row_index(T.load(spark, folder, "documents", spread=True), "doc_id")
    return X.preprocess_light(docs, "text")


@query("WITH gaps AS (" + GAPS_SQL + "), " + _tokens_sql("gaps", "idx", "text") + _MERGED
       + _VOCABULARY.replace("FROM documents", "FROM gaps WHERE text IS NOT NULL") + """,
    kept AS (SELECT m.* FROM mtok m JOIN voc v ON v.token = m.token),
    done AS (SELECT id, string_agg(token, ' ' ORDER BY pos) AS document FROM kept GROUP BY 1 HAVING count(*) >= 5)
    SELECT gaps.idx, done.document FROM gaps LEFT JOIN done ON done.id = gaps.idx""")
def preprocessed_table(spark, folder):
    """The whole stage on the fitted table: empty and useless texts get NULL."""
    df, schema = T.documents_with_gaps(spark, folder)
    out = X.preprocess(df, schema, "text", _CONFIG)
    return out.select(F.col(INDEX).alias("idx"), F.col("`text (Preprocessed)`").alias("document"))


def _words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '({K.CHAR}{K.CHAR}+)', 1)"


@query("SELECT word, count(*) AS frequency FROM (SELECT unnest(" + _words("text") + ") AS word FROM (" + DOCUMENTS_SQL
       + ") WHERE lang = 'en' AND coalesce(good, FALSE)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def word_frequencies(spark, folder):
    df, schema = T.documents(spark, folder)
    flt = {"type": "and", "operands": [EQ("lang", "en"), {"type": "is_true", "target": "good"}]}
    return X.word_frequencies(df, schema, "text", flt)


# Class-based TF-IDF. ``terms`` has class, term, n.
def weights_sql(terms: str) -> str:
    return f"""terms AS ({terms}),
        cls AS (SELECT class, sum(n)::DOUBLE AS size FROM terms GROUP BY 1),
        av AS (SELECT floor(avg(size)) AS a FROM cls),
        idf AS (SELECT term, ln(1 + (any_value(a) - sum(n) + 0.5) / (sum(n) + 0.5)) AS idf FROM terms, av GROUP BY 1),
        wt AS (SELECT t.class, t.term, t.n, sqrt(t.n / c.size) * i.idf AS weight FROM terms t JOIN cls c ON c.class = t.class JOIN idf i ON i.term = t.term)"""


_TOP = """, rk AS (SELECT class, CAST(row_number() OVER (PARTITION BY class ORDER BY round(weight, 12) DESC, term) AS INTEGER) AS rank, term, weight FROM wt WHERE weight > 0)"""


@query("WITH " + weights_sql("SELECT source AS class, term, count(*) AS n FROM (SELECT source, unnest(" + _words("text") + ") AS term FROM documents) GROUP BY ALL")
       + " SELECT class, term, CAST(n AS BIGINT) AS n, " + r("weight") + " AS weight FROM wt")
def class_tfidf(spark, folder):
    return rounded(M.ctfidf(M.class_terms(T.load(spark, folder, "documents", spread=True), "source", "text")))


@query("WITH " + weights_sql("SELECT role AS class, term, count(*) AS n FROM (SELECT role, unnest(" + _words("text") + ") AS term FROM conversations) GROUP BY ALL")
       + _TOP + " SELECT class, rank, term, " + r("weight") + " AS weight FROM rk WHERE rank <= 20")
def class_words_by_role(spark, folder):
    terms = M.class_terms(T.load(spark, folder, "conversations", spread=True), "role", "text")
    return rounded(M.top_words(_stable(M.ctfidf(terms)), 20))


def _stable(weights):
    """Round weights before ranking, so that equal weights tie in both engines."""
    return weights.withColumn("weight", F.round("weight", 12))


_GROUPS = [
    {"name": "english", "filter": EQ("lang", "en")}, {"name": "romance", "filter": IN("lang", "fr", "es")},
    {"name": "good", "filter": {"type": "is_true", "target": "good"}},
]


@query("WITH d AS (" + DOCUMENTS_SQL + """),
    g AS (SELECT 'english' AS class, text FROM d WHERE lang = 'en' UNION ALL SELECT 'romance', text FROM d WHERE lang IN ('fr', 'es')
          UNION ALL SELECT 'good', text FROM d WHERE good),
    """ + weights_sql("SELECT class, term, count(*) AS n FROM (SELECT class, unnest(" + _words("text") + ") AS term FROM g) GROUP BY ALL")
       + """, rk AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY weight DESC, term) AS rank, term, weight FROM wt WHERE weight > 0)
    SELECT class AS "group", """ + r("sum(weight)") + " AS total, count(*) AS words, " + r("min(weight)") + " AS least FROM rk WHERE rank <= 50 GROUP BY 1")
def group_words(spark, folder):
    """Words of overlapping groups; a document in two groups counts in both."""
    df, schema = T.documents(spark, folder)
    words = M.compare_group_words(df, schema, _GROUPS, "text", 50)
    out = words.groupBy("group").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("words"), F.min("weight").alias("least"))
    return rounded(out)


_TOPIC_TERMS = "SELECT topic AS class, term, count(*) AS n FROM (SELECT topic, unnest(" + _words("preprocessed") + ") AS term FROM td WHERE topic IS NOT NULL AND preprocessed IS NOT NULL) GROUP BY ALL"


@query("WITH td AS (" + TOPIC_DOCUMENTS_SQL + "), " + weights_sql(_TOPIC_TERMS) + _TOP + """,
    lb AS (SELECT class, string_agg(term, ', ' ORDER BY rank) AS label FROM rk WHERE rank <= 3 GROUP BY 1),
    fr AS (SELECT topic, count(*) AS frequency FROM td WHERE preprocessed IS NOT NULL AND topic >= 0 GROUP BY 1)
    SELECT topic AS id, label, frequency FROM fr LEFT JOIN lb ON lb.class = fr.topic""")
def extracted_topics(spark, folder):
    df, _ = T.topic_documents(spark, folder)
    return M.extract_topics(df, "text (Topic)", "text (Preprocessed)").select("id", "label", "frequency")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE topic IS NULL) AS invalid, count(*) FILTER (WHERE topic = -1) AS outlier, count(*) FILTER (WHERE topic <> -1) AS valid FROM (" + TOPIC_DOCUMENTS_SQL + ")")
def topic_counts(spark, folder):
    return M.topic_counts(T.topic_documents(spark, folder)[0], "text (Topic)")


@query("WITH td AS (" + TOPIC_DOCUMENTS_SQL + "), " + weights_sql(_TOPIC_TERMS) + """,
    whole AS (SELECT class, term, weight / sum(abs(weight)) OVER (PARTITION BY class) AS w FROM wt),
    lt AS (SELECT term, count(*)::DOUBLE AS n FROM (SELECT unnest(""" + _words("preprocessed") + """) AS term FROM td WHERE preprocessed IS NOT NULL AND lang = 'en') GROUP BY 1),
    lw AS (SELECT lt.term, sqrt(n / (SELECT sum(n) FROM lt)) * idf AS w FROM lt JOIN idf ON idf.term = lt.term),
    local AS (SELECT term, w / sum(abs(w)) OVER () AS w FROM lw),
    here AS (SELECT DISTINCT topic AS class FROM td WHERE lang = 'en' AND preprocessed IS NOT NULL AND topic >= 0),
    al AS (SELECT class, term, sum(w) / 2 AS w FROM (SELECT * FROM whole WHERE class IN (FROM here) UNION ALL SELECT class, term, w FROM local, here) GROUP BY ALL),
    rk AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY w DESC, term) AS rank, w FROM al WHERE w > 0)
    SELECT class AS id, 'Theme ' || (class % 3) AS label, (SELECT count(*) FROM embeddings e WHERE e.label = class) AS frequency,
           """ + r("sum(w)") + " AS total, " + r("max(w)") + " AS heaviest FROM rk WHERE rank <= 20 GROUP BY class")
def topics_under_filter(spark, folder):
    df, schema = T.topic_documents(spark, folder)
    topics = M.filtered_topics(df, schema, "text (Topic)", "text (Preprocessed)", EQ("lang", "en"), T.topic_table(spark, folder), 20)
    total = F.aggregate("words", F.lit(0.0), lambda a, w: a + w["weight"])
    return rounded(topics.select("id", "label", "frequency", total.alias("total"), F.col("words")[0]["weight"].alias("heaviest")))


_MOVED = "CASE WHEN idx % 3 = 0 AND idx % 2 = 0 THEN 1 WHEN idx % 50 = 7 THEN 77 ELSE topic END"


@query("WITH td AS (SELECT idx, preprocessed, " + _MOVED + " AS topic FROM (" + TOPIC_DOCUMENTS_SQL + """)),
    live AS (SELECT DISTINCT topic FROM td WHERE topic >= 0 AND preprocessed IS NOT NULL)
    SELECT CASE WHEN topic IS NULL THEN NULL WHEN topic IN (FROM live) THEN topic ELSE -1 END AS topic, count(*) AS n FROM td GROUP BY 1""")
def refined_assignment(spark, folder):
    """Documents moved to an existing and to a new topic; counts per topic afterwards."""
    df, _ = T.topic_documents(spark, folder)
    moves = df.filter("`__index` % 6 = 0").select(F.col(INDEX).alias("document_id"), F.lit(1).alias("topic_id"))
    fresh = df.filter("`__index` % 50 = 7 AND `__index` % 6 <> 0").select(F.col(INDEX).alias("document_id"), F.lit(77).alias("topic_id"))
    out, _ = M.refine_topics(df, "text (Topic)", "text (Preprocessed)", moves.unionByName(fresh))
    return out.groupBy(F.col("`text (Topic)`").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT label AS id, CASE WHEN label = 2 THEN 'Renamed' ELSE 'Theme ' || (label % 3) END AS label,
           CASE WHEN label = 2 THEN 'a note' END AS description, count(*) AS frequency
    FROM embeddings WHERE label <> 9 GROUP BY ALL
""")
def edited_topics(spark, folder):
    df, _ = T.topic_documents(spark, folder)
    topics = T.topic_table(spark, folder)
    edits = topics.filter("id = 2").select("id", F.lit("Renamed").alias("label"), F.lit("a note").alias("description"), F.array(F.lit("tag")).alias("tags"))
    _, out = M.refine_topics(df, "text (Topic)", "text (Preprocessed)", edits=edits, topics=topics)
    return out.select("id", "label", "description", "frequency")


@query("SELECT idx AS id, text AS original, preprocessed, topic FROM (" + TOPIC_DOCUMENTS_SQL + ") WHERE preprocessed IS NOT NULL AND lang = 'de' ORDER BY idx LIMIT 15 OFFSET 30")
def documents_of_topics(spark, folder):
    df, schema = T.topic_documents(spark, folder)
    return M.documents_per_topic(df, schema, "text", EQ("lang", "de"), page=2)
