"""Vectors, clusters, topic quality, and the whole discovery run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering, discovery, evaluation, hierarchy, neighbours, vectors
from ..operators import topics as M
from ..operators.text import TextConfig
from ..session import cut_lineage
from . import tables as T
from .registry import query, r, rounded
from .tables import TOPIC_DOCUMENTS_SQL
from .text_queries import _TOP, _TOPIC_TERMS, _stable, _words, weights_sql

_VECTORS = "SELECT vec_id AS id, CASE WHEN label = 9 THEN -1 ELSE label END AS topic, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"
_CENTROIDS = """
    v AS (""" + _VECTORS + """),
    x AS (SELECT id, topic, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM v),
    m AS (SELECT topic, pos, avg(x) AS x FROM x WHERE topic >= 0 GROUP BY ALL),
    c AS (SELECT topic, list(x ORDER BY pos) AS mean FROM m GROUP BY 1)"""


@query("SELECT id, " + r("list_aggregate(vec, 'sum')", 5) + " AS total, len(vec) AS size FROM (" + _VECTORS + ")")
def given_vectors(spark, folder):
    given = vectors.embed_column(T.load(spark, folder, "embeddings"), "vec_id", "embedding")
    return rounded(given.select("id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("vec").cast("long").alias("size")), 5)


@query("WITH " + _CENTROIDS + " SELECT topic, pos - 1 AS pos, " + r("x") + " AS x FROM m")
def topic_centroids(spark, folder):
    return rounded(vectors.centroids(T.topic_vectors(spark, folder)).withColumn("pos", F.col("pos").cast("long")))


@query("WITH " + _CENTROIDS + """,
    b AS (SELECT v.id, arg_max(c.topic, list_cosine_similarity(v.vec, c.mean)) AS best FROM v, c WHERE v.topic = -1 GROUP BY 1)
    SELECT v.id, coalesce(b.best, v.topic) AS topic FROM v LEFT JOIN b ON b.id = v.id""")
def outlier_reassignment(spark, folder):
    return vectors.reduce_outliers(T.topic_vectors(spark, folder))


@query("""
    SELECT t.id, 'Theme ' || (t.id % 3) AS label, t.frequency, """ + r("t.x", 5) + " AS x, " + r("t.y", 5) + """ AS y
    FROM (SELECT topic AS id, count(*) AS frequency, avg(vec[1]) AS x, avg(vec[2]) AS y FROM (""" + _VECTORS + """) WHERE topic >= 0 GROUP BY 1) t
    UNION ALL SELECT 50, 'empty', 0, 0.0::DOUBLE, 0.0::DOUBLE
""")
def topic_positions(spark, folder):
    """The mean position per topic; a topic without documents is placed at the origin."""
    empty = T.topic_table(spark, folder).limit(1).select(
        F.lit(50).alias("id"), F.lit("empty").alias("label"), F.lit(0).cast("long").alias("frequency"))
    return rounded(vectors.topic_positions(T.topic_vectors(spark, folder), T.topic_table(spark, folder).unionByName(empty)), 5)


@query("SELECT id, topic FROM (" + _VECTORS + ") ORDER BY md5(id || ':5000'), id LIMIT 100")
def document_sample(spark, folder):
    return vectors.document_positions(T.topic_vectors(spark, folder).select("id", "topic"), 100)


@query()
def merged_topics(spark, folder):
    merged = vectors.merge_topics(T.topic_vectors(spark, folder), 4)
    return merged.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query()
def reduced_vectors(spark, folder):
    """Signs of components are arbitrary: the sum of squares per document is not."""
    reduced = vectors.reduce_dimensions(T.topic_vectors(spark, folder), 5)
    return rounded(reduced.select("id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("energy")), 4)


@query()
def near_neighbours(spark, folder):
    """The nearest others of every vector; tested against all pairs, of which nine in ten must be found."""
    given = vectors.embed_column(T.load(spark, folder, "embeddings"), "vec_id", "embedding")
    return rounded(neighbours.near_neighbours(given, 10))


@query()
def neighbour_layout(spark, folder):
    """Every vector's place on a map that keeps neighbours together."""
    _, made = neighbours.layout(vectors.embed_column(T.load(spark, folder, "embeddings"), "vec_id", "embedding"), 2, 10)
    return rounded(made.select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")), 4)


@query()
def density_clusters(spark, folder):
    reduced = cut_lineage(vectors.reduce_dimensions(T.topic_vectors(spark, folder), 3))
    found = clustering.density_clusters(reduced, min_topic_size=10, min_samples=5)
    return found.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


# Two coordinates, three documents a dense cell, four levels a doubling, clusters of ten.
_LEVELS = """RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE embedding IS NOT NULL),
    u AS (SELECT sqrt(2 * 3 * (2 * pi()) / count(*)) AS unit, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM (SELECT DISTINCT x, y FROM p)),
    pl AS (SELECT id, [CAST(floor(x / greatest(sx * unit, 1e-12)) AS BIGINT), CAST(floor(y / greatest(sy * unit, 1e-12)) AS BIGINT)] AS cell FROM p, u),
    al AS (SELECT cell, count(*) AS n FROM pl GROUP BY 1),
    c AS (SELECT cell, n, CAST(floor(log2(n / 3.0) * 4 + 1e-9) AS INTEGER) AS top FROM al WHERE n >= 3),
    nd AS (SELECT cell, unnest(range(0, top + 1)) AS level FROM c),
    re AS (SELECT level, cell, cell AS label FROM nd
           UNION SELECT re.level, nd.cell, re.label FROM re JOIN nd ON nd.level = re.level AND abs(nd.cell[1] - re.cell[1]) + abs(nd.cell[2] - re.cell[2]) = 1),
    lb AS (SELECT level, cell, min(label) AS label FROM re GROUP BY ALL),
    cm AS (SELECT level, label, CAST(sum(n) AS BIGINT) AS mass, count(*) AS cells FROM lb JOIN c USING (cell) GROUP BY ALL),
    tr AS (SELECT cm.*, up.label AS parent FROM cm LEFT JOIN lb up ON up.level = cm.level - 1 AND up.cell = cm.label)"""


def _flat(spark, folder):
    embeddings = T.load(spark, folder, "embeddings").filter("embedding IS NOT NULL")
    return embeddings.select(F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("vec"))


@query("WITH " + _LEVELS + """
    SELECT level, label[1] AS x, label[2] AS y, parent[1] AS parent_x, parent[2] AS parent_y, mass, cells FROM tr""")
def density_levels(spark, folder):
    _, _, components = hierarchy.density_levels(_flat(spark, folder), 3)
    return components.select(
        "level", F.col("label")[0].alias("x"), F.col("label")[1].alias("y"), F.col("parent")[0].alias("parent_x"),
        F.col("parent")[1].alias("parent_y"), "mass", "cells",
    )


@query("WITH " + _LEVELS + """,
    t AS (SELECT level, label, parent, mass * (sqrt(3 * 2 ** (level / 4.0)) - sqrt(3 * 2 ** ((level - 1) / 4.0))) AS gain FROM tr WHERE mass >= 10),
    parts AS (SELECT level - 1 AS level, parent AS label, count(*) AS parts FROM t WHERE level > 0 GROUP BY ALL),
    b AS (SELECT level, label, parent, gain AS own, CAST(0 AS DOUBLE) AS below FROM t WHERE level = (SELECT max(level) FROM t)
          UNION ALL
          SELECT t.level, t.label, t.parent, t.gain + CASE WHEN count(b.level) = 1 THEN max(b.own) ELSE 0 END,
                 CASE WHEN count(b.level) = 1 THEN max(b.below) ELSE coalesce(sum(greatest(b.own, b.below)), 0) END
          FROM t JOIN (SELECT min(level) - 1 AS l FROM b) q ON t.level = q.l LEFT JOIN b ON b.parent = t.label
          GROUP BY t.level, t.label, t.parent, t.gain),
    w AS (SELECT level, label, own >= below AS kept FROM b WHERE level = 0
          UNION ALL
          SELECT b.level, b.label, parts.parts > 1 AND b.own >= b.below FROM w JOIN b ON b.level = w.level + 1 AND b.parent = w.label
          JOIN parts ON parts.level = w.level AND parts.label = w.label WHERE NOT w.kept),
    core AS (SELECT lb.cell, n, level, label FROM lb JOIN (SELECT level, label FROM w WHERE kept) k USING (level, label) JOIN c ON c.cell = lb.cell),
    rim AS (SELECT a.cell, k.level, k.label FROM al a JOIN core k ON abs(a.cell[1] - k.cell[1]) + abs(a.cell[2] - k.cell[2]) = 1 WHERE a.n < 3
            QUALIFY row_number() OVER (PARTITION BY a.cell ORDER BY k.n DESC, k.level DESC, k.label DESC) = 1),
    mp AS (SELECT cell, level, label FROM core UNION ALL FROM rim)
    SELECT id, CASE WHEN level IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY level, label) END AS size,
           CASE WHEN level IS NULL THEN -1 ELSE min(id) OVER (PARTITION BY level, label) END AS first_id FROM pl LEFT JOIN mp ON mp.cell = pl.cell""")
def density_hierarchy(spark, folder):
    """Every document with the size and the smallest id of its cluster; 0 and -1 for outliers."""
    found = hierarchy.density_hierarchy(_flat(spark, folder), 10, 3)
    sizes = found.filter("topic >= 0").groupBy("topic").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first_id"))
    joined = found.join(sizes, "topic", "left")
    return joined.select("id", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("first_id", F.lit(-1)).alias("first_id"))


_SILHOUETTE = "WITH v AS (" + _VECTORS + """),
    p AS (SELECT * FROM v WHERE topic >= 0),
    n AS (SELECT topic, count(*)::DOUBLE AS n FROM p GROUP BY 1),
    d AS (SELECT a.id, a.topic AS own, b.topic, sum(list_distance(a.vec, b.vec) ** 2) AS s FROM p a, p b GROUP BY ALL),
    m AS (SELECT id, own, n.n, d.topic, CASE WHEN own = d.topic THEN s / greatest(n.n - 1, 1) ELSE s / n.n END AS s FROM d JOIN n ON n.topic = d.topic),
    q AS (SELECT id, own, max(s) FILTER (WHERE topic = own) AS a, min(s) FILTER (WHERE topic <> own) AS b, max(n) FILTER (WHERE topic = own) AS n FROM m GROUP BY ALL),
    s AS (SELECT own AS topic, CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM q)
    """


@query(_SILHOUETTE + "SELECT " + r("avg(s)") + " AS silhouette FROM s")
def silhouette_of_topics(spark, folder):
    return rounded(vectors.silhouette(T.topic_vectors(spark, folder)))


@query(_SILHOUETTE + "SELECT topic, " + r("avg(s)") + " AS silhouette, count(*) AS support FROM s GROUP BY 1")
def silhouette_by_topic(spark, folder):
    return rounded(vectors.silhouette_per_topic(T.topic_vectors(spark, folder)))


# The ten leading words per given topic, with weights rounded so that ties fall alike.
_LEADING = "td AS (" + TOPIC_DOCUMENTS_SQL + "), " + weights_sql(_TOPIC_TERMS) + _TOP + \
    ", lead AS (SELECT class AS topic, rank, term AS word FROM rk WHERE rank <= 10 AND class >= 0)"


def _topics(df):
    terms = M.class_terms(df.filter(F.col("`text (Preprocessed)`").isNotNull()), "text (Topic)", "text (Preprocessed)")
    words = M.topic_words(_stable(M.ctfidf(terms)), 10)
    return words.filter("id >= 0")


@query("WITH " + _LEADING + " SELECT topic, CAST(rank - 1 AS INTEGER) AS place, word FROM lead")
def leading_topic_words(spark, folder):
    return evaluation.leading_words(_topics(T.topic_documents(spark, folder)[0]))


@query("WITH " + _LEADING + " SELECT " + r("count(DISTINCT word)::DOUBLE / count(*)") + " AS diversity FROM lead")
def topic_diversity(spark, folder):
    return rounded(evaluation.topic_diversity(_topics(T.topic_documents(spark, folder)[0])))


_COHERENCE = _LEADING + """,
    doc AS (SELECT idx, """ + _words("preprocessed") + """ AS ws FROM td WHERE preprocessed IS NOT NULL AND topic IS NOT NULL),
    total AS (SELECT sum(greatest(len(ws) - 109, 1))::DOUBLE AS t FROM doc),
    tok AS (SELECT idx, len(ws) AS len, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM doc),
    hit AS (SELECT * FROM tok WHERE word IN (SELECT word FROM lead)),
    win AS (SELECT DISTINCT idx, word, unnest(range(greatest(pos - 109, 0), least(pos, greatest(len - 110, 0)) + 1)) AS s FROM hit),
    one AS (SELECT word, count(*)::DOUBLE AS n FROM win GROUP BY 1),
    prs AS (SELECT DISTINCT a.word AS a, b.word AS b FROM lead a JOIN lead b USING (topic) WHERE a.word <> b.word),
    two AS (SELECT x.word AS a, y.word AS b, count(*)::DOUBLE AS n FROM win x JOIN win y USING (idx, s)
            JOIN prs ON prs.a = x.word AND prs.b = y.word GROUP BY ALL UNION ALL SELECT word, word, n FROM one),
    cell AS (SELECT topic, a.word AS a, b.word AS b,
                    ln((coalesce(two.n, 0) / t + 1e-12) / ((oa.n / t) * (ob.n / t))) / -ln(coalesce(two.n, 0) / t + 1e-12) AS x
             FROM lead a JOIN lead b USING (topic) JOIN one oa ON oa.word = a.word JOIN one ob ON ob.word = b.word
             LEFT JOIN two ON two.a = a.word AND two.b = b.word, total),
    whole AS (SELECT topic, b, sum(x) AS s FROM cell GROUP BY ALL),
    sim AS (SELECT topic, a, sum(x * s) / (sqrt(sum(x * x)) * sqrt(sum(s * s))) AS c FROM cell JOIN whole USING (topic, b) GROUP BY ALL)"""


@query("WITH " + _COHERENCE + """
    SELECT topic, """ + r("avg(c)", 5) + " AS coherence, " + r("stddev_pop(c)", 5) + " AS std_dev, count(*) AS support FROM sim GROUP BY 1")
def topic_coherence(spark, folder):
    """Sliding windows over the whole texts; the SQL expands every window."""
    df, _ = T.topic_documents(spark, folder)
    docs = df.filter(F.col("`text (Topic)`").isNotNull()).select(F.col("`text (Preprocessed)`").alias("document"))
    return rounded(evaluation.coherence_cv(docs, _topics(df)), 5)


@query("WITH " + _COHERENCE + """,
    per AS (SELECT topic, avg(c) AS c FROM sim GROUP BY 1),
    used AS (SELECT topic FROM td WHERE topic IS NOT NULL AND preprocessed IS NOT NULL)
    SELECT """ + r("(SELECT avg(c) FROM per)", 5) + " AS coherence_v, " + r("(SELECT count(DISTINCT word)::DOUBLE / count(*) FROM lead)", 5)
       + """ AS topic_diversity, (SELECT count(DISTINCT topic) FROM used WHERE topic >= 0) AS topics,
           count(*) FILTER (WHERE topic = -1) AS outlier_count, count(*) FILTER (WHERE topic <> -1) AS valid_count, count(*) AS total_count FROM used""")
def topic_evaluation(spark, folder):
    df, _ = T.topic_documents(spark, folder)
    usable = df.filter(F.col("`text (Topic)`").isNotNull() & F.col("`text (Preprocessed)`").isNotNull())
    docs = usable.select(F.col("`text (Preprocessed)`").alias("document"), F.col("`text (Topic)`").alias("topic"))
    return rounded(evaluation.evaluate_topics(docs, _topics(df), docs), 5)


@query()
def lsa_vectors(spark, folder):
    docs = T.load(spark, folder, "documents", spread=True).select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    lsa = vectors.embed_lsa(docs, 10, min_df=5.0, max_df=0.5)
    return rounded(lsa.select("id", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")), 4)


@query("""
    WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_]+')) AS term FROM documents),
    n AS (SELECT count(DISTINCT id) AS n FROM t),
    tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
    idf AS (SELECT term, ln((1.0 + any_value(n)) / (1.0 + count(*))) AS idf FROM tf, n GROUP BY 1 HAVING count(*) >= 0.2 * any_value(n) AND count(*) < any_value(n)),
    w AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
    u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
    dot AS (SELECT a.id, sum(a.w * b.w) AS x FROM u a JOIN u b ON b.id = a.id + 1 AND b.term = a.term GROUP BY 1),
    ids AS (SELECT DISTINCT id FROM t)
    SELECT a.id, """ + r("coalesce(x, 0)", 5) + " AS cosine FROM ids a JOIN ids b ON b.id = a.id + 1 LEFT JOIN dot ON dot.id = a.id")
def lsa_cosines(spark, folder):
    """With as many dimensions as terms, products of vectors are the cosines of the weighted documents."""
    docs = T.load(spark, folder, "documents", spread=True).select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    made = vectors.embed_lsa(docs, 200, min_df=0.2)
    after = made.select((F.col("id") - 1).alias("id"), F.col("vec").alias("next"))
    dot = F.aggregate(F.zip_with("vec", "next", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return rounded(made.join(after, "id").select("id", dot.alias("cosine")), 5)


@query()
def word2vec_vectors(spark, folder):
    docs = T.load(spark, folder, "documents", spread=True).select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    made = vectors.embed_word2vec(docs, 20, partitions=4)
    return rounded(made.select("id", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")), 4)


@query()
def setting_sweep(spark, folder):
    df, _ = T.topic_documents(spark, folder)
    docs = df.filter(F.col("`text (Preprocessed)`").isNotNull()).select(F.col("__index").alias("id"), F.col("`text (Preprocessed)`").alias("document"))
    given = T.topic_vectors(spark, folder).select("id", "vec")
    reduced = cut_lineage(vectors.reduce_dimensions(given, 3))
    out = evaluation.sweep(cut_lineage(docs), given, reduced, (10, 12), (4, 5), (2, 6), trials=3)
    return rounded(out, 4)


@query()
def discovered_topics(spark, folder):
    """Raw texts to a topic per document, by way of every stage."""
    df, schema = T.documents(spark, folder)
    config = discovery.TopicConfig(vector_size=10, max_topics=8, no_outliers=True, text=TextConfig(default_stopwords=None))
    found = discovery.discover_topics(df, schema, "text", config)
    topic = F.col("`text (Topic)`")
    return found.table.groupBy("lang", topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"))
