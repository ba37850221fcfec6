"""Topics: words that describe classes of documents, and edits to the assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..filters import Filter, both, filter_table
from ..functions import tokens as K
from ..schema import INDEX, TableSchema, quoted
from .groups import Patterns
from .table import paginate


def class_terms(documents: DataFrame, class_column: str, text: str) -> DataFrame:
    """``class``, ``term``, ``n``: word counts per class. The counting combines before the shuffle."""
    words = documents.filter(F.col(quoted(class_column)).isNotNull()).select(
        F.col(quoted(class_column)).alias("class"), F.explode(K.words(F.col(quoted(text)))).alias("term")
    )
    return words.groupBy("class", "term").agg(F.count(F.lit(1)).alias("n"))


def term_idf(counts: DataFrame) -> DataFrame:
    """``term``, ``idf`` = ln(1 + (A - f + 0.5) / (f + 0.5)); A is the mean class size in words, as an integer."""
    classes = counts.groupBy("class").agg(F.sum("n").alias("words"))
    mean = classes.agg(F.floor(F.avg("words")).cast("double").alias("a")).scalar()
    totals = counts.groupBy("term").agg(F.sum("n").alias("f")).withColumn("a", mean)
    return totals.select("term", F.log(1 + (F.col("a") - F.col("f") + 0.5) / (F.col("f") + 0.5)).alias("idf"))


def ctfidf(counts: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """``class``, ``term``, ``n``, ``weight``: class-based TF-IDF with square-rooted frequencies."""
    idf = term_idf(counts) if idf is None else idf
    sizes = counts.groupBy("class").agg(F.sum("n").alias("size"))
    weighted = counts.join(idf, "term").join(sizes, "class")
    return weighted.select(
        "class", "term", "n", (F.sqrt(F.col("n") / F.col("size")) * F.col("idf")).alias("weight")
    )


def top_words(weights: DataFrame, n: int = 50) -> DataFrame:
    """``class``, ``rank``, ``term``, ``weight``: the heaviest words of each class.

    A rank limit on a window is applied inside each task first, so only n rows
    per class and task are shuffled.
    """
    order = W.partitionBy("class").orderBy(F.col("weight").desc(), "term")
    ranked = weights.filter("weight > 0").select("class", F.row_number().over(order).alias("rank"), "term", "weight")
    return ranked.filter(F.col("rank") <= n)


def topic_words(weights: DataFrame, n: int = 50) -> DataFrame:
    """``id``, ``words`` (word, weight; heaviest first), ``label`` from the first three."""
    entry = F.struct("rank", F.col("term").alias("word"), "weight")
    grouped = top_words(weights, n).groupBy(F.col("class").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("w"))
    return grouped.select(
        "id",
        F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["weight"].alias("weight"))).alias("words"),
        F.array_join(F.transform(F.slice("w", 1, 3), lambda x: x["word"]), ", ").alias("label"),
    )


def extract_topics(documents: DataFrame, class_column: str, text: str, top_n: int = 50) -> DataFrame:
    """The topics table: ``id``, ``label``, ``frequency``, ``words``, by id.

    Outlier documents (-1) take part in the weighting as a class of their own but
    are no topic.
    """
    valid = documents.filter(F.col(quoted(text)).isNotNull())
    sizes = valid.groupBy(F.col(quoted(class_column)).alias("id")).agg(F.count(F.lit(1)).alias("frequency"))
    return topics_of_counts(class_terms(valid, class_column, text), sizes, top_n)


def topics_of_counts(counts: DataFrame, sizes: DataFrame, top_n: int = 50) -> DataFrame:
    """The topics table of word counts (``class``, ``term``, ``n``) and class sizes (``id``, ``frequency``)."""
    words = topic_words(ctfidf(counts), top_n)
    topics = sizes.filter("id >= 0").join(words, "id", "left")
    label = F.coalesce("label", F.concat(F.lit("Topic "), (F.col("id") + 1).cast("string")))
    return topics.select("id", label.alias("label"), "frequency", "words").orderBy("id")


def topic_counts(df: DataFrame, name: str) -> DataFrame:
    ref = F.col(quoted(name))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ref.isNull()).alias("invalid"),
        F.count_if(ref == -1).alias("outlier"), F.count_if(ref != -1).alias("valid"),
    )


def compare_group_words(df: DataFrame, schema: TableSchema, groups, text: str, top_n: int = 50) -> DataFrame:
    """Words that set groups apart: ``group``, ``rank``, ``term``, ``weight``.

    A document in two groups counts in both. The texts are read once: words are
    counted per membership pattern and only the counts are spread to the groups.
    """
    patterns = Patterns(groups, schema)
    marked = df.filter(F.col(quoted(text)).isNotNull()).select(
        patterns.expression().alias("pattern"), F.col(quoted(text)).alias("text")
    )
    counts = class_terms(marked.filter(patterns.size() > 0), "pattern", "text")
    spread = counts.withColumnRenamed("class", "pattern").select("*", patterns.each_group())
    spread = spread.filter(patterns.has(F.col("gid")))
    per_group = spread.groupBy(F.col("group").alias("class"), "term").agg(F.sum("n").alias("n"))
    return top_words(ctfidf(per_group), top_n).withColumnRenamed("class", "group")


def filtered_topics(
    df: DataFrame, schema: TableSchema, topic_column: str, text: str, flt: Filter | None, topics: DataFrame,
    top_n: int = 50,
) -> DataFrame:
    """Topics as seen through a filter: ``id``, ``label``, ``frequency``, ``words``.

    Each topic's weights are averaged with the weights of the filtered corpus,
    both scaled to sum to one. Topics without a document under the filter are
    left out; labels and frequencies stay those of the stored topics.
    """
    valid = df.filter(F.col(quoted(text)).isNotNull())
    counts = class_terms(valid, topic_column, text)
    idf = term_idf(counts)
    share = lambda frame: frame.join(
        frame.groupBy("class").agg(F.sum(F.abs("weight")).alias("norm")), "class"
    ).select("class", "term", F.try_divide("weight", "norm").alias("weight"))
    whole = share(ctfidf(counts, idf)).filter(F.col("class") >= 0)

    local_rows = filter_table(valid, schema, flt)
    local_counts = class_terms(local_rows.withColumn("__all", F.lit(0)), "__all", text)
    local = share(ctfidf(local_counts, idf)).select("term", F.col("weight").alias("local"))
    present = local_rows.groupBy(F.col(quoted(topic_column)).alias("class")).agg(F.count(F.lit(1)).alias("here"))
    present = present.filter("class >= 0").select("class")

    # A topic's best words are among its own terms and the top_n best local words:
    # a word outside the topic keeps half its local weight, and top_n words with at
    # least that much are already listed. So only top_n words go to every topic.
    own = whole.join(present, "class", "left_semi").join(local, "term", "left").select(
        "class", "term", ((F.col("weight") + F.coalesce("local", F.lit(0.0))) / 2).alias("weight")
    )
    best = local.filter("local > 0").orderBy(F.col("local").desc(), "term").limit(top_n)
    listed = best.agg(F.collect_list(F.struct("term", "local")).alias("l")).scalar()
    extra = present.withColumn("l", listed).select("class", F.inline("l"))
    extra = extra.join(own.select("class", "term"), ["class", "term"], "left_anti").select(
        "class", "term", (F.col("local") / 2).alias("weight")
    )
    tuned = own.unionByName(extra)
    words = topic_words(tuned, top_n).select("id", "words")
    return topics.select("id", "label", "frequency").join(words, "id").orderBy("id")


def refine_topics(
    df: DataFrame, topic_column: str, text: str, assignments: DataFrame | None = None, edits: DataFrame | None = None,
    topics: DataFrame | None = None, top_n: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """Apply reassignments (``document_id``, ``topic_id``) and edits (``id``, ``label``, ``description``, ``tags``).

    Returns the table and the topics. With reassignments the words are computed
    again and ids that no longer name a topic become -1; without, only the
    metadata of the given ``topics`` changes.
    """
    ref = F.col(quoted(topic_column))
    if assignments is not None:
        # If a document is listed twice, its largest topic id counts; one row per document either way.
        updates = assignments.groupBy(F.col("document_id").alias(INDEX)).agg(F.max("topic_id").alias("__new"))
        df = df.join(updates, INDEX, "left").withColumn(topic_column, F.coalesce("__new", ref).cast("int")).drop("__new")
        topics = extract_topics(df, topic_column, text, top_n)
        live = topics.select(F.col("id").alias("__id"))
        df = df.join(live, ref == F.col("__id"), "left").withColumn(
            topic_column, F.when(ref.isNotNull(), F.coalesce("__id", F.lit(-1)))
        ).drop("__id")
    for name, kind in (("description", "string"), ("tags", "array<string>")):
        if name not in topics.columns:
            topics = topics.withColumn(name, F.lit(None).cast(kind))
    if edits is not None:
        given = edits.select(
            "id", F.lit(True).alias("__edited"), F.col("label").alias("__label"),
            F.col("description").alias("__description"), F.col("tags").alias("__tags"),
        )
        topics = topics.join(given, "id", "left")
        for name in ("label", "description", "tags"):
            topics = topics.withColumn(name, F.when(F.col("__edited"), F.col(f"__{name}")).otherwise(F.col(name)))
        topics = topics.drop("__edited", "__label", "__description", "__tags")
    return df, topics


def documents_per_topic(
    df: DataFrame, schema: TableSchema, name: str, flt: Filter | None = None, sort: tuple[str, bool] | None = None,
    page: int = 0, limit: int | None = 15,
) -> DataFrame:
    """A page of ``id``, ``original``, ``preprocessed``, ``topic`` over the documents with usable text."""
    column = schema.get(name, (S.TEXTUAL,))
    preprocessed, topic = (d.name for d in column.derived())
    usable = {"type": "not_empty", "target": preprocessed}
    rows = paginate(df, schema, both(usable, flt), sort, page, limit)
    return rows.select(
        F.col(INDEX).alias("id"), F.col(quoted(name)).alias("original"),
        F.col(quoted(preprocessed)).alias("preprocessed"), F.col(quoted(topic)).alias("topic"),
    )
