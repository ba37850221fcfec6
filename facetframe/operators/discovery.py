"""From raw text to a topic column: the stages in order, each a table keyed by row id."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import ValidationError
from ..schema import INDEX, TableSchema, quoted
from ..session import cut_lineage, stage_scope
from .clustering import density_clusters
from .hierarchy import density_hierarchy
from .neighbours import layout
from .text import TextConfig, preprocess_heavy, preprocess_light
from .topics import extract_topics
from .vectors import embed_lsa, embed_word2vec, merge_topics, reduce_dimensions, reduce_outliers

CLUSTERS = {"grid": density_clusters, "hierarchy": density_hierarchy}
MAPS = {"components": reduce_dimensions, "neighbours": lambda vectors, size: layout(vectors, size)[1]}


@dataclass(frozen=True)
class TopicConfig:
    """``embedding``: ``lsa``, ``word2vec`` or ``column`` (vectors given by the caller).

    ``clusters``: ``grid`` (one density for all topics) or ``hierarchy`` (topics of varying density).
    ``positions``: ``components`` (principal components) or ``neighbours`` (neighbours stay together).
    """

    embedding: str = "lsa"
    min_topic_size: int = 15
    topic_confidence_threshold: int | None = None
    max_topic_size: float | None = None
    max_topics: int | None = None
    no_outliers: bool = False
    top_n_words: int = 50
    vector_size: int = 100
    clustering_dimensions: int = 5
    text: TextConfig = field(default_factory=TextConfig)
    clusters: str = "grid"
    positions: str = "components"


@dataclass
class Discovery:
    table: DataFrame  # the input with X (Preprocessed) and X (Topic)
    topics: DataFrame
    vectors: DataFrame
    positions: DataFrame  # two-dimensional vectors


def discover_topics(
    df: DataFrame, schema: TableSchema, name: str, config: TopicConfig = TopicConfig(), vectors: DataFrame | None = None,
    lemmas: DataFrame | None = None,
) -> Discovery:
    """Preprocess, embed, reduce, cluster, describe."""
    if config.clusters not in CLUSTERS:
        raise ValidationError(f'"{config.clusters}" is not a way of clustering')
    if config.positions not in MAPS:
        raise ValidationError(f'"{config.positions}" is not a way of placing documents')
    column = schema.get(name, (S.TEXTUAL,))
    preprocessed, topic = (d.name for d in column.derived())
    # Each stage is used more than once below, so it is stored rather than planned again: the cleaned texts
    # without the rest of their rows, and nothing that only led to them.
    if preprocessed in df.columns:
        table = cut_lineage(df)
        cleaned = None
    else:
        with stage_scope(df.sparkSession):
            cleaned = cut_lineage(preprocess_heavy(df, name, config.text, lemmas), outlive=True)
        table = df.join(cleaned.select(F.col("id").alias(INDEX), F.col("document").alias(preprocessed)), INDEX, "left")
    usable = table.filter(F.col(quoted(preprocessed)).isNotNull())
    words = usable.select(F.col(INDEX).alias("id"), F.col(quoted(preprocessed)).alias("document"))
    if cleaned is not None:
        # Rows that share an id meet each other's texts in the join.
        several = df.groupBy(INDEX).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        words = cleaned.filter(F.col("id").isNotNull()) if several.isEmpty() else cut_lineage(words)
    if words.isEmpty():
        raise ValidationError(f'no document of "{name}" survives preprocessing')
    if config.embedding == "column":
        if vectors is None:
            raise ValidationError("the embedding method 'column' needs a vector table")
        vectors = vectors.join(words.select("id"), "id", "left_semi")
    elif config.embedding == "lsa":
        vectors = embed_lsa(words, config.vector_size)
    elif config.embedding == "word2vec":
        vectors = embed_word2vec(cut_lineage(preprocess_light(usable, name, config.text)), config.vector_size)
    else:
        raise ValidationError(f'"{config.embedding}" is not an embedding method')
    vectors = cut_lineage(vectors)
    reduced = cut_lineage(reduce_dimensions(vectors, config.clustering_dimensions))
    assigned = CLUSTERS[config.clusters](
        reduced, config.min_topic_size, config.topic_confidence_threshold, config.max_topic_size
    )
    if config.max_topics is not None:
        assigned = merge_topics(assigned.join(vectors, "id"), config.max_topics)
    if config.no_outliers:
        assigned = reduce_outliers(assigned.join(vectors, "id"))
    assigned = cut_lineage(assigned)
    out = table.drop(topic).join(
        assigned.select(F.col("id").alias(INDEX), F.col("topic").cast("int").alias(topic)), INDEX, "left"
    )
    topics = extract_topics(out, topic, preprocessed, config.top_n_words)
    return Discovery(out, topics, vectors, MAPS[config.positions](vectors, 2))
