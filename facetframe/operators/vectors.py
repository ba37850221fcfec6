"""Document vectors: making them, shrinking them, and placing topics with them.

Vector tables have the columns ``id`` and ``vec`` (ARRAY<DOUBLE>), joined by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import tokens as K
from ..schema import INDEX, quoted
from ..session import cut_lineage, keep_in_order, stage_scope
from ..sources import with_row_index
from . import spectral
from .spectral import pieces
from .text import lookup

# Topic means are sent to tasks in blocks of at most this many numbers.
MAX_SHARED_NUMBERS = 4_000_000


def embed_column(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors that already exist in a table."""
    return df.select(
        F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(vector)).cast("array<double>").alias("vec")
    )


def weighted_terms(documents: DataFrame, min_df: float = 1.0, max_df: float = 1.0, max_terms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """TF-IDF with rows of unit length as entries (``row``, ``col``, ``salt``, ``w``), and their columns (``col``, ``copies``).

    The weights are tf * ln((1 + n) / (1 + df)), where n counts documents with a word.
    ``min_df`` below 1 and ``max_df`` are shares of them. ``max_terms`` keeps the terms
    that occur most often, of equal ones the first by name. A term in every document
    weighs nothing and is no column.
    """
    bag = documents.select(F.col("id").alias("row"), K.words(F.col("document")).alias("terms")).filter(F.size("terms") > 0)
    counted = cut_lineage(bag.select("row", F.explode("terms").alias("col")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("tf")))
    n = bag.count()
    counts = counted.groupBy("col").agg(F.count(F.lit(1)).alias("rows"), F.sum("tf").alias("uses"))
    counts = cut_lineage(_limited(counts, n, min_df, max_df, max_terms))
    columns = cut_lineage(spectral.spread_columns(counts))
    # The join that fetches a term's weight is salted like the tokens of the text operators.
    known = counts.join(columns, "col").select("col", "copies", F.log(F.lit(1.0 + n) / (F.col("rows") + 1.0)).alias("idf"))
    raw = lookup(counted.select(F.col("row").alias("id"), F.lit(0).alias("pos"), "col", "tf"), known, ["col"], "inner")
    raw = cut_lineage(raw.select(F.col("id").alias("row"), "col", "copies", (F.col("tf") * F.col("idf")).alias("w")))
    lengths = raw.groupBy("row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    unit = raw.join(lengths, "row").withColumn("w", F.col("w") / F.col("length"))
    return cut_lineage(spectral.salted(unit)), columns


def _limited(counts: DataFrame, n: int, min_df: float, max_df: float, max_terms: int | None) -> DataFrame:
    """The terms (``col``, ``rows``, ``uses``) within the limits of ``weighted_terms``."""
    least, most = (min_df if min_df >= 1 else min_df * n), max_df * n
    counts = counts.filter((F.col("rows") >= least) & (F.col("rows") <= most))
    if max_terms is not None:
        counts = counts.orderBy(F.col("uses").desc(), "col").limit(max_terms)
    return counts.filter(F.col("rows") < n)


def packed_terms(
    documents: DataFrame, size: int, min_df: float = 1.0, max_df: float = 1.0, max_terms: int | None = None
) -> spectral.Packed | None:
    """The matrix of ``weighted_terms`` as packed rows, without a shuffle of its entries; None if it has too many columns for that.

    The rows have ``id`` and ``copies``, the number of documents with this id and words; texts
    that share an id are one row, as there. Texts are read twice: once to count in how
    many a term occurs, once to look terms up by their hashes. Only ids, terms and texts that share an id are
    shuffled. A missing id has no entries, and a row may be without any.
    """
    spark = documents.sparkSession
    repeated = cut_lineage(documents.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__id")))
    bag = documents.select("id", K.words(F.col("document")).alias("terms")).filter(F.size("terms") > 0)
    alone, several = bag, None
    if not repeated.isEmpty():
        same = F.col("id").eqNullSafe(F.col("__id"))
        alone = bag.join(repeated, same, "left_anti")
        several = cut_lineage(
            bag.join(repeated, same, "left_semi").withColumn("doc", F.monotonically_increasing_id())
        )

    # The entry without a term counts the documents.
    seen = alone.select(F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit(None).cast("string")))).alias("col"))
    n = 0
    if several is not None:
        n = several.count()
        seen = seen.unionByName(several.select("id", F.explode("terms").alias("col")).distinct().select("col"))
    counts = seen.groupBy("col").agg(F.count(F.lit(1)).alias("rows"))
    if max_terms is not None:
        uses = bag.select(F.explode("terms").alias("col")).groupBy("col").agg(F.count(F.lit(1)).alias("uses"))
        counts = counts.join(uses, "col", "left")
    counts = cut_lineage(counts)
    n += next((r["rows"] for r in counts.filter("col IS NULL").collect()), 0)
    terms = counts.filter("col IS NOT NULL")
    known = cut_lineage(_limited(terms, n, min_df, max_df, max_terms).select("col", "rows"))
    many = known.count()
    if many > spectral.SHARED:
        return None
    seed = 0
    while not terms.groupBy(F.xxhash64("col", F.lit(seed)).alias("hash")).count().filter("count > 1").isEmpty():
        seed += 1  # no two terms may share a hash
    found = known.select(F.xxhash64("col", F.lit(seed)).alias("hash"), "rows").toArrow()
    hashes = found.column(0).to_numpy()
    order = np.argsort(hashes)
    weights = np.log((1.0 + n) / (found.column(1).to_numpy()[order] + 1.0))
    shared = spark.sparkContext.broadcast((hashes[order], weights))
    width = min(size + spectral.EXTRA, many)

    def place(batches):
        hashes = shared.value[0]
        for batch in batches:
            at = np.searchsorted(hashes, batch.column("hash").to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("vec")], names=["col", "vec"])

    def pack(batches):
        hashes, weights = shared.value
        for piece, given, times, sizes in pieces(batches, "hashes", "times"):
            row = np.repeat(np.arange(len(piece)), sizes)
            at = np.minimum(np.searchsorted(hashes, given), max(len(hashes) - 1, 0))
            hit = np.flatnonzero(hashes[at] == given) if len(hashes) else np.zeros(0, int)
            entry, where, tf = np.unique(row[hit] * len(hashes) + at[hit], return_inverse=True, return_counts=True)
            if len(times):
                tf = np.bincount(where, times[hit], len(entry)).astype(np.int64)
            row, at = np.divmod(entry, max(len(hashes), 1))
            length = np.sqrt(np.bincount(row, (tf * weights[at]) ** 2, len(piece)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(piece)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("copies"), *lists, pa.array(length)], names=names)

    usable = lambda x: F.when(F.col("id").isNotNull(), x).otherwise(F.array().cast("array<long>"))
    hashed = F.transform("terms", lambda t: F.xxhash64(t, F.lit(seed)))
    rows = alone.select("id", F.lit(1).cast("long").alias("copies"), usable(hashed).alias("hashes"), F.array().cast("array<long>").alias("times"))
    names = ["id", "copies", "at", "w", "length"]
    schema = rows.select("id", "copies", F.col("hashes").cast("array<int>").alias("at"), F.col("times").cast("array<int>").alias("w"), F.lit(1.0).alias("length")).schema
    rows = rows.mapInArrow(pack, schema)
    if several is not None:
        words = several.select("id", "doc", F.explode(hashed).alias("hash")).groupBy("id", "hash").agg(F.count(F.lit(1)).alias("times"))
        lists = words.groupBy("id").agg(F.collect_list(F.struct("hash", "times")).alias("e"))
        number = several.groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("copies"))
        both = lists.join(number, F.col("id").eqNullSafe(F.col("__id")))
        grouped = both.select("id", "copies", usable(F.col("e")["hash"]).alias("hashes"), usable(F.col("e")["times"]).alias("times"))
        rows = rows.unionByName(grouped.mapInArrow(pack, schema))
    start = known.select(F.xxhash64("col", F.lit(seed)).alias("hash"), spectral.first_block(width).alias("vec"))
    packed = spectral.Packed(cut_lineage(rows), weights, cut_lineage(start.mapInArrow(place, "col int, vec array<double>")))
    shared.destroy()
    return packed


def embed_lsa(
    documents: DataFrame, size: int = 100, min_df: float = 1.0, max_df: float = 1.0, max_terms: int | None = None, tolerance: float = 1e-4
) -> DataFrame:
    """TF-IDF and a truncated singular value decomposition: the rows of U times the singular values.

    ``documents`` has ``id`` and ``document``; ids are unique. See ``weighted_terms`` for
    the weights and limits. Vectors of terms stay in tables. A document whose terms
    all fell away has a zero vector, one without words has none. If the terms span fewer
    than ``size`` dimensions, the vectors are that much shorter.
    """
    spark = documents.sparkSession
    with stage_scope(spark):
        packed = packed_terms(documents, size, min_df, max_df, max_terms)
        if packed is not None:
            if not len(packed.weights):
                raise ValidationError("too few terms for a decomposition")
            values, right = spectral.packed_vectors(packed, size, tolerance)
            made = spectral.times_packed(packed, right, len(values))
            return cut_lineage(made.select("id", F.explode(F.array_repeat("vec", F.col("copies").cast("int"))).alias("vec")), outlive=True)
        entries, columns = weighted_terms(documents, min_df, max_df, max_terms)
        values, right = spectral.leading_vectors(entries, columns, size, tolerance)
        made = spectral.times(entries, right, len(values)).withColumnRenamed("row", "id")
        bag = documents.select("id", K.words(F.col("document")).alias("terms")).filter(F.size("terms") > 0).select("id")
        zero = F.array(*[F.lit(0.0)] * len(values))
        return cut_lineage(bag.join(made, "id", "left").select("id", F.coalesce("vec", zero).alias("vec")), outlive=True)


def embed_word2vec(
    documents: DataFrame, size: int = 100, min_count: int = 5, seed: int = 42, partitions: int | None = None, rounds: int = 1
) -> DataFrame:
    """Each document as the mean of its word vectors.

    Training runs in ``partitions`` tasks (default: as many as the session runs at
    once) whose vectors are averaged after each of ``rounds`` rounds, so the numbers
    depend on both.
    """
    bag = documents.select("id", K.words(F.col("document")).alias("terms"))
    partitions = partitions or documents.sparkSession.sparkContext.defaultParallelism
    model = Word2Vec(
        vectorSize=size, minCount=min_count, seed=seed, numPartitions=partitions, maxIter=rounds, inputCol="terms", outputCol="v"
    ).fit(bag)
    return model.transform(bag).select("id", vector_to_array("v").alias("vec"))


def reduce_dimensions(vectors: DataFrame, size: int = 5) -> DataFrame:
    """Principal components of the unit-length vectors, so that distance follows the cosine."""
    unit = Normalizer(inputCol="v", outputCol="unit").transform(
        vectors.filter(F.col("vec").isNotNull()).select("id", array_to_vector("vec").alias("v"))
    )
    reduced = PCA(k=size, inputCol="unit", outputCol="r").fit(unit).transform(unit)
    return reduced.select("id", vector_to_array("r").alias("vec"))


def centroids(assigned: DataFrame) -> DataFrame:
    """``topic``, ``pos``, ``x``: mean vector per topic, one row per coordinate. Needs ``topic`` and ``vec``."""
    long = assigned.filter("topic >= 0").select("topic", F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "x"))
    return long.groupBy("topic", "pos").agg(F.avg("x").alias("x"))


def _centroid_matrix(assigned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Topic ids and their mean vectors on the driver: a model, one vector per topic."""
    rows = centroids(assigned).toPandas()
    wide = rows.pivot(index="topic", columns="pos", values="x").sort_index()
    return wide.index.to_numpy(), wide.to_numpy(dtype=float)


def reduce_outliers(assigned: DataFrame) -> DataFrame:
    """Give each outlier (-1) the topic whose mean vector has the largest cosine with it.

    ``assigned`` has ``id``, ``topic``, ``vec``; the result has ``id``, ``topic``.
    Ties go to the lowest topic id. Outliers without a vector stay outliers. Only
    outliers with a vector reach Python; the means are sent in blocks of bounded
    size, one pass over the outliers each.
    """
    ids, means = _centroid_matrix(assigned)
    if len(ids) == 0:
        return assigned.select("id", "topic")
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-300)
    kind = assigned.schema["topic"].dataType.simpleString()
    loose = (F.col("topic") == -1) & F.col("vec").isNotNull()
    best = assigned.filter(loose).select(
        "id", "topic", F.col("vec").cast("array<double>").alias("vec"), F.lit(float("-inf")).alias("cosine")
    )
    step = max(1, MAX_SHARED_NUMBERS // unit.shape[1])
    for first in range(0, len(ids), step):
        block, names = unit[first : first + step], ids[first : first + step]

        def closer(batches, block=block, names=names):
            for pdf in batches:
                if len(pdf):
                    cosines = np.array(pdf["vec"].tolist(), dtype=float) @ block.T
                    place = cosines.argmax(axis=1)
                    top = cosines[np.arange(len(pdf)), place]
                    nearer = top > pdf["cosine"].to_numpy()
                    pdf = pdf.assign(
                        topic=np.where(nearer, names[place], pdf["topic"]), cosine=np.where(nearer, top, pdf["cosine"])
                    )
                yield pdf

        best = best.mapInPandas(closer, best.schema)
    rest = assigned.filter(~F.coalesce(loose, F.lit(False))).select("id", "topic")
    return best.select("id", F.col("topic").cast(kind)).unionByName(rest)


def merge_topics(assigned: DataFrame, max_topics: int) -> DataFrame:
    """Merge the two topics with the most similar mean vectors until ``max_topics`` remain.

    Means are weighted by size; among equals the lowest ids go first. The order is
    worked out on the topic means, with the nearest partner of every topic kept up
    to date. New ids follow topic size, the largest being 0.
    """
    ids, means = _centroid_matrix(assigned)
    if len(ids) <= max_topics:
        return assigned.select("id", "topic")
    counts = {r["topic"]: r["count"] for r in assigned.filter("topic >= 0").groupBy("topic").count().collect()}
    owner = merge_order(means, np.array([counts[i] for i in ids], dtype=float), max_topics)
    mapping = assigned.sparkSession.createDataFrame([(int(i), int(ids[k])) for i, k in zip(ids, owner)], "topic int, merged int")
    # One row per topic, as large as the model on the driver; outliers stay out of the join.
    merged = assigned.filter("topic >= 0").join(mapping, "topic").select("id", F.col("merged").alias("topic"))
    return renumber(merged.unionByName(assigned.filter("topic < 0 OR topic IS NULL").select("id", F.col("topic").cast("int"))))


def merge_order(means: np.ndarray, weight: np.ndarray, keep: int) -> np.ndarray:
    """For each row the row it ends up in, when the most similar pair is merged until ``keep`` remain."""
    means, weight = means.copy(), weight.copy()
    n = len(means)
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)
    unit, alive, owner = norm(means), np.ones(n, bool), np.arange(n)
    partner, closeness = np.zeros(n, int), np.full(n, -np.inf)

    def look(i: int) -> None:
        """The best partner of ``i`` among the later rows."""
        partner[i], closeness[i] = i, -np.inf
        if i + 1 < n:
            similar = np.where(alive[i + 1 :], unit[i + 1 :] @ unit[i], -np.inf)
            k = int(similar.argmax())
            if similar[k] > -np.inf:
                partner[i], closeness[i] = i + 1 + k, similar[k]

    for i in range(n):
        look(i)
    for _ in range(n - max(keep, 1)):
        i = int(closeness.argmax())
        j = int(partner[i])
        means[i] = (means[i] * weight[i] + means[j] * weight[j]) / (weight[i] + weight[j])
        weight[i] += weight[j]
        unit[i] = norm(means[i])
        alive[j], closeness[j] = False, -np.inf
        owner[owner == j] = i
        similar = unit[:i] @ unit[i]
        for k in range(i):
            if alive[k] and partner[k] not in (i, j) and (similar[k], -i) > (closeness[k], -partner[k]):
                partner[k], closeness[k] = i, similar[k]
        look(i)
        for k in np.flatnonzero(alive & ((partner == j) | (partner == i))).tolist():
            if k != i:
                look(k)
    return owner


def numbered(frame: DataFrame, *order) -> DataFrame:
    """Add ``number``, 0..n-1 in the given order.

    The frame is range-partitioned, stored, and numbered partition by partition,
    so that no task holds all of it.
    """
    return with_row_index(keep_in_order(frame.orderBy(*order))).withColumnRenamed(INDEX, "number")


def renumber(assigned: DataFrame) -> DataFrame:
    """Topic ids by size, largest first; -1 stays."""
    sizes = assigned.filter("topic >= 0").groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    ranks = numbered(sizes, F.col("size").desc(), "topic").select("topic", "number")
    # One row per topic; outliers stay out of the join.
    named = assigned.filter("topic >= 0").join(ranks, "topic").select("id", F.col("number").cast("int").alias("topic"))
    loose = assigned.filter("topic < 0 OR topic IS NULL").select("id", F.lit(-1).alias("topic"))
    return named.unionByName(loose)


def topic_positions(assigned: DataFrame, topics: DataFrame) -> DataFrame:
    """``id``, ``label``, ``frequency``, ``x``, ``y``: mean 2-d vector per topic, (0, 0) for an empty one."""
    point = lambda i: F.avg(F.col("vec")[i].cast("double"))
    means = assigned.filter("topic >= 0").groupBy(F.col("topic").alias("id")).agg(point(0).alias("x"), point(1).alias("y"))
    kept = [c for c in ("id", "label", "frequency") if c in topics.columns]
    zero = F.lit(0.0)
    return topics.select(*kept).join(means, "id", "left").withColumns(
        {"x": F.coalesce("x", zero), "y": F.coalesce("y", zero)}
    )


def document_positions(documents: DataFrame, n: int = 5000, seed: int = 5000) -> DataFrame:
    """At most ``n`` documents, chosen by a seeded hash of the id.

    The choice does not depend on how the table is partitioned. It is a top-k,
    so each task keeps n rows.
    """
    ticket = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))
    return documents.orderBy(ticket, "id").limit(n)


def silhouette_per_document(assigned: DataFrame) -> DataFrame:
    """``id``, ``topic``, ``silhouette`` of every document with a topic and a vector, by squared distances.

    a is the mean squared distance to the other documents of its topic, b the least of
    the mean squared distances to another topic; the value is (b - a) / max(a, b), and 0
    for the only document of a topic, for a single topic and where all coincide. The means
    follow from each topic's size, mean vector and mean squared length, so documents
    meet topics, in blocks of bounded size, and never each other.
    """
    used = assigned.filter("topic >= 0 AND vec IS NOT NULL").select("id", "topic", F.col("vec").cast("array<double>").alias("vec"))
    names, means = _centroid_matrix(used)
    kind = used.schema["topic"].dataType.simpleString()
    if len(names) < 2:
        return used.select("id", "topic", F.lit(0.0).alias("silhouette"))
    centre = means.mean(axis=0)  # distances do not change when all move; rounding does

    def lengths(batches):
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["vec"].tolist(), dtype=float) - centre
                yield pd.DataFrame({"topic": pdf["topic"], "squared": (x * x).sum(axis=1)})

    moments = (
        used.select("topic", "vec").mapInPandas(lengths, f"topic {kind}, squared double").groupBy("topic")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("squared").alias("squared")).toPandas().set_index("topic").loc[names]
    )
    counts, squared, means = moments["n"].to_numpy(float), moments["squared"].to_numpy(float), means - centre
    step = max(1, MAX_SHARED_NUMBERS // means.shape[1])
    out = used.withColumns({"a": F.lit(0.0), "b": F.lit(float("inf")), "n": F.lit(1.0)})
    for first in range(0, len(names), step):
        part = slice(first, first + step)
        block = (names[part], means[part], counts[part], squared[part])

        def measure(batches, block=block):
            ids, mean, count, square = block
            for pdf in batches:
                if len(pdf):
                    x = np.array(pdf["vec"].tolist(), dtype=float) - centre
                    far = np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ mean.T) + square, 0.0)
                    place = np.minimum(np.searchsorted(ids, pdf["topic"].to_numpy()), len(ids) - 1)
                    own = ids[place] == pdf["topic"].to_numpy()
                    rows = np.flatnonzero(own)
                    a, n = pdf["a"].to_numpy().copy(), pdf["n"].to_numpy().copy()
                    a[rows], n[rows] = far[rows, place[rows]], count[place[rows]]
                    far[rows, place[rows]] = np.inf
                    pdf = pdf.assign(a=a, n=n, b=np.minimum(pdf["b"].to_numpy(), far.min(axis=1)))
                yield pdf

        out = out.mapInPandas(measure, out.schema)
    a, b = F.col("a") * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1.0)), F.col("b")
    value = F.when((F.col("n") > 1) & (F.greatest(a, b) > 0), (b - a) / F.greatest(a, b)).otherwise(0.0)
    return out.select("id", "topic", value.alias("silhouette"))


def silhouette_per_topic(assigned: DataFrame) -> DataFrame:
    """``topic``, ``silhouette`` (mean over its documents), ``support`` (their number)."""
    return silhouette_per_document(assigned).groupBy("topic").agg(
        F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("support")
    )


def silhouette(assigned: DataFrame) -> DataFrame:
    """One row: the mean silhouette over documents with a topic, NULL without any."""
    return silhouette_per_document(assigned).agg(F.avg("silhouette").alias("silhouette"))
