"""Ranks and exact quantiles without gathering a column in one task.

Both start from a *value table*: one row per distinct value, with counts. The
counting is a partial aggregation, so a value that holds a third of all rows
shrinks to one row per task before anything is shuffled. Values are then cut
into buckets at split points taken from a bounded sketch; the bucket is a fixed
function of the value, so it is the same on every evaluation. Running sums stay
inside a bucket, and the few bucket totals carry them across.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10000


def bucket_count(df: DataFrame) -> int:
    """One bucket per shuffle partition, at most 1000 (each row is compared with every split)."""
    return max(8, min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def with_bucket(table: DataFrame, value: str, *counts: str) -> DataFrame:
    """Add ``bucket`` to a value table: how many split points lie below ``value``.

    The split points are approximate quantiles of the distinct values, computed
    once by a scalar subquery; how good they are affects balance only, never the
    result. The subquery looks at all ``counts``, so that it needs the very
    shuffle that the table itself needs, and Spark runs that once for both.
    """
    n = bucket_count(table)
    points = [i / n for i in range(1, n)]
    seen = reduce(lambda a, b: a | b, [F.col(c) >= 0 for c in counts])
    splits = table.filter(seen).agg(
        F.array_distinct(F.percentile_approx(value, points, F.lit(SKETCH_ACCURACY))).alias("splits")
    ).scalar()
    return table.withColumn("__splits", splits).withColumn(
        "bucket", F.coalesce(F.size(F.filter("__splits", lambda s: s < F.col(value))), F.lit(0))
    ).drop("__splits")


def rank_sums(rows: DataFrame, value: str, cells: dict[str, Column], pairs: list[tuple[str, str]], pooled: bool) -> DataFrame:
    """Everything the rank tests need, as one row.

    ``cells`` names sub-populations by boolean columns over ``rows``. The result has

    * ``n_<cell>`` – rows in the cell;
    * for each pair (a, b): ``u_<a>_<b>`` – pairs with a above b, ties counting
      half, and ``tie_<a>_<b>`` – the sum of t^3 - t over tied values of both;
    * with ``pooled``: ``r_<cell>`` – the cell's sum of mid-ranks among all
      cells, and ``tie_all``.

    Results are sums of exact products; bucket totals are combined at the end.
    """
    names = list(cells)
    table = rows.groupBy(value).agg(*[F.count_if(c).cast("double").alias(n) for n, c in cells.items()])
    table = with_bucket(table, value, *names)
    before = W.partitionBy("bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    below = {n: F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"below_{n}") for n in names}
    table = table.select("*", *below.values())

    everyone = sum((F.col(n) for n in names), F.lit(0.0))
    below_all = sum((F.col(f"below_{n}") for n in names), F.lit(0.0))
    local = [F.sum(n).alias(n) for n in names]
    for a, b in pairs:
        t = F.col(a) + F.col(b)
        local.append(F.sum(F.col(a) * (F.col(f"below_{b}") + F.col(b) / 2)).alias(f"u_{a}_{b}"))
        local.append(F.sum(t * t * t - t).alias(f"tie_{a}_{b}"))
    if pooled:
        local += [F.sum(F.col(n) * (below_all + (everyone + 1) / 2)).alias(f"r_{n}") for n in names]
        local.append(F.sum(everyone * everyone * everyone - everyone).alias("tie_all"))
    buckets = table.groupBy("bucket").agg(*local)

    # At most 1000 bucket rows from here on.
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.select(
        "*", *[F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(f"offset_{n}") for n in names]
    )
    offset_all = sum((F.col(f"offset_{n}") for n in names), F.lit(0.0))
    final = [F.sum(n).alias(f"n_{n}") for n in names]
    for a, b in pairs:
        final.append(F.sum(F.col(f"u_{a}_{b}") + F.col(a) * F.col(f"offset_{b}")).alias(f"u_{a}_{b}"))
        final.append(F.sum(f"tie_{a}_{b}").alias(f"tie_{a}_{b}"))
    if pooled:
        final += [F.sum(F.col(f"r_{n}") + F.col(n) * offset_all).alias(f"r_{n}") for n in names]
        final.append(F.sum("tie_all").alias("tie_all"))
    return buckets.agg(*final)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key, one output column per probability.

    Only the buckets that hold a wanted rank are sorted. NULL values are
    ignored; keys must not be NULL.
    """
    rows = rows.select(*keys, F.col(value).alias("__v")).filter(F.col("__v").isNotNull())
    table = with_bucket(rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")), "__v", "__n")

    totals = table.groupBy(*keys, "bucket").agg(F.sum("__n").alias("held"))
    per_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = per_key.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("start", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    totals = totals.withColumn("total", F.sum("held").over(per_key))
    ranks = []
    for p in probabilities.values():
        place = F.lit(float(p)) * (F.col("total") - 1)
        ranks += [F.floor(place), F.ceil(place)]
    wanted = F.array_distinct(F.array(*ranks))
    inside = F.filter(wanted, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("held")))
    targets = totals.select(*keys, "bucket", "start", "total", inside.alias("ranks")).filter(F.size("ranks") > 0)

    running = W.partitionBy(*keys, "bucket").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    candidates = table.join(targets, [*keys, "bucket"]).withColumn("upto", F.col("start") + F.sum("__n").over(running))
    hit = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("__n")))
    hits = candidates.select(*keys, "total", "__v", F.explode(hit).alias("rank"))

    outputs = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("total") - 1)
        low = F.max(F.when(F.col("rank") == F.floor(place), F.col("__v")))
        high = F.max(F.when(F.col("rank") == F.ceil(place), F.col("__v")))
        share = F.max(place - F.floor(place))
        outputs.append((low + (high - low) * share).alias(name))
    if keys:
        return hits.groupBy(*keys).agg(*outputs)
    return hits.agg(*outputs)
