"""Row numbers over any amount of data, without one task seeing a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Hex digits of the ordering digest that name a bucket: 16^4 = 65,536 buckets.
BUCKET_DIGITS = 4


#: Groups of no more rows are numbered at once, and buckets of larger ones have about as many at most.
ROWS_AT_ONCE = 1 << 16


def with_rank(df: DataFrame, order: str, groups: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by ``order``.

    ``order`` must be a column of uniform hex digests, one per row. Their leading
    digits cut every large group into equal buckets. Rows are numbered
    inside their bucket and shifted by the sizes of the buckets before it; those
    sizes are at most 65,536 rows per group. Only groups of more than ``ROWS_AT_ONCE`` rows are
    cut, so that all others need no shift; shifts, which are sent to every task, are one for each
    ``ROWS_AT_ONCE / 16`` rows at most.
    """
    groups = groups or []
    # A null is a group like any other.
    same = [F.col(k).eqNullSafe(F.col(f"rank_key_{n}")) for n, k in enumerate([*groups, "rank_bucket"])]
    if groups:
        n, digits = F.count(F.lit(1)), F.lit(BUCKET_DIGITS)
        for fewer in range(BUCKET_DIGITS - 1, 0, -1):
            digits = F.when(n <= ROWS_AT_ONCE * 16**fewer, fewer).otherwise(digits)
        large = df.groupBy(*[F.col(f"`{k}`").alias(f"rank_key_{n}") for n, k in enumerate(groups)]).agg(n.alias("rank_n"), digits.alias("rank_digits"))
        large = F.broadcast(large.where(F.col("rank_n") > ROWS_AT_ONCE).drop("rank_n"))
        bucketed = df.join(large, same[:-1], "left").withColumn("rank_bucket", F.left(order, F.coalesce("rank_digits", F.lit(0))))
        cut = bucketed.where("rank_digits IS NOT NULL")
        bucketed = bucketed.drop(*[f"rank_key_{n}" for n in range(len(groups))], "rank_digits")
    else:
        cut = bucketed = df.withColumn("rank_bucket", F.substring(order, 1, BUCKET_DIGITS))
    keys = [*groups, "rank_bucket"]
    before = W.partitionBy(*groups).orderBy("rank_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rank_n"))
        .select(
            *[F.col(k).alias(f"rank_key_{n}") for n, k in enumerate(keys)],
            F.coalesce(F.sum("rank_n").over(before), F.lit(0)).alias("rank_offset"),
        )
    )
    # Sorting compares a number first.
    inside = F.row_number().over(W.partitionBy(F.xxhash64(*keys), *keys).orderBy(order)) - 1
    return (
        bucketed.withColumn("rank_inside", inside)
        .join(F.broadcast(offsets), same, "left")
        .withColumn(name, F.col("rank_inside") + F.coalesce("rank_offset", F.lit(0)))
        .drop("rank_bucket", "rank_inside", "rank_offset", *[f"rank_key_{n}" for n in range(len(keys))])
    )


def in_stretches(df: DataFrame, order: str, rows: int, name: str = "rank") -> DataFrame:
    """As :func:`with_rank` over all rows, with stretches of about ``rows`` rows kept together, by one shuffle.

    ``order`` is a column of uniform binary digests, one per row. The bucket offsets are known before
    the shuffle, so rows go to the stretch that their bucket begins in and are numbered
    there from its first bucket's offset. A stretch exceeds ``rows`` by one bucket at most.
    """
    bucketed = df.withColumn("rank_bucket", F.substring(F.hex(F.substring(order, 1, BUCKET_DIGITS // 2)), 1, BUCKET_DIGITS))
    before = W.orderBy("rank_bucket").rowsBetween(W.unboundedPreceding, -1)
    counted = bucketed.groupBy("rank_bucket").agg(F.count(F.lit(1)).alias("rank_n"))
    placed = counted.withColumn("rank_offset", F.coalesce(F.sum("rank_n").over(before), F.lit(0))).withColumn(
        "rank_stretch", F.floor(F.col("rank_offset") / rows).cast("long")
    )
    first = F.min("rank_offset").over(W.partitionBy("rank_stretch"))
    placed = placed.select("rank_bucket", "rank_stretch", first.alias("rank_first"))
    inside = F.row_number().over(W.partitionBy("rank_stretch").orderBy(order)) - 1
    return (
        bucketed.join(F.broadcast(placed), "rank_bucket")
        .drop("rank_bucket")
        .withColumn(name, inside + F.col("rank_first"))
        .drop("rank_stretch", "rank_first")
    )


def group_sizes(df: DataFrame, groups: list[str], name: str = "group_size") -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias(name))
