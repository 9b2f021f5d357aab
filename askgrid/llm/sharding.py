"""Uniform shuffling into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in parts. How many rows of a part go to which shard is drawn first, from the
law that a uniform permutation of all rows would give these counts: rows of the matrix
add up to the parts, columns to the shards. Each part then permutes its own rows and
deals them out by its counts, the rows are exchanged, and each shard permutes what it
got. The two local permutations and the drawn counts together are one uniform
permutation of all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askgrid.llm.common import written

#: Rows of a part at most, as a power of two.
PART_BITS = 16
#: Parts are drawn for by so many tasks; the driver draws for these blocks only.
BLOCKS = 1024
#: Rows that a bucket of a shard is meant to hold, and buckets of a shard at most (beyond, buckets grow).
BUCKET_ROWS = 1 << 12
MOST_BUCKETS = 1 << 14
#: Samples up to this size are drawn one by one.
ONE_BY_ONE = 64


def hypergeometric(rng: np.random.Generator, colours: np.ndarray, size: int) -> np.ndarray:
    """How many of each colour a uniform sample of ``size`` balls without replacement has.

    Exact for any numbers below 2^63. Every ball is taken with the chance ``size / all``,
    which needs one binomial draw a colour. Given how many were taken, they are a uniform
    sample of so many; what is too much is taken back from them, and what is missing from
    the others, by the same rule. Each round leaves about the root of the one before.
    """
    colours = np.asarray(colours, dtype=np.int64)
    total = int(colours.sum())
    if not 0 <= size <= total:
        raise ValueError("a sample can't be larger than what it is drawn from")
    if 2 * size > total:
        return colours - hypergeometric(rng, colours, total - size)
    if size <= ONE_BY_ONE:
        left, out = colours.copy(), np.zeros_like(colours)
        for _ in range(size):
            k = int(np.searchsorted(np.cumsum(left), rng.integers(left.sum()), side="right"))
            left[k] -= 1
            out[k] += 1
        return out
    taken = rng.binomial(colours, size / total)
    over = int(taken.sum()) - size
    if over > 0:
        return taken - hypergeometric(rng, taken, over)
    return taken + hypergeometric(rng, colours - taken, -over) if over else taken


def communication_matrix(rng: np.random.Generator, rows: list[int], columns: np.ndarray) -> np.ndarray:
    """Counts with these sums, by the law of a uniform permutation: row after row from what is left."""
    left, out = np.asarray(columns, dtype=np.int64).copy(), []
    for n in rows:
        out.append(hypergeometric(rng, left, int(n)))
        left -= out[-1]
    return np.array(out, dtype=np.int64).reshape(len(rows), len(left))


def even_sizes(n: int, shards: int) -> np.ndarray:
    """``n`` rows over ``shards``: counts at most one apart, the first ones larger."""
    return np.array([n // shards + (s < n % shards) for s in range(shards)], dtype=np.int64)


def _drawn(parts: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int]:
    """``(part, counts)`` for ``parts(part, n)``, and the number of rows.

    The driver sees one sum for each of ``BLOCKS`` blocks of parts and draws for these;
    each block's task then draws for its parts, from the block's own counts.
    """
    blocked = parts.withColumn("block", F.pmod(F.xxhash64("part"), F.lit(BLOCKS)))
    sums = sorted((r["block"], r["n"]) for r in blocked.groupBy("block").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sums)
    of_block = communication_matrix(np.random.default_rng([seed, 0]), [n for _, n in sums], even_sizes(total, shards))
    held = {int(b): counts.tolist() for (b, _), counts in zip(sums, of_block)}

    def draw(table: pd.DataFrame) -> pd.DataFrame:
        block = int(table["block"].iloc[0])
        table = table.sort_values("part")
        drawn = communication_matrix(np.random.default_rng([seed, 1, block]), table["n"].tolist(), np.array(held[block]))
        return pd.DataFrame({"part": table["part"], "counts": drawn.tolist()})

    return blocked.groupBy("block").applyInPandas(draw, "part long, counts array<long>"), total


def _dealt(seed: int) -> Column:
    """The shard of a row from its ``part``, its place in it, and the part's counts."""

    @F.pandas_udf("int")
    def deal(part: pd.Series, place: pd.Series, counts: pd.Series) -> pd.Series:
        out = np.zeros(len(part), dtype=np.int32)
        numbers, places = part.to_numpy(np.int64), place.to_numpy(np.int64)
        for p in np.unique(numbers):
            own = np.flatnonzero(numbers == p)
            ends = np.cumsum(counts.iloc[own[0]])
            order = np.random.default_rng([seed, 2, int(p)]).permutation(int(ends[-1]))
            out[own] = np.searchsorted(ends, order[places[own]], side="right")
        return pd.Series(out)

    return deal("part", "place", "counts")


def _chance(seed: int) -> Column:
    """64 bits of a row's number: by their order a shard permutes what it got."""

    @F.pandas_udf("long")
    def chance(row: pd.Series) -> pd.Series:
        x = row.to_numpy(np.int64).view(np.uint64) + np.random.default_rng([seed, 3]).integers(1 << 63, dtype=np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15), (29, 0xD6E8FEB86659FD93)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return pd.Series((x ^ (x >> np.uint64(32))).view(np.int64))

    return chance("row")


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 42, part_bits: int = PART_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(row, shard, slot)``: every row of ``docs`` as a struct, with its shard and its place there.

    A uniform shuffle of all rows into ``shards`` whose row counts differ by one at most
    (the law ``rows``); slots of a shard are 0, 1, 2 and so on. Rows are numbered and
    written once, so neither lost executors nor other splits move a row, and the
    same written rows with the same ``seed`` get the same places. Parts are runs of
    at most ``2^part_bits`` numbered rows. Nothing depends on what a row holds: null ids
    and texts, repeated rows and any columns are rows like others, and a hot key isn't
    seen at all. An empty table gives no rows; with fewer rows than shards some are empty.

    Rows travel once, to a bucket of their shard by the leading bits of their chance
    number; slots are the ranks in the buckets, moved by the sizes of those before. There
    are as many buckets as the rows need, at most ``MOST_BUCKETS`` a shard.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("data")
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), row), "rows")
    part = F.shiftright("row", part_bits)
    parts = written(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "parts")
    matrix, total = _drawn(parts, shards, seed)
    matrix = written(matrix, "matrix")  # its size on disk decides how it is joined
    placed = rows.withColumns({"part": part, "place": F.col("row").bitwiseAND(F.lit((1 << part_bits) - 1)), "chance": _chance(seed)})
    bits = (max(1, min(MOST_BUCKETS, -(-total // shards // bucket_rows))) - 1).bit_length()
    bucket = F.shiftrightunsigned("chance", 64 - bits) if bits else F.lit(0).cast("long")
    sent = placed.join(matrix, "part").select("row", "chance", "data", _dealt(seed).alias("shard"), bucket.alias("bucket"))
    sizes = sent.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))  # reads the row numbers only
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = written(sizes.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset")), "offsets")
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("chance", "row")) - 1
    ranked = sent.withColumn("inside", inside).join(offsets, ["shard", "bucket"])
    return ranked.select(F.col("data").alias("row"), "shard", (F.col("inside") + F.col("offset")).alias("slot"))
