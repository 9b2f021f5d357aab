"""Near-duplicates: groups of documents whose SimHash fingerprints differ in few bits."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.common import NO_ID, components, free_name, text_bytes, written

BITS = 64
#: Buckets above this size are linked through shared one-bit neighbours instead of pair by pair.
PAIRED = 32


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the unsigned hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k:k + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def shingle_hashes(data: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of all shingles of ``width`` words of the lower-cased text, repeats included."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[:-width].tolist()]
    return np.array([digest(line[s:e], seed) for s, e in zip(starts, (ends[width - 1:] - 1).tolist())], dtype=np.uint64)


def fingerprint(text: str = "text", width: int = 3, seed: int = 42) -> Column:
    """The 64-bit SimHash of a text column as a long; no words, or null, gives 0."""

    @F.pandas_udf("long")
    def simhash(data: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(x, width, seed)) for x in data], dtype="int64")

    return simhash(text_bytes(text))


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of the block choices of which fingerprints within ``distance`` share one."""
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    single = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(single, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def close_links(prints: DataFrame, distance: int = 2, blocks: int = 4, paired: int = PAIRED) -> DataFrame:
    """Links ``(family, a, b)`` that connect all fingerprints within ``distance`` (0 to 2) bits.

    ``prints`` has distinct rows ``(family, print)``; only prints of one family are
    compared. Of ``blocks`` blocks two close fingerprints differ in at most
    ``distance``, so they share at least one choice of ``blocks - distance`` blocks:
    they meet by an equi-join on (choice, blocks), and their Hamming distance is then
    checked. A bucket of more than ``paired`` members emits no pairs: each member
    names all values within one bit of it (outside the shared blocks), and those
    that name the same value are within two bits of each other. Such a group has
    at most 65 members and is linked as a star, so the work stays linear and no close
    pair falls apart. With distance 1, members of a star are checked pair by pair.
    """
    if not 0 <= distance <= 2 or blocks <= distance:
        raise ValueError("distance must be 0, 1 or 2, and below the number of blocks")
    masks = block_masks(distance, blocks)
    choices = F.array(*[
        F.struct(F.lit(k).alias("choice"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("block"))
        for k, m in enumerate(masks)
    ])
    keyed = prints.select("family", "print", F.inline(choices))
    key = ["family", "choice", "block"]
    sizes = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = keyed.join(sizes, key)
    few = met.where(F.col("members") <= paired).drop("members")
    pairs = (
        few.withColumnRenamed("print", "a").join(few.withColumnRenamed("print", "b"), key)
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("family", "a", "b")
    )
    flips = F.element_at(
        F.array(*[
            F.array(F.lit(0), *[F.lit(_signed(1 << bit)) for bit in range(BITS) if not m >> bit & 1]).cast("array<long>")
            for m in masks
        ]),
        F.col("choice") + 1,
    )
    named = met.where(F.col("members") > paired).select("family", "choice", "print", F.explode(flips).alias("flip"))
    stars = (
        named.groupBy("family", "choice", F.col("print").bitwiseXOR(F.col("flip")).alias("value"))
        .agg(F.collect_set("print").alias("near")).where(F.size("near") > 1)
    )
    if distance == 2:
        linked = stars.select("family", F.array_min("near").alias("a"), F.explode("near").alias("b"))
    else:
        linked = stars.select("family", "near", F.explode("near").alias("a")).select("family", "a", F.explode("near").alias("b"))
        linked = linked.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return pairs.union(linked.where("a < b")).distinct()


def rooted(distinct: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``distinct`` with ``root``: one fingerprint that stands for all that links connect with ``print``."""
    links = close_links(distinct.select(F.lit(0).alias("family"), "print"), distance, blocks).select("a", "b")
    roots = components(links).withColumnRenamed("id", "print")
    return distinct.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2,
    blocks: int = 4, seed: int = 42,
) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents whose fingerprints differ in at most ``distance`` bits are linked;
    ``component_id`` is the smallest id that links lead to. Equal fingerprints are
    folded to one before anything is joined, so copies cost one row each.

    Null text counts as empty: fingerprint 0, linked like any other. A null id keeps
    its row and never names a component, which is null if no id is there at all.
    Repeated rows stay repeated. Columns beyond id and text are left out.
    """
    prints = written(docs.select(F.col(id_col).alias("id"), fingerprint(text, width, seed).alias("print")), "simhash")
    distinct = rooted(prints.groupBy("print").agg(F.min("id").alias("first")), distance, blocks)
    named = distinct.join(distinct.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return prints.join(named.select("print", "component_id"), "print").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2,
    blocks: int = 4, seed: int = 42,
) -> DataFrame:
    """One row of each group that :func:`simhash_groups` finds, that with the smallest id.

    All columns stay as they are. A null id comes after all others; of several texts with
    that id the one with the smallest digest stays, and of rows equal in both one. Only
    numbers are joined to find the rows that stay; texts travel once, to meet them.
    """
    low, key, one = (free_name(n, docs) for n in ("low", "key", "one"))
    keyed = docs.withColumns({low: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), key: F.xxhash64(text_bytes(text))})
    prints = written(keyed.select(F.col(low).alias("low"), F.col(key).alias("key"), fingerprint(text, width, seed).alias("print")), "simhash")
    distinct = rooted(prints.groupBy("print").agg(F.min(F.struct("low", "key")).alias("first")), distance, blocks)
    best = written(distinct.groupBy("root").agg(F.min("first").alias("first")), "kept")
    best = best.select(F.col("first.low").alias(low), F.col("first.key").alias(key))
    numbered = keyed.join(best, [low, key], "left_semi").withColumn(one, F.monotonically_increasing_id())
    kept = written(numbered, "kept-rows")  # numbers must not change between the two readings
    ones = kept.groupBy(low, key).agg(F.min(one).alias(one))
    return kept.join(ones.select(one), one, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
