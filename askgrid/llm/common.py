"""What several operators share: words, written tables, linked components."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.session import new_path

# Upper-case ASCII becomes lower case; other ASCII signs than letters and digits become blanks.
PLAIN_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: Identifier that stands for a missing one wherever identifiers are ordered: larger than all others.
NO_ID = 2**63 - 1


def plain_words(data: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and anything beyond ASCII."""
    return data.translate(PLAIN_WORDS).split()


def text_bytes(text: str = "text") -> Column:
    """The text as UTF-8; null is empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def of_worker(key: str, make):
    """What ``make`` gives, made once for all tasks that a Python worker runs."""
    held = sys.modules.setdefault("askgrid_of_worker", types.ModuleType("askgrid_of_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def free_name(name: str, df: DataFrame) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame) -> DataFrame:
    """``(id, root)``: for every linked id the smallest id that its links lead to.

    ``links`` has two columns of one orderable type. Each round hangs larger
    neighbours on the smallest one (first over all neighbours, then over the smaller
    ones), which doubles the reach of every root; the rounds end when nothing
    moves, about log(longest path) of them. Minima are combined before the shuffle
    and come back by a join, so a root with most of the ids is a skewed join, which
    adaptive execution splits, never a group in one task. No link reaches the driver.
    """
    a, b = (F.col(c) for c in links.columns)
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links, before = written(links, "links"), None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v <> m").union(low.select("u", "m"))
        links = written(small.toDF("u", "v").distinct(), "links")
    found = links.groupBy("u").agg(F.min("v").alias("v"))
    roots = links.select(F.col("v").alias("u"), "v")
    return found.union(roots).distinct().toDF("id", "root")
