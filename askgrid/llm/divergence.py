"""How the sources of a language differ in their words, from joint tables of count levels.

A term's probability in a group depends on its count there alone, so what two groups
have in common is their joint table: how many terms have this count here and that count
there. Indicator columns stand for (group, count), one row for each term; the product
of the transposed matrix with itself has all joint tables. It is worked out in blocks of terms
and of groups, each an exact product of whole numbers, and the tables' cells
are priced by the two probabilities.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askgrid.llm.common import text_bytes, written

#: Probabilities are whole numbers of this many parts, plus one.
SCALE = 1_000_000_000
#: Added to each count.
PRIOR = 5
#: Sources of a block, and indicator columns that are multiplied at once.
SOURCES = 32
COLUMNS = 4096
#: Distinct (group, term) pairs that a task holds before it hands its counts on.
HELD = 400_000

# Upper-case ASCII becomes lower case; other ASCII signs than letters become blanks.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def letter_words(data: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and anything beyond ASCII."""
    return data.translate(_LETTERS).split()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents with the term, added within tasks."""

    def count(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def rows():
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array(map(n.__getitem__, terms), pa.int64(), size=len(terms)), pa.array(map(docs.__getitem__, terms), pa.int64(), size=len(terms)),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            for lang, source, data in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("data")):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                words = letter_words(data.as_py())
                size -= len(n)
                n.update(words)
                docs.update(set(words))
                size += len(n)
            if size > HELD:
                yield from rows()
                held.clear()
                size = 0
        yield from rows()

    texts = docs.select(_named(lang).alias("lang"), _named(source).alias("source"), text_bytes(text).alias("data"))
    return texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _named(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def kept_terms(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, total, first)`` of the terms in at least ``least`` documents of their language.

    ``total`` is the count in the language; ``first`` marks one row of each (lang, term).
    """
    counts = term_counts(docs, text, lang, source).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    wide = counts.withColumns({
        "total": F.sum("n").over(of_term), "in_docs": F.sum("docs").over(of_term), "first": F.min("source").over(of_term) == F.col("source"),
    })
    return wide.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "total", "first")


def whole_price(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms))``, exact; 0 where there are no terms."""
    above, below = ((c + PRIOR * d).cast("decimal(20,0)") for c, d in ((n, F.lit(1)), (total, terms)))
    quotient = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * above, F.nullif(below, F.lit(0).cast("decimal(20,0)")))
    return F.coalesce(quotient + 1, F.lit(0)).cast("long")


def block_product(terms: np.ndarray, source: np.ndarray, n: np.ndarray, side: np.ndarray, same: bool):
    """The cells of the joint tables of all pairs of sources of a block, as (column, column, terms).

    Entries say that the term ``terms`` has the count ``n`` in ``source``; every source has an entry
    with the term -1 that stands for the count 0, which holds for the terms without another
    entry. ``side`` says in which of two blocks a source is; with ``same`` there is one
    block, and only pairs in ascending order are made. Also returns each entry's column and
    each column's source. Cells are whole numbers below 2^24, which single floats hold exactly.
    """
    counts, code = np.unique(n, return_inverse=True)
    keys, column = np.unique(source * len(counts) + code, return_inverse=True)
    of_source, of_n = keys // len(counts), counts[keys % len(counts)]
    real = terms >= 0
    distinct, row = np.unique(terms[real], return_inverse=True)
    matrix = np.zeros((len(distinct), len(of_source)), dtype=np.float32)
    zero = np.flatnonzero(of_n == 0)
    at_zero = np.full(int(of_source.max()) + 1, -1)
    at_zero[of_source[zero]] = zero
    matrix[:, zero] = 1
    matrix[row, at_zero[source[real]]] = 0
    matrix[row, column[real]] = 1
    sides = np.zeros(int(of_source.max()) + 1, dtype=np.int64)
    sides[source] = side
    left = np.flatnonzero(sides[of_source] == 0)
    right = left if same else np.flatnonzero(sides[of_source] == 1)
    out = []
    for i in range(0, len(left), COLUMNS):
        a = left[i:i + COLUMNS]
        for j in range(0, len(right), COLUMNS):
            b = right[j:j + COLUMNS]
            if same and of_source[a[0]] > of_source[b[-1]]:
                continue
            cells = matrix[:, a].T @ matrix[:, b]
            x, y = np.nonzero(cells)
            some = cells[x, y].astype(np.int64)
            x, y = a[x], b[y]
            if same:
                good = of_source[x] < of_source[y]
                x, y, some = x[good], y[good], some[good]
            out.append((x, y, some))
    if not len(distinct):  # no terms: the pairs are there, with nothing in common
        x, y = (z.ravel() for z in np.meshgrid(left[of_n[left] == 0], right[of_n[right] == 0], indexing="ij"))
        good = of_source[x] < of_source[y] if same else np.ones(len(x), dtype=bool)
        out.append((x[good], y[good], np.zeros(int(good.sum()), dtype=np.int64)))
    return out, column, of_source


def joint_tables(kept: DataFrame, groups: DataFrame, sources: int = SOURCES) -> DataFrame:
    """``(lang, a, b, p_a, p_b, terms)``: cells of the joint table of every two sources of a language, a pair once.

    ``kept`` has ``(lang, source, term, n, total, first, p)`` and ``groups`` every
    ``(lang, source)`` with ``p``, the price of a count of 0. A cell says how many ``terms``
    have one price here and another there; cells of several blocks stand side by side.
    Terms are blocked by the size of their count and a digest, so that rare ones, which
    have few levels, share large blocks; sources are blocked by a digest. A block's task
    holds its terms for ``2 * sources`` sources, whatever the data. Pairs of a
    language without terms have one cell of no terms.
    """
    level = F.length(F.bin("total")) - 1
    size = F.greatest(F.lit(256), F.least(F.lit(8192), F.call_function("shiftright", F.lit(1 << 18), F.least(level, F.lit(30)))))
    kinds = written(
        kept.where("first").groupBy("lang", level.alias("level")).agg(F.ceil(F.count(F.lit(1)) / F.min(size)).cast("int").alias("blocks"))
        .union(groups.select("lang", F.lit(-1), F.lit(1)).distinct()), "term-blocks",
    )
    sides = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / sources).cast("int").alias("sides"))
    sides = written(groups.join(sides, "lang").select("lang", "source", "p", "sides", F.pmod(F.xxhash64("source"), "sides").cast("int").alias("side")), "source-blocks")
    entries = (
        kept.withColumn("level", level).join(kinds, ["lang", "level"])
        .join(sides.select("lang", "source", "sides", "side"), ["lang", "source"])
        .select("lang", "level", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "n", "p", "sides", "side")
    )
    zeros = sides.join(kinds, "lang").select(
        "lang", "level", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source",
        F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "p", "sides", "side",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")
    sent = entries.union(zeros).select("*", other).select("*", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high")).drop("sides", "other")

    def product(table: pa.Table) -> pa.Table:
        lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
        names = pa.array(sorted(table.column("source").unique().to_pylist()), pa.string())  # one order in all blocks
        source = pc.index_in(table.column("source"), names).to_numpy().astype(np.int64)
        term = table.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        n, p, side = (table.column(c).to_numpy() for c in ("n", "p", "side"))
        cells, column, of_source = block_product(term, source, n, (side != low).astype(np.int64), low == high)
        prices = np.zeros(len(of_source), dtype=np.int64)
        prices[column] = p
        x, y, some = (np.concatenate([c[k] for c in cells]) if cells else np.zeros(0, np.int64) for k in range(3))
        word = lambda z: names.take(pa.array(of_source[z]))
        return pa.table({
            "lang": pa.array([lang] * len(x), pa.string()), "a": word(x), "b": word(y), "p_a": prices[x], "p_b": prices[y], "terms": some,
        })

    return sent.groupBy("lang", "level", "block", "low", "high").applyInArrow(product, "lang string, a string, b string, p_a long, p_b long, terms long")


def audit(docs: DataFrame, least: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far sources differ, and by which terms.

    Part ``pair``: for each (lang, source) every other source of the language, with the sum of
    the price differences over all kept terms. Part ``term``: the ``top`` terms of
    the group whose price exceeds their price in the language, with the excess.

    Null text, lang and source count as ''. A group without terms, or in a language without kept
    terms, is there all the same. Repeated rows are documents of their own. An empty
    table gives no rows; columns beyond the three aren't read. Ranks go by value, then by
    the item's UTF-8 bytes. A hot source is one row for each term before anything is shuffled by it.
    """
    kept = written(kept_terms(docs, least, text, lang, source), "terms")
    named = docs.select(_named(lang).alias("lang"), _named(source).alias("source")).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.sum(F.col("first").cast("long")).alias("terms"))
    groups = named.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["size", "lang_size", "terms"])
    groups = written(groups, "groups")
    size, terms = F.col("size"), F.col("terms")
    priced = kept.join(groups, ["lang", "source"]).withColumns({"p": whole_price(F.col("n"), size, terms), "q": whole_price(F.col("total"), F.col("lang_size"), terms)})
    cells = joint_tables(
        priced.select("lang", "source", "term", "n", "total", "first", "p"),
        groups.select("lang", "source", whole_price(F.lit(0).cast("long"), size, terms).alias("p")),
    )
    once = cells.groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * F.abs(F.col("p_a") - F.col("p_b"))).alias("value"))
    once = written(once, "pairs")
    both = once.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(once.select("lang", "b", "a", "value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    above = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).union(ranked.select(columns))
