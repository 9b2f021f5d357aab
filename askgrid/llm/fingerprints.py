"""I-Match fingerprints: sorted distinct mid-frequency terms, hashed over randomised lexicon subsets.

Only DataFrame operations. A lexicon holds the terms of the corpus whose inverse
document frequency ``ln(documents / documents with the term)`` lies in a band. Each of
several subsets keeps a random share of the lexicon, from all of it down to one in 256;
a text's distinct terms in the subset, sorted, are hashed together. Long texts
tend to agree with their edited versions on the sparse subsets, short ones on the dense.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.llm.common import partitions_of
from askgrid.session import stored

IDF_BAND = (3.0, 7.5)
SEEDS, RATES = 5, 9
#: Lexicon rows that may be broadcast (16 bytes each); a larger lexicon is joined by a shuffle.
BROADCAST_TERMS = 2_000_000


def terms_of(text: Column) -> Column:
    """Distinct terms, as 64-bit digests: lower-cased runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """The ``term`` digests whose inverse document frequency lies in ``band``.

    Every document counts. At most ``terms per document * e ** band[1]`` terms can be as
    frequent as the band asks, whatever the number of documents.
    """
    count = docs.count()
    low, high = (count * math.exp(-x) for x in band[::-1])
    counts = docs.select(F.explode(terms_of(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return stored(counts.where((F.col("n") >= low) & (F.col("n") <= high)).select("term"), "lexicon")


#: What Spark's xxhash64 gives for an array without elements.
EMPTY = 42


def with_subset_hashes(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Each array of distinct terms replaced by one hash per seed and rate; null where a subset has no term.

    A seed draws a number for every term; a rate keeps the terms whose number ends in so
    many zero bits. The subsets of a seed are nested, so each rate filters what the
    rate before it has left, sorted by the drawn numbers.
    """
    key = [c for c in df.columns if c not in kinds]
    drawn = {
        f"{kind}_{seed}_0": F.array_sort(F.transform(F.array_sort(kind), lambda t: F.xxhash64(t, F.lit(seed))))
        for kind in kinds for seed in range(SEEDS)
    }
    df = df.select(*key, *[c.alias(n) for n, c in drawn.items()])
    for rate in range(1, RATES):
        bit = F.lit(1 << (rate - 1))
        df = df.withColumns({
            f"{kind}_{seed}_{rate}": F.filter(f"{kind}_{seed}_{rate - 1}", lambda x: x.bitwiseAND(bit) == 0)
            for kind in kinds for seed in range(SEEDS)
        }).withColumns({
            f"{kind}_{seed}_{rate - 1}": F.nullif(F.xxhash64(f"{kind}_{seed}_{rate - 1}"), F.lit(EMPTY))
            for kind in kinds for seed in range(SEEDS)
        })
    last = RATES - 1
    df = df.withColumns({f"{kind}_{seed}_{last}": F.nullif(F.xxhash64(f"{kind}_{seed}_{last}"), F.lit(EMPTY)) for kind in kinds for seed in range(SEEDS)})
    return df.select(*key, *[
        F.array(*[F.col(f"{kind}_{seed}_{rate}") for seed in range(SEEDS) for rate in range(RATES)]).alias(kind) for kind in kinds
    ])


def fingerprints(rows: DataFrame, key: list[str], texts: dict[str, str], words: DataFrame) -> DataFrame:
    """``key`` and for each ``name: text column`` of ``texts`` its slots, an array of hashes.

    Rows of equal key must not occur. Rows without a term of the lexicon in any text are
    absent.
    """
    kinds = list(texts)
    tagged = F.concat(*[
        F.transform(terms_of(F.col(texts[kind])), lambda t: F.struct(F.lit(k).alias("kind"), t.alias("term")))
        for k, kind in enumerate(kinds)
    ])
    words = F.broadcast(words) if words.count() <= BROADCAST_TERMS else words
    hits = rows.select(*key, F.inline(tagged)).join(words, "term")
    gathered = hits.groupBy(*key).agg(*[
        F.collect_list(F.when(F.col("kind") == k, F.col("term"))).alias(kind) for k, kind in enumerate(kinds)
    ])
    return with_subset_hashes(gathered, kinds)


def shown(slots: Column, digest: Column) -> Column:
    """The fingerprint as text: hex hashes, empty where a subset is; the text's own digest if all are."""
    each = F.transform(slots, lambda x: F.coalesce(F.lower(F.hex(x)), F.lit("")))
    some = F.exists(slots, lambda x: x.isNotNull())
    return F.when(some, F.array_join(each, "-")).otherwise(F.concat(F.lit("="), F.lower(F.hex(digest))))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Equal slots as a share of those that are filled in either; ``same`` (1 or 0) if none is."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    filled = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    equal = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(filled > 0, equal / filled).otherwise(same.cast("double"))


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``: first among blocks of cuts, then in one."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts) - 1) + 1
    blocks = [cuts[k:k + size] for k in range(0, len(cuts), size)]

    def upto(numbers: Column) -> Column:
        return F.size(F.filter(numbers, lambda c: c <= value))

    block = upto(F.array(*[F.lit(b[0]) for b in blocks]))
    inner = F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), block - 1)
    return F.when(block > 0, (block - 1) * size + upto(inner)).otherwise(0)


def in_order(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows ``(part, place, id, text)``: ascending ids, cut into ranges that a task sorts.

    Null ids come first; rows with one id are ordered by their text's digest. The cuts
    are approximate quantiles of the ids, as many as there are shuffle partitions.
    """
    parts = partitions_of(docs)
    steps = [k / parts for k in range(1, parts)] or [0.5]
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), steps, 1000)).first()[0] or []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.coalesce(_range_of(F.col("id"), sorted(set(cuts))), F.lit(0)))
    order = Window.partitionBy("part").orderBy("id", F.xxhash64("text"))
    return rows.withColumn("place", F.row_number().over(order))


def with_next(rows: DataFrame, columns: list[str], tag: str) -> DataFrame:
    """``rows`` with ``next_<column>`` of the following row; the first row follows the last."""
    order = Window.partitionBy("part").orderBy("place")
    own = rows.select("*", *[F.lead(c).over(order).alias(f"in_{c}") for c in columns], F.lead("place").over(order).alias("in_place"))
    heads = stored(rows.where("place = 1").select("part", *[F.col(c).alias(f"of_{c}") for c in columns]), tag)
    # One row per range: few rows, and all that a range needs of the others.
    line = heads.select("part").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    ring = line.select(F.posexplode("parts").alias("k", "at"), "parts").select(
        F.col("at"), F.element_at("parts", (F.col("k") + 1) % F.size("parts") + 1).alias("part")
    )
    heads = heads.join(ring, "part").drop("part").withColumnRenamed("at", "part")
    inner = own.where(F.col("in_place").isNotNull()).select(*rows.columns, *[F.col(f"in_{c}").alias(f"next_{c}") for c in columns])
    # Only the last row of each range is joined: the texts of the others stay where they are.
    ended = own.where(F.col("in_place").isNull()).select(rows.columns)
    return inner.union(ended.join(heads, "part").select(*rows.columns, *[F.col(f"of_{c}").alias(f"next_{c}") for c in columns]))


def edited_text() -> Column:
    """The text with its last quarter replaced by as much of the next one's beginning."""
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text: str = "text", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Fingerprints of each text, of an edited version and of the next text, with their likeness.

    Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edited text is ``edited_text``; next is by ascending id, and the
    first follows the last. Null text is empty; null ids come first; rows with one id
    follow each other in the order of their digests. A text without any term of the
    lexicon is known by its own digest and is like equal texts only.
    """
    words = lexicon(docs, text, band)
    rows = with_next(in_order(docs, id_col, text), ["text"], "heads").withColumn("edited", edited_text())
    key = ["part", "place"]
    plain = rows.select(  # digests as bytes: their hex text would be twice as long in both shuffles that follow
        *key, "id", F.length("text").alias("n_chars"), F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha256"),
        F.xxhash64("text").alias("digest"), F.xxhash64("edited").alias("edited_digest"),
    )
    slots = fingerprints(rows, key, {"slots": "text", "edited_slots": "edited"}, words)
    none = F.array_repeat(F.lit(None).cast("long"), SEEDS * RATES)
    both = stored(
        plain.join(slots, key, "left").withColumns({c: F.coalesce(c, none) for c in ("slots", "edited_slots")}), "fingerprints"
    )
    near = with_next(both, ["slots", "digest"], "fingerprint-heads")
    return near.select(
        "id", F.col("n_chars").cast("long").alias("n_chars"), F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        shown(F.col("slots"), F.col("digest")).alias("fingerprint"),
        shown(F.col("edited_slots"), F.col("edited_digest")).alias("edited_fingerprint"),
        likeness(F.col("slots"), F.col("edited_slots"), F.col("digest") == F.col("edited_digest")).alias("near_edited"),
        likeness(F.col("slots"), F.col("next_slots"), F.col("digest") == F.col("next_digest")).alias("near_next"),
    )
