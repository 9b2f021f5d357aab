"""Codes for vectors: one codebook for each part, fitted in exact whole numbers.

Components become integers, vectors are cut into parts, and every part has a codebook
whose entries move for a few rounds to the means of what is assigned to them. The
nearest entry is always found exactly, but most distances needn't be computed. For
each part of a vector and each group of entries a worker keeps the smallest distance it
has measured to the group, and the round in which it did (the stamp). Since then an entry
has moved by the norm of the sum of its steps, the net displacement between the codebook of
that round and today's, which is at most the sum of the norms of the steps. As all
codebooks are kept, that displacement is known exactly, and a group whose
distance less its largest displacement exceeds the distance to the present entry can't
hold a nearer one. The other groups are measured anew.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.common import written

#: Entries of a bound's group.
GROUP = 32
#: Integers beyond this are out of range: up to it a squared distance of 1024 components fits a long.
LARGEST = 1 << 25
#: Bounds are kept as whole numbers of two bytes; a larger one is kept as this, which is a bound as well.
FAR = 65_535


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    """Each component times ``scale``, rounded down; null if one is null or not finite."""
    doubles = vector.cast("array<double>")
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(doubles, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(2.0**60)), F.lit(-(2.0**60)))).cast("long")))


def cuts(size: int, parts: int) -> list[int]:
    """Where the parts of a vector of ``size`` begin and end."""
    return [k * size // parts for k in range(parts + 1)]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by entries, as 64-bit integers."""
    if not x.size or not entries.size:
        return np.zeros((len(x), len(entries)), dtype=np.int64)
    most = int(np.abs(x).max()) + int(np.abs(entries).max())
    if x.shape[1] * most * most < 1 << 53:  # whole numbers that doubles hold exactly
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(entries)), dtype=np.int64)
    for k, e in enumerate(entries):
        out[:, k] = ((x - e) ** 2).sum(axis=1)
    return out


def nearest(x: np.ndarray, history: np.ndarray, code: np.ndarray | None, bounds: np.ndarray, stamps: np.ndarray):
    """The nearest of the last codebook's entries for one part of many vectors; ties go to the lower index.

    ``history`` is codebooks by entries by components. ``bounds`` and ``stamps`` (rows by
    groups) are updated in place; ``code`` is None before the first round. Returns codes,
    squared distances, and how many group distances were measured.
    """
    now, entries = len(history) - 1, history[-1]
    starts = range(0, len(entries), GROUP)
    best = np.full(len(x), np.iinfo(np.int64).max)
    found = np.zeros(len(x), dtype=np.int64)
    if code is None:
        todo = np.ones((len(x), len(starts)), dtype=bool)
    else:
        best = ((x - entries[code]) ** 2).sum(axis=1)
        found = code.astype(np.int64)
        # Net displacement of each group's entries since each round, rounded up.
        moved = np.sqrt(((history - entries) ** 2).sum(axis=2).astype(np.float64))
        moved = np.stack([moved[:, s:s + GROUP].max(axis=1) for s in starts], axis=1) * (1 + 1e-9)
        least = bounds - moved[stamps, np.arange(len(starts))]
        todo = least <= np.sqrt(best.astype(np.float64))[:, None] * (1 + 1e-9)
    for g, s in enumerate(starts):
        rows = np.flatnonzero(todo[:, g])
        if not len(rows):
            continue
        distance = squared(x[rows], entries[s:s + GROUP])
        low = distance.argmin(axis=1)  # the first of equal ones
        value = distance[np.arange(len(rows)), low]
        low += s
        nearer = (value < best[rows]) | (value == best[rows]) & (low < found[rows])
        best[rows] = np.where(nearer, value, best[rows])
        found[rows] = np.where(nearer, low, found[rows])
        bounds[rows, g] = np.minimum(np.floor(np.sqrt(value.astype(np.float64)) * (1 - 1e-9)), FAR)
        stamps[rows, g] = now
    return found, best, int(todo.sum())


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=kind).reshape(len(column), width)


def _lists(values: np.ndarray, kind) -> pa.Array:
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * np.int32(values.shape[1]))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind))


def assign(rows: DataFrame, books: list[np.ndarray], at: list[int]) -> DataFrame:
    """``rows`` with codes by the last of ``books`` (entries by all components) and the state for the next round.

    The state is ``code``, ``bounds`` and ``stamps``; ``error`` is the sum of the squared
    distances and ``measured`` the number of group distances that had to be computed.
    """
    size, parts = at[-1], len(at) - 1
    groups = -(-len(books[-1]) // GROUP)
    again = "code" in rows.columns
    kept = [c for c in rows.columns if c not in ("code", "bounds", "stamps", "error", "measured")]
    history = [np.stack([b[:, at[p]:at[p + 1]] for b in books]) for p in range(parts)]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = _matrix(batch.column("numbers"), size, np.int64)
            code = _matrix(batch.column("code"), parts, np.int64) if again else None
            bounds = _matrix(batch.column("bounds"), parts * groups, np.float64).copy() if again else np.zeros((n, parts * groups))
            stamps = _matrix(batch.column("stamps"), parts * groups, np.int64).copy() if again else np.zeros((n, parts * groups), dtype=np.int64)
            codes, error, measured = np.zeros((n, parts), dtype=np.int64), np.zeros(n, dtype=np.int64), 0
            for p in range(parts):
                own = slice(p * groups, (p + 1) * groups)
                codes[:, p], best, some = nearest(x[:, at[p]:at[p + 1]], history[p], None if code is None else code[:, p], bounds[:, own], stamps[:, own])
                error, measured = error + best, measured + some
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in kept], _lists(codes, pa.int16()), _lists(bounds.astype(np.int32), pa.int32()),
                    _lists(stamps.astype(np.int8), pa.int8()), pa.array(error), pa.array([measured] + [0] * (n - 1) if n else [], pa.int64()),
                ],
                names=[*kept, "code", "bounds", "stamps", "error", "measured"],
            )

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, kinds + ", code array<short>, bounds array<int>, stamps array<byte>, error long, measured long")


def _moved(rows: DataFrame, book: np.ndarray, at: list[int]) -> np.ndarray:
    """The entries' means, rounded down; entries without members stay."""
    size, parts, entries = at[-1], len(at) - 1, len(book)

    def add(batches):
        sums = np.zeros((entries, size), dtype=object)
        counts = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            x, code = _matrix(batch.column("numbers"), size, np.int64), _matrix(batch.column("code"), parts, np.int64)
            for p in range(parts):
                own = np.zeros((entries, at[p + 1] - at[p]), dtype=np.int64)
                np.add.at(own, code[:, p], x[:, at[p]:at[p + 1]])
                sums[:, at[p]:at[p + 1]] += own
                counts[p] += np.bincount(code[:, p], minlength=entries)
        part = np.repeat(np.arange(parts), np.diff(at))
        own = [(p, e, k) for k, p in enumerate(part.tolist()) for e in np.flatnonzero(counts[p]).tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([e for _, e, _ in own], pa.int32()), pa.array([k for _, _, k in own], pa.int32()),
                pa.array([str(sums[e, k]) for _, e, k in own], pa.string()), pa.array([int(counts[p, e]) for p, e, _ in own], pa.int64()),
            ],
            names=["entry", "place", "total", "n"],
        )

    partial = rows.select("numbers", "code").mapInArrow(add, "entry int, place int, total string, n long")
    sums = partial.groupBy("entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = book.copy()
    for r in sums.collect():  # as many numbers as the codebooks have
        out[r["entry"], r["place"]] = int(r["total"]) // int(r["n"])
    return out


def books_digest(book: np.ndarray, at: list[int]) -> str:
    numbers = [str(int(v)) for p in range(len(at) - 1) for row in book[:, at[p]:at[p + 1]] for v in row]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256,
    rounds: int = 4, scale: int = 1024,
) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """Codes of all vectors, the codebooks of all rounds, and where the parts are cut.

    Rows have id, ``label``, ``numbers`` (the components as integers), ``code`` (an entry
    for each part), ``error`` (squared distances to the last codebooks, summed) and
    ``measured``. Codebooks start as the parts of the rows with the smallest ids, ties by
    the numbers; with fewer rows than ``entries`` there are as many entries as rows. A mean
    is rounded down.

    Vectors that are null or hold null or non-finite components are dropped. Null ids are
    rows like others, last in order. Vectors of another length than that of the smallest
    id, or with integers beyond ``LARGEST``, keep their row with null code and error and
    don't count. Repeated rows count as often as they occur. An empty table gives no rows;
    other columns are left out.
    """
    numbers = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), whole_numbers(F.col(vector), scale).alias("numbers")).where("numbers is not null")
    rows = written(numbers, "numbers")
    in_range = F.forall("numbers", lambda x: F.abs(x) <= LARGEST)
    by_id = [F.col("id").asc_nulls_last(), F.col("numbers")]
    lowest = rows.where(in_range).orderBy(*by_id).limit(1).collect()
    size = len(lowest[0]["numbers"]) if lowest else 0
    at, usual = cuts(size, parts), in_range & (F.size("numbers") == size)
    first = rows.where(usual).orderBy(*by_id).limit(entries).collect()
    book = np.array([r["numbers"] for r in first], dtype=np.int64).reshape(len(first), size)
    odd = rows.where(~usual).select("*", F.lit(None).cast("array<short>").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(0).cast("long").alias("measured"))
    state, books = rows.where(usual), [book]
    for _ in range(rounds if first else 0):
        state = written(assign(state, books, at), "assigned")
        books.append(_moved(state, books[-1], at))
    state = assign(state, books, at).select("id", "label", "numbers", "code", "error", "measured")
    return written(state.union(odd), "codes"), books, at


def code_text(code: Column) -> Column:
    """Two hex digits for each entry's index."""
    return F.array_join(F.transform(code, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")), "")


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the sum of ``error`` over all rows with an equal label; nulls are equal.

    Errors are added before they meet by label; rows then look their sum up, so a label with
    a third of all rows is no group of any task: small sums are broadcast by Spark, large ones joined,
    and a hot label split by adaptive execution.
    """
    sums = written(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "label-errors")
    return rows.join(sums.withColumnRenamed("label", "its"), F.col("label").eqNullSafe(F.col("its")), "left").drop("its")
