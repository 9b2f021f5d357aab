"""Removal of long word runs that earlier documents have, by recompression.

Words get content digests as names. In every round, maximal runs of one symbol and
then pairs of a symbol of the left class and one of the right class are replaced by
a symbol named by the digest of what it stands for. The class of a symbol is a bit
of its name, so every task gives equal runs and pairs the same name without asking
the others, and equal substrings get the same symbols, except near their ends. For
each symbol we keep the words that decide it; a window of words always holds the same
symbols among those decided inside it, wherever it occurs. Its anchor is made of the
first two of round two if there are as many, else of the first three of round one,
else of all its words: rare enough to tell texts apart, and often the same for the
next window, so that there are half as many anchors as windows.

Spark then works in three rounds over groups of documents of constant size:
names   the anchors of each group; an anchor in a single document ends the matter;
windows the 96-bit digests of the windows with a shared anchor, and the smallest
        document of each group that has them;
cover   windows that a smaller document has cover their words.
Names travel as sorted arrays of numbers, one per pair of group and bucket: a
name is sent at most once by each group, however many documents hold it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.llm.common import NO_ID, partitions_of

WINDOW = 13
ROUNDS = 2
#: Words worked on at once, whatever the size of a group.
STEP_WORDS = 1 << 20

ZSTD = "zstd"
_M1, _M2, _RUN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _bounds(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch that starts where ``change`` is true."""
    first = np.flatnonzero(change)
    return first, np.append(first[1:], len(change))[: len(first)] - 1


def compress(names, left, right, doc, round_: int):
    """One round: symbols with the words ``[left, right)`` that decide them and their document.

    A run of equal symbols is decided by its members and both neighbours; a pair of a
    left and a right symbol by itself; a symbol that found no partner also by the
    neighbour that might have been one. At a document's ends the words beyond, which
    another document may have, would decide: such a symbol reaches out of the document.
    """
    n = len(names)
    if not n:
        return names, left, right, doc
    change = np.ones(n, dtype=bool)
    change[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    first, last = _bounds(change)
    size = last - first + 1
    with np.errstate(over="ignore"):
        run = names[first] if len(first) == n else np.where(
            size > 1, _mix(names[first] * _RUN + size.astype(np.uint64)), names[first]
        )
    # A run may go on beyond what is known of it: its neighbours decide its length.
    inner_before = (first > 0) & (doc[np.maximum(first - 1, 0)] == doc[first])
    inner_after = (last < n - 1) & (doc[np.minimum(last + 1, n - 1)] == doc[last])
    run_left = np.where(inner_before, left[np.maximum(first - 1, 0)], left[first] - 1)
    run_right = np.where(inner_after, right[np.minimum(last + 1, n - 1)], right[last] + 1)
    doc = doc[first]
    with np.errstate(over="ignore"):
        is_left = (_mix(run + _M1 * np.uint64(round_ + 1)) & np.uint64(1)).astype(bool)
    n = len(run)
    pair = np.zeros(n, dtype=bool)  # this symbol and the next
    pair[:-1] = is_left[:-1] & ~is_left[1:] & (doc[1:] == doc[:-1])
    second = np.zeros(n, dtype=bool)
    second[1:] = pair[:-1]
    first, last = _bounds(~second)
    with np.errstate(over="ignore"):
        out = np.where(pair[first], _mix(run[first] * _M1 + _mix(run[last]) * _M2), run[first])
    # A lonely left symbol is decided with its successor, a lonely right one with its predecessor.
    before = np.maximum(first - 1, 0)
    after = np.minimum(last + 1, n - 1)
    lonely = ~pair[first]
    look_back = lonely & ~is_left[first] & (doc[before] == doc[first])
    look_on = lonely & is_left[first] & (doc[after] == doc[last])
    out_left = np.where(look_back, run_left[before], run_left[first])
    out_right = np.where(look_on, run_right[after], run_right[last])
    return out, out_left, out_right, doc[first]


def window_anchors(names: np.ndarray, doc: np.ndarray, starts: np.ndarray, window: int, rounds: int) -> np.ndarray:
    """The anchor's name for each window start."""
    at = np.arange(len(names), dtype=np.int64)
    symbols = (names, at, at + 1, doc)
    anchors = np.zeros(len(starts), dtype=np.uint64)
    for k in range(rounds + 1):
        name, left, right, _ = symbols
        first = np.searchsorted(left, starts)
        take = (window, 3, 2)[min(k, 2)]
        chosen = np.flatnonzero(np.searchsorted(right, starts + window, side="right") - first >= take)
        key = np.full(len(chosen), k + 1, dtype=np.uint64)
        for t in range(take):
            with np.errstate(over="ignore"):
                key = _mix(key * _M1 + name[first[chosen] + t])
        anchors[chosen] = key
        if k < rounds:
            symbols = compress(*symbols, k)
    return anchors


def window_digests(names: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent digests of the words of each window, of 64 and 32 bits."""
    one, two = np.zeros(len(starts), dtype=np.uint64), np.zeros(len(starts), dtype=np.uint64)
    other = _mix(names ^ _M2)
    with np.errstate(over="ignore"):
        for k in range(window):
            one = one * _M1 + names[starts + k]
            two = (two ^ (two >> np.uint64(29))) * _M2 + other[starts + k]
    return _mix(one), (_mix(two) >> np.uint64(32)).astype(np.uint32)


class Windows:
    """The windows of a stretch of documents of one group."""

    def __init__(self, ids: list[int], tokens: list[list[bytes]], window: int):
        self.window = window
        counts = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.base = np.concatenate([[0], np.cumsum(counts)])
        self.names = word_names([w for words in tokens for w in words])
        self.doc = np.repeat(np.arange(len(tokens)), counts)
        self.ids = np.array(ids, dtype=np.int64)
        n = len(self.names)
        ok = np.zeros(n, dtype=bool)
        if n >= window:
            ok[: n - window + 1] = self.doc[: n - window + 1] == self.doc[window - 1:]
        self.starts = np.flatnonzero(ok)
        self.owner = self.ids[self.doc[self.starts]]

    def anchors(self, rounds: int) -> np.ndarray:
        return window_anchors(self.names, self.doc, self.starts, self.window, rounds)


def _stretches(table: pa.Table, window: int):
    """The documents of a group, some million words at a time: their words, and their windows."""
    ids, tokens, n = [], [], 0
    texts = table.column("row").combine_chunks().field("text")
    for doc, text in zip(table.column("id").to_pylist(), texts):
        words = (text.as_py() or "").encode("utf-8").split()
        ids.append(doc)
        tokens.append(words)
        n += len(words)
        if n >= STEP_WORDS:
            yield tokens, Windows(ids, tokens, window)
            ids, tokens, n = [], [], 0
    if ids:
        yield tokens, Windows(ids, tokens, window)


def _folded(keys: list[np.ndarray], ids: list[np.ndarray]):
    """Distinct rows of the sorted key columns with their smallest and largest id."""
    order = np.lexsort([ids, *keys[::-1]])
    keys, ids = [k[order] for k in keys], ids[order]
    first, last = _bounds(_changes(*keys))
    return [k[first] for k in keys], ids[first], ids[last]


def _packed(columns: list[np.ndarray]) -> bytes:
    """The columns, byte by byte of all their numbers, so that sorted and small numbers compress."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes, codec=ZSTD, asbytes=True)


def _columns(data: bytes, types: list[str]) -> list[np.ndarray]:
    n, sizes = int.from_bytes(data[:8], "little"), [np.dtype(t).itemsize for t in types]
    planes = np.frombuffer(pa.decompress(data[8:], n * sum(sizes), codec=ZSTD, asbytes=True), dtype=np.uint8)
    out, at = [], 0
    for t, size in zip(types, sizes):
        out.append(np.ascontiguousarray(planes[at:at + n * size].reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return out


def _blobs(group: int, buckets: int, key: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """The sorted keys, cut into equal ranges of the key space, each with its columns, as one row per range."""
    width = (1 << 64) // buckets + 1
    edges = np.searchsorted(key, np.array([k * width for k in range(1, buckets)], dtype=np.uint64))
    rows = {"bucket": [], "grp": [], "data": []}
    for bucket, (s, e) in enumerate(zip([0, *edges], [*edges, len(key)])):
        if e > s:
            rows["bucket"].append(bucket)
            rows["grp"].append(group)
            rows["data"].append(_packed([c[s:e] for c in columns]))
    return pa.table(rows, schema=BLOB)


BLOB = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("data", pa.binary())])
REPLY = pa.schema([("grp", pa.int32()), ("data", pa.binary())])
BLOB_DDL, REPLY_DDL = "bucket int, grp int, data binary", "grp int, data binary"


def _gathered(table: pa.Table, types: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [_columns(x.as_py(), types) for x in table.column("data")]
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(types)]
    groups = np.repeat(table.column("grp").to_numpy(), [len(p[0]) for p in parts]) if parts else np.zeros(0, np.int32)
    return columns, groups


def _replies(groups: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """One row per group with what it needs to know."""
    order = np.argsort(groups, kind="stable")
    groups, columns = groups[order], [c[order] for c in columns]
    first, last = _bounds(_changes(groups))
    data = [_packed([c[s:e + 1] for c in columns]) for s, e in zip(first, last)]
    return pa.table({"grp": groups[first].astype(np.int32), "data": data}, schema=REPLY)


def _known(table: pa.Table, types: list[str]) -> list[np.ndarray]:
    """The columns of all replies to a group, sorted by the first."""
    columns = _gathered(table, types)[0] if table.num_rows else [np.zeros(0, t) for t in types]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is known, and where."""
    if not len(known):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def _group_of(table: pa.Table) -> int:
    return table.column("grp")[0].as_py()


def _changes(*columns: np.ndarray) -> np.ndarray:
    change = np.ones(len(columns[0]), dtype=bool)
    if len(change):
        change[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return change


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS,
    groups: int | None = None,
) -> DataFrame:
    """``(row, n_words, n_removed, spans, kept)`` for each row of ``docs``, ``row`` with all its columns.

    A word is removed if a window of ``window`` consecutive words around it also
    stands, word for word, in a document with a smaller id. ``spans`` are the maximal
    removed stretches ``(start, end)`` in words from 0, the end excluded, and ``kept``
    is the other words joined by one blank. Words are runs of other than ASCII
    blanks, unchanged. Windows are judged on the input, not on what is left.

    Null text has no words; a text shorter than a window loses none. A null id counts
    as larger than all others: such rows lose words to others and take none. Rows with
    one id never take words from each other. ``groups`` is the number of groups of
    documents, by default three for each shuffle partition: each is held by one
    task, so it must grow with the data as the partitions do.
    """
    parts = partitions_of(docs)
    groups, buckets = groups or 3 * parts, parts
    row = F.struct(F.col(f"`{text}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest"))
    grouped = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), row.alias("row"),
    ).withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).repartition(parts, "grp")
    schema = T.StructType([
        grouped.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("kept", T.StringType()),
    ])

    def names(table: pa.Table) -> pa.Table:
        found = []
        for _, w in _stretches(table, window):
            anchor = w.anchors(rounds)
            moved = _changes(anchor, w.owner)
            (key,), low, high = _folded([anchor[moved]], w.owner[moved])
            found.append((key, low, high))
        key, low, high = (np.concatenate([f[k] for f in found]) for k in range(3))
        _, _, most = _folded([key], high)
        (key,), least, _ = _folded([key], low)
        return _blobs(_group_of(table), buckets, key, [key, (least != most).astype(np.uint8)])

    def shared(table: pa.Table) -> pa.Table:
        (key, several), grp = _gathered(table, ["u8", "u1"])
        order = np.argsort(key, kind="stable")
        key, several, grp = key[order], several[order].astype(bool), grp[order]
        first, last = _bounds(_changes(key))
        keep = np.repeat((first != last) | several[first], last - first + 1)
        return _replies(grp[keep], [key[keep]])

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        (known,), found = _known(right, ["u8"]), []
        if not left.num_rows or not len(known):
            return BLOB.empty_table()
        for _, w in _stretches(left, window):
            hit, _ = _among(w.anchors(rounds), known)
            found.append((*window_digests(w.names, w.starts[hit], window), w.owner[hit]))
        one, two, owner = (np.concatenate([f[k] for f in found]) for k in range(3))
        (one, two), low, high = _folded([one, two], owner)
        return _blobs(_group_of(left), buckets, one, [one, two, low, (low != high).astype(np.uint8)])

    def repeats(table: pa.Table) -> pa.Table:
        (one, two, low, several), grp = _gathered(table, ["u8", "u4", "i8", "u1"])
        order = np.lexsort([low, two, one])
        one, two, low, several, grp = one[order], two[order], low[order], several[order].astype(bool), grp[order]
        first, last = _bounds(_changes(one, two))
        least = np.repeat(low[first], last - first + 1)
        tell = (least < low) | several
        return _replies(grp[tell], [(one ^ _mix(two.astype(np.uint64)))[tell], least[tell]])

    def cover(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"n_words": [], "n_removed": [], "spans": [], "kept": []}
        known, least = _known(right, ["u8", "i8"])
        for tokens, w in _stretches(left, window) if left.num_rows else ():
            one, two = window_digests(w.names, w.starts, window)
            there, at = _among(one ^ _mix(two.astype(np.uint64)), known)
            hit = w.starts[there][least[at[there]] < w.owner[there]]
            step = np.zeros(len(w.names) + 1, dtype=np.int64)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + window, -1)
            covered = np.cumsum(step[:-1]) > 0
            for words, s, e in zip(tokens, w.base[:-1], w.base[1:]):
                gone = covered[s:e]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["spans"].append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                out["kept"].append(b" ".join(words if not len(edge) else itertools.compress(words, (~gone).tolist())).decode("utf-8"))
        kind = pa.schema([
            left.schema.field("row"), ("n_words", pa.int64()), ("n_removed", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string()),
        ])
        return pa.table({"row": left.column("row"), **out}, schema=kind)

    named = grouped.groupBy("grp").applyInArrow(names, BLOB_DDL)
    told = named.groupBy("bucket").applyInArrow(shared, REPLY_DDL)
    seen = grouped.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(windows, BLOB_DDL)
    repeated = seen.groupBy("bucket").applyInArrow(repeats, REPLY_DDL)
    found = grouped.groupBy("grp").cogroup(repeated.groupBy("grp")).applyInArrow(cover, schema)
    columns = [F.col("row.text").alias(c) if c == text else F.col(f"row.rest.`{c}`").alias(c) for c in docs.columns]
    return found.select(F.struct(*columns).alias("row"), "n_words", "n_removed", "spans", "kept")
