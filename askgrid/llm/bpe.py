"""Byte-level BPE: a two-tier encoder and a decoder.

Tier one resolves a pre-token that is itself in the vocabulary by a minimal perfect
hash: two digests and one displacement per bucket lead to its only possible slot.
Tier two merges the bytes of other pre-tokens: a heap of the possible merges, lowest
rank and leftmost first, over a doubly linked list of parts.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.llm.common import of_worker

#: Bytes of ids collected before a batch leaves the task.
BATCH_BYTES = 16 << 20
#: Pre-tokens whose ids a worker remembers; it only saves time.
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [tokens[k] for k in range(len(tokens))]


class PerfectHash:
    """A minimal perfect hash from ``n`` byte strings to slots 0 to n - 1, each holding its id."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        found: list[list[int]] = [[] for _ in range(self.buckets)]
        for k, key in enumerate(keys):
            found[xxhash.xxh3_64_intdigest(key) % self.buckets].append(k)
        slots = [-1] * n
        self.displacement = [0] * self.buckets
        order = sorted(range(self.buckets), key=lambda b: -len(found[b]))
        free = None
        for b in order:
            if len(found[b]) > 1:
                d = 1
                while True:
                    at = [xxhash.xxh3_64_intdigest(keys[k], d) % n for k in found[b]]
                    if len(set(at)) == len(at) and all(slots[a] < 0 for a in at):
                        break
                    d += 1
                self.displacement[b] = d
                for a, k in zip(at, found[b]):
                    slots[a] = k
            elif found[b]:
                # A single key takes any free slot, named outright.
                free = free if free is not None else iter([a for a in range(n) if slots[a] < 0])
                a = next(free)
                slots[a] = found[b][0]
                self.displacement[b] = -a - 1
        self.slots, self.keys = slots, keys

    def find(self, key: bytes) -> int:
        """The id of ``key``, -1 if it isn't among the keys."""
        d = self.displacement[xxhash.xxh3_64_intdigest(key) % self.buckets]
        at = self.slots[-d - 1 if d < 0 else xxhash.xxh3_64_intdigest(key, d) % self.n]
        return at if at >= 0 and self.keys[at] == key else -1


class Merges:
    """Which two parts make a token, by their ids."""

    def __init__(self, tokens: list[bytes], hashed: PerfectHash):
        self.byte_ids = [hashed.find(bytes([b])) for b in range(256)]
        self.made = {}
        for rank, token in enumerate(tokens):
            for cut in range(1, len(token)):
                a = hashed.find(token[:cut])
                b = hashed.find(token[cut:]) if a >= 0 else -1
                if b >= 0:
                    self.made[a << 32 | b] = rank

    def split(self, piece: bytes) -> list[int]:
        """The ids of a piece: lowest rank first, leftmost first among equals."""
        ids, made = [self.byte_ids[b] for b in piece], self.made
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(made[key], k) for k in range(n - 1) if (key := ids[k] << 32 | ids[k + 1]) in made]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or made.get(ids[k] << 32 | ids[j]) != rank:
                continue  # one of the two has been merged meanwhile
            ids[k], ids[j] = rank, -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
                if (m := made.get(rank << 32 | ids[after[j]])) is not None:
                    heapq.heappush(heap, (m, k))
            if (i := before[k]) >= 0 and (m := made.get(ids[i] << 32 | rank)) is not None:
                heapq.heappush(heap, (m, i))
        return [x for x in ids if x >= 0]


class Encoder(dict):
    """From pre-token to its ids as little-endian 32-bit integers."""

    def __init__(self, hashed: PerfectHash, merges: Merges):
        super().__init__()
        self.hashed, self.merges = hashed, merges

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        found = self.hashed.find(data)
        ids = np.array([found] if found >= 0 else self.merges.split(data), dtype="<i4").tobytes()
        if len(self) < REMEMBERED:  # frequent pieces come early: once full, what is kept stays
            self[piece] = ids
        return ids


class ByteBpe:
    """A vocabulary with its tables; made once on the driver, about as large as the vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.tokens, self.pattern = read_ranks(path), pattern
        self.hashed = PerfectHash(self.tokens)
        self.merges = Merges(self.tokens, self.hashed)

    def encode_bytes(self, text: str, pieces, known: Encoder) -> bytes:
        return b"".join(map(known.__getitem__, pieces(text)))


def _batches(values: list[bytes]):
    offsets = np.concatenate([[0], np.cumsum([len(v) // 4 for v in values])]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(values))])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids", keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with the token ids of ``text`` as an array of integers, without special tokens.

    Each match of ``pattern`` is encoded by itself; a null text is empty and has no
    ids. The columns of ``keep``, or all, stay as they are; one called ``name`` is replaced. Whole
    texts are encoded, one at a time. A worker keeps what it has looked up for all its tasks.
    """
    made = ByteBpe(path, pattern)
    held = docs.sparkSession.sparkContext.broadcast(made)
    key = f"bpe|{xxhash.xxh3_64_hexdigest(b''.join(made.tokens))}|{pattern}"
    columns = [c for c in (docs.columns if keep is None else keep) if c != name]
    carried = text in columns and isinstance(docs.schema[text].dataType, T.StringType)  # one copy of the text will do
    body = [] if carried else [F.col(f"`{text}`").cast("string").alias("text")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *body)
    place = columns.index(text) if carried else -1

    def run(batches):
        bpe = held.value
        known, find = of_worker(key, lambda: (Encoder(bpe.hashed, bpe.merges), regex.compile(bpe.pattern).findall))
        for batch in batches:
            start, size, found = 0, 0, []
            for k, text in enumerate(batch.column("row").field(place) if carried else batch.column("text")):
                found.append(bpe.encode_bytes(text.as_py() or "", find, known))
                size += len(found[-1])
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(start, k + 1 - start), _batches(found)], names=["row", "ids"])
                    start, size, found = k + 1, 0, []

    out = row.mapInArrow(run, T.StructType([row.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return out.select("row.*", F.col("ids").alias(name))


def decode(docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the ids of ``ids`` stand for.

    Null ids give null, no ids empty bytes; a row with an id outside the vocabulary
    (or a null among its ids) gives null.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != name]).alias("row"), F.col(ids).alias("ids"))

    def run(batches):
        tokens = held.value
        for batch in batches:
            start, size, found = 0, 0, []
            for k, value in enumerate(batch.column("ids")):
                data = None
                if value.is_valid:
                    numbers = value.values
                    if not numbers.null_count:
                        numbers = numbers.to_numpy(zero_copy_only=False)
                        if not len(numbers) or 0 <= numbers.min() and numbers.max() < len(tokens):
                            data = b"".join(map(tokens.__getitem__, numbers.tolist()))
                found.append(data)
                size += len(data or b"")
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(start, k + 1 - start), pa.array(found, pa.binary())], names=["row", "data"])
                    start, size, found = k + 1, 0, []

    out = row.mapInArrow(run, T.StructType([row.schema["row"], T.StructField("data", T.BinaryType())]))
    return out.select("row.*", F.col("data").alias(name))
