"""Token ids as flat binary files.

A store is a folder of shards. Shard ``k`` has ``ids-k.bin``, unsigned little-endian
integers without any header (16 bits wide if the vocabulary allows, else 32), ``offsets-k.bin``, unsigned 64-bit positions in that file of
the start of each document and of the end, and ``docs-k.bin``, the documents' signed
64-bit ids. Shards are ranges of ascending ids; the number of ids before a shard, its
base, is the prefix sum of the counts of those before it.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from itertools import accumulate, chain, compress, repeat
from operator import is_
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from askgrid.llm.common import NO_ID, of_worker, partitions_of

#: Pieces whose ids a worker remembers; it only saves time.
REMEMBERED = 800_000
#: Texts encoded at once, and pieces on a line.
TEXTS, LINE = 200, 5000
#: A store is written in pieces of this many bytes.
CHUNK = 8 << 20
# A mark that ends a word before a blank is a token of its own, so a blank may part them.
_END_MARK = re.compile(rb"(?<=[a-z])([.,!?;:]+)(?=[ \n]|$)")
# How a tokenizer's file spells a cut into runs that hold no white space, letters
# apart from other signs, and what may stand before it without looking past a blank.
_CUTS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def _steps(part: dict | None, name: str) -> list[dict]:
    """A pipeline's steps, whether it is a sequence, a single step or missing."""
    return [] if part is None else part[name] if part["type"] == "Sequence" else [part]


def width_of(tokenizer: Tokenizer, end: int) -> int:
    """Bytes of an id: two if the vocabulary allows, else four."""
    return 2 if max(tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4


class WordTokenizer:
    """A ``tokenizers`` tokenizer applied to pieces of a text between blanks, where its file allows it.

    It does if the file's own cut drops white space and parts letters from signs, and what it
    does before looks at no blank's other side: then no token spans a blank. Letters A-Z are
    lower-cased before only if the file lower-cases. New pieces are encoded by the library, many on a
    line, and told apart by where their tokens begin. Added tokens may be matched before all that, so
    texts with the spelling of one, in any case, are encoded whole, and so is every text with any other
    tokenizer.
    """

    def __init__(self, path: str, end: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.width = width_of(self.tokenizer, end)
        self.known: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        normal, cuts = _steps(parts.get("normalizer"), "normalizers"), _steps(parts.get("pre_tokenizer"), "pretokenizers")
        self.lowers = {"type": "Lowercase"} in normal
        plain = all(parts.get(k) is None for k in ("truncation", "padding")) and not parts["model"].get("dropout")
        self.by_words = plain and cuts == _CUTS and all(step in _NORMAL for step in normal)
        added = [t.content.encode("utf-8").lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added)) if added else rb"(?!)")

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Token ids as the library gives them."""
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=f"<u{self.width}").tobytes() for t in texts]

    def encoded_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of pieces without blanks."""
        out, texts = [], [w.decode("utf-8") for w in words]
        for k in range(0, len(texts), LINE):
            line = texts[k:k + LINE]
            found = self.tokenizer.encode(" ".join(line), add_special_tokens=False)
            ids = np.array(found.ids, dtype=f"<u{self.width}").tobytes()
            starts = np.cumsum([0, *(len(t) + 1 for t in line)])
            begins = np.fromiter((s for s, _ in found.offsets), dtype=np.int64, count=len(found.ids))
            at = (np.searchsorted(begins, starts) * self.width).tolist()
            out += [ids[s:e] for s, e in zip(at, at[1:])]
        return out

    @staticmethod
    def of_worker(path: str, end: int) -> WordTokenizer:
        """One for all tasks that a worker runs: it keeps what it has seen."""
        return of_worker(f"words|{path}|{end}", lambda: WordTokenizer(path, end))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self.encoded(texts)
        data = [t.encode("utf-8") for t in texts]
        lower = [t.lower() for t in data]
        whole = [k for k, t in enumerate(lower) if self.added.search(t)]
        pieces = [_END_MARK.sub(rb" \1", t).split() for t in (lower if self.lowers else data)]
        for k in whole:
            pieces[k] = []
        flat = list(chain.from_iterable(pieces))
        found = list(map(self.known.get, flat))
        missing = list(compress(range(len(flat)), map(is_, found, repeat(None))))
        new = list({flat[k] for k in missing})
        ids = dict(zip(new, self.encoded_words(new)))
        for k in missing:
            found[k] = ids[flat[k]]
        if len(self.known) < REMEMBERED:  # frequent pieces come early: once full, what is kept stays
            self.known.update(ids)
        ends = list(accumulate(map(len, pieces), initial=0))
        out = [b"".join(found[s:e]) for s, e in zip(ends, ends[1:])]
        for k, own in zip(whole, self.encoded([texts[k] for k in whole])):
            out[k] = own
        return out


def local_path(path: str) -> str | None:
    """The path on a mounted file system, None for other stores."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    local = local_path(path)
    return (fs.LocalFileSystem(), local) if local is not None else fs.FileSystem.from_uri(path)


class Shard:
    """The three files of one shard, written under names of their own and moved when whole.

    A task that runs again, or twice, writes the same bytes; whoever ends last wins.
    """

    def __init__(self, folder: str, number: int, width: int):
        self.files, self.base = opened(folder)
        self.number, self.mine, self.width = number, uuid.uuid4().hex, width
        self.names = [f"{self.base}/{kind}-{number:06d}.bin" for kind in ("ids", "offsets", "docs")]
        self.ids = self.files.open_output_stream(f"{self.names[0]}.{self.mine}", buffer_size=CHUNK)
        self.offsets, self.docs, self.count = [np.zeros(1, "<u8")], [], 0

    def add(self, docs: np.ndarray, tokens: list[bytes]) -> None:
        sizes = np.array([len(t) for t in tokens], dtype=np.uint64) // np.uint64(self.width)
        self.offsets.append((np.uint64(self.count) + np.cumsum(sizes)).astype("<u8"))
        self.docs.append(docs.astype("<i8"))
        self.count += int(sizes.sum())
        self.ids.write(b"".join(tokens))

    def close(self) -> dict:
        self.ids.close()
        for name, parts in zip(self.names[1:], (self.offsets, self.docs)):
            with self.files.open_output_stream(f"{name}.{self.mine}") as out:
                for part in parts:
                    out.write(part.tobytes())
        for name in self.names:
            self.files.move(f"{name}.{self.mine}", name)
        return {"shard": self.number, "docs": sum(map(len, self.docs)), "ids": self.count}


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end: int, id_col: str = "doc_id", text: str = "text",
    shards: int | None = None,
) -> list[tuple[int, int, int, int]]:
    """Encode ``text``, append ``end`` to each document and write a store.

    Documents are dealt to shards by ranges of ascending id (rows with one id by their
    text's digest, null ids last, stored as 2^63 - 1). Returns ``(shard, base, docs,
    ids)`` of every shard; only these sums reach the driver. Null text is empty: it is
    stored as the end mark alone. No documents make no shards.
    """
    shards = shards or partitions_of(docs)
    files, path = opened(folder)
    files.create_dir(path, recursive=True)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards, "id", "digest").sortWithinPartitions("id", "digest").select("id", "text")

    def write(batches):
        encode, shard = WordTokenizer.of_worker(tokenizer, end), None
        mark = np.array([end], f"<u{encode.width}").tobytes()
        for batch in batches:
            if batch.num_rows and shard is None:
                shard = Shard(folder, TaskContext.get().partitionId(), encode.width)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for k in range(0, batch.num_rows, TEXTS):
                texts = batch.column("text").slice(k, TEXTS).to_pylist()
                shard.add(ids[k:k + TEXTS], [t + mark for t in encode(texts)])
        if shard is not None:
            yield pa.RecordBatch.from_pylist([shard.close()], schema=pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))

    sums = sorted(tuple(r) for r in dealt.mapInArrow(write, "shard int, docs long, ids long").collect())
    out, base = [], 0
    for shard, count, ids in sums:
        out.append((shard, base, count, ids))
        base += ids
    return out


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped if its file system is mounted, else read."""
    path = local_path(folder)
    if path is not None:
        name = os.path.join(path, name)
        return np.memmap(name, dtype=kind, mode="r") if os.path.getsize(name) else np.zeros(0, kind)
    files, path = opened(folder)
    with files.open_input_file(f"{path}/{name}") as file:
        return np.frombuffer(file.read(), dtype=kind)


def read_token_files(spark: SparkSession, folder: str, shards: list[tuple[int, int, int, int]]) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of each document, from the files of a store.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the unsigned
    CRC-32 of its ids as 32-bit integers. One task reads one shard, a document at a time.
    """
    kind = "id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], kind)
    table = spark.createDataFrame(shards, "shard int, base long, docs long, ids long").repartitionByRange(len(shards), "shard")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{row['shard']:06d}.bin"
                raw, offsets, docs = (mapped(folder, f"{f}-{name}", t) for f, t in (("ids", "u1"), ("offsets", "<u8"), ("docs", "<i8")))
                if row["ids"] and len(raw) not in (2 * row["ids"], 4 * row["ids"]):
                    raise ValueError(f"shard {row['shard']} of {folder} isn't whole")
                ids = raw.view(f"<u{len(raw) // max(1, row['ids']) or 4}")
                if len(ids) != row["ids"] or len(docs) != row["docs"] or len(offsets) != len(docs) + 1 or offsets[-1] != len(ids):
                    raise ValueError(f"shard {row['shard']} of {folder} isn't whole")
                for k in range(0, len(docs), 50_000):
                    at = offsets[k:k + 50_001].astype(np.int64)
                    sums = [crc32(ids[s:e].astype("<u4")) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                    own = docs[k:k + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NO_ID), pa.array(row["base"] + at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                        names=["id", "start", "n_tokens", "ids_crc32"],
                    )

    return table.mapInArrow(read, kind)
