import base64
import random

import public_tokenizers
import pytest
import tiktoken

from askgrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(docs, rows, library):
    found = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(k).encode() for k in range(5000)]
    made = bpe.PerfectHash(keys)
    assert sorted(made.slots) == list(range(5000))
    assert [made.find(k) for k in keys] == list(range(5000))
    assert all(made.find(str(k).encode()) == -1 for k in range(5000, 9000))


def test_heap_merges_long_odd_pieces(library):
    rng = random.Random(2)
    tokens = bpe.read_ranks(PATH)
    hashed = bpe.PerfectHash(tokens)
    merges = bpe.Merges(tokens, hashed)
    for n in (1, 2, 3, 50, 3000):
        piece = "".join(rng.choice("abcétheing") for _ in range(n))
        assert merges.split(piece.encode()) == library.encode_ordinary(piece) or library.encode_ordinary(piece)[0] == hashed.find(piece.encode())


def test_defined_cases(spark, wide_docs, no_docs):
    ids = spark.createDataFrame([([], 1), (None, 2), ([10**6], 3), ([-1], 4), ([None], 5)], "ids array<int>, decoded int")
    assert [r["decoded"] if r["decoded"] is None else bytes(r["decoded"]) for r in bpe.decode(ids, PATH).collect()] == [b"", None, None, None, None]
    assert bpe.decode(bpe.encode(no_docs, PATH, public_tokenizers.PATTERN), PATH).count() == 0
    wide = bpe.decode(bpe.encode(wide_docs, PATH, public_tokenizers.PATTERN), PATH)
    assert wide.columns == [c for c in wide_docs.columns if c != "ids"] + ["ids", "decoded"] and wide.where("decoded <> cast(coalesce(text, '') as binary)").count() == 0


def test_kept_columns_and_a_full_memory(spark, docs, rows, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    found = bpe.encode(docs, PATH, public_tokenizers.PATTERN, keep=["doc_id"])
    assert found.columns == ["doc_id", "ids"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=str)
    numbers = bpe.encode(spark.range(3).withColumnRenamed("id", "n"), PATH, public_tokenizers.PATTERN, text="n")
    assert [tuple(r) for r in numbers.collect()] == [(n, library.encode_ordinary(str(n))) for n in range(3)]
