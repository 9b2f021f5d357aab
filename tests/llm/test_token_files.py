import json
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from askgrid.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_files_hold_what_the_library_gives(spark, docs, rows, tmp_path):
    folder = f"file://{tmp_path}/with blank"
    shards = token_files.write_token_files(docs, folder, PATH, 2, shards=4)
    assert token_files.write_token_files(docs, folder, PATH, 2, shards=4) == shards  # a second attempt changes nothing
    got = token_files.read_token_files(spark, folder, shards).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r["id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    ids = [r["id"] if r["id"] is not None else 2**63 for r in got]
    assert ids == sorted(ids)
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    assert [s[1] for s in shards] == [sum(s[3] for s in shards[:k]) for k in range(len(shards))]


def test_defined_cases(spark, no_docs, wide_docs, tmp_path):
    shards = token_files.write_token_files(no_docs, str(tmp_path / "none"), PATH, 2)
    assert shards == [] and token_files.read_token_files(spark, str(tmp_path / "none"), shards).count() == 0
    shards = token_files.write_token_files(wide_docs, str(tmp_path / "wide"), PATH, 2)
    assert token_files.read_token_files(spark, str(tmp_path / "wide"), shards).count() == 90


def test_added_tokens_in_any_case():
    texts = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "A<|StartOfText|>B end.", "x<|startoftext|>", "plain Text, no mark.", "<|endoftext |>", ""]
    library = Tokenizer.from_file(PATH)
    got = token_files.WordTokenizer(PATH, 2)(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def changed(tmp_path, name, change):
    with open(PATH, encoding="utf-8") as file:
        parts = json.load(file)
    change(parts)
    path = str(tmp_path / f"{name}.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(parts, file)
    return path


def test_other_tokenizers_are_read_from_their_files(tmp_path, rows, monkeypatch):
    """Without lower-casing, with another cut, without any: always what the library gives."""
    texts = ["Hello World. Foo", "Don't STOP... now!  Ünï\u00a0x \u0308a e\u0301 E\u0301. 3.5, ab.", "a<|endoftext|>B"] + [t or "" for _, t in rows[:60] + rows[-14:]]
    cases = {
        "as it is": (lambda p: None, True),
        "no normalizer": (lambda p: p.update(normalizer=None), True),
        "only NFC": (lambda p: p.update(normalizer={"type": "NFC"}), True),
        "stripped": (lambda p: p.update(normalizer={"type": "Strip", "strip_left": True, "strip_right": True}), False),
        "bytes with blanks": (lambda p: p.update(pre_tokenizer={"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}), False),
        "no cut": (lambda p: p.update(pre_tokenizer=None), False),
        "cut off": (lambda p: p.update(truncation={"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}), False),
    }
    for name, (change, by_words) in cases.items():
        path = changed(tmp_path, name, change)
        library, mine = Tokenizer.from_file(path), token_files.WordTokenizer(path, 2)
        assert mine.by_words == by_words, name
        for remembered in (10**6, 3):
            monkeypatch.setattr(token_files, "REMEMBERED", remembered)
            for _ in range(2):
                got = [np.frombuffer(x, "<u2").tolist() for x in mine(texts)]
                assert got == [library.encode(t, add_special_tokens=False).ids for t in texts], name
            mine.known.clear()
