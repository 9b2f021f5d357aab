import random

import numpy as np

from askgrid.llm import substrings


def brute(rows, window=13):
    last = 2**63 - 1
    first, out = {}, []
    tokens = [(last if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    for key, _, words in tokens:
        for k in range(len(words) - window + 1):
            s = tuple(words[k:k + window])
            first[s] = min(first.get(s, key), key)
    for key, i, words in tokens:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k:k + window])] < key:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def found(df, **settings):
    return sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(df, **settings).collect()), key=str)


def test_rows_equal_brute_force(docs, rows):
    assert found(docs) == brute(rows)
    assert found(docs, groups=1) == brute(rows)


def test_small_alphabets_runs_and_other_windows(spark):
    rng = random.Random(5)
    bank = [" ".join(rng.choice("abcd") for _ in range(rng.randint(5, 60))) for _ in range(20)]
    texts = []
    for k in range(150):
        parts = [rng.choice([rng.choice(bank), " ".join("a" * rng.randint(1, 40)), " ".join(rng.choice(bank).split()[:20])]) for _ in range(rng.randint(0, 4))]
        texts.append((k, " ".join(parts)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for window, rounds in ((13, 2), (13, 0), (5, 2), (20, 3), (1, 1)):
        assert found(df, window=window, rounds=rounds) == brute(texts, window)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    for _ in range(200):
        window = rng.integers(0, 4, 13).astype(np.uint64)
        names = [np.concatenate([rng.integers(0, 4, a), window, rng.integers(0, 4, b)]).astype(np.uint64) for a, b in ((0, 0), (0, 9), (7, 0), (5, 8))]
        starts = [0, 0, 7, 5]
        anchors = {int(substrings.window_anchors(n, np.zeros(len(n), int), np.array([s]), 13, 3)[0]) for n, s in zip(names, starts)}
        assert len(anchors) == 1


def test_defined_cases(no_docs, wide_docs):
    assert substrings.without_repeats(no_docs).count() == 0
    got = substrings.without_repeats(wide_docs).select("row.*")
    assert got.columns == wide_docs.columns and got.count() == 90 and got.where("grp <> 'grp' or id <> 'id'").count() == 0
