import itertools
import random

import xxhash

from askgrid.llm import simhash
from askgrid.llm.common import components
from tests.llm.conftest import prose


def brute_print(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """prints: (id, print) -> {print: component}"""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(distinct, 2):
        if bin(a ^ b).count("1") <= 2:
            root[find(a)] = find(b)
    low = {}
    for i, p in prints:
        if i is not None:
            low[find(p)] = min(i, low.get(find(p), i))
    return {p: low.get(find(p)) for p in distinct}


def test_groups_equal_brute_force(docs, rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    groups = brute_groups(prints)
    want = sorted(((i, f"{p:016x}", groups[p]) for i, p in prints), key=str)
    got = sorted((tuple(r) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == want


def test_links_connect_what_is_close_whatever_the_bucket_size(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    near = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(60)}
    prints = sorted(near | {rng.getrandbits(64) for _ in range(50)} | {0})
    signed = [(0, p - 2**64 if p >= 2**63 else p) for p in prints]
    want = brute_groups([(k, p) for k, p in enumerate(prints)])
    for paired in (0, 5, 1000):
        links = simhash.close_links(spark.createDataFrame(signed, "family int, print long"), 2, 4, paired)
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for _, a, b in links.collect())
        roots = {r["id"] % 2**64: r["root"] % 2**64 for r in components(links.select("a", "b")).collect()}
        got = {}
        for k, p in enumerate(prints):
            r = roots.get(p, p)
            got[r] = min(k, got.get(r, k))
        assert {p: got[roots.get(p, p)] for p in prints} == want


def test_one_and_no_bit(spark):
    signed = [(0, x) for x in (0, 1, 3, 7, 1 << 40)]
    for bits, count in ((0, 0), (1, 4)):
        for paired in (0, 32):
            found = simhash.close_links(spark.createDataFrame(signed, "family int, print long"), bits, 4, paired)
            assert found.count() == count


def test_components_of_a_long_path(spark):
    path = list(range(300))
    random.Random(1).shuffle(path)
    links = spark.createDataFrame(list(zip(path, path[1:])) + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(300), 0), 1000: 1000, 1001: 1000}


def brute_kept(rows):
    """The row with the smallest (id, any text) of each group; ids that are missing come last."""
    prints = [(i, brute_print(t)) for i, t in rows]
    distinct = sorted({p for _, p in prints})
    number = {p: k for k, p in enumerate(distinct)}
    groups = brute_groups([(number[p], p) for p in distinct])
    best = {}
    for (i, t), (_, p) in zip(rows, prints):
        best.setdefault(groups[p], []).append((i is None, i or 0, t))
    return {g: min(x[:2] for x in found) for g, found in best.items()}, {g: {x[2] for x in found if x[:2] == min(y[:2] for y in found)} for g, found in best.items()}


def test_one_of_each_group_stays(spark, docs, wide_docs, no_docs, rows):
    kept = [tuple(r) for r in simhash.keep_one_of_each_group(docs).collect()]
    ids, texts = brute_kept(rows)
    assert sorted((i is None, i or 0) for i, _ in kept) == sorted(ids.values())
    assert all(any((i is None, i or 0) == ids[g] and t in texts[g] for g in ids) for i, t in kept)
    assert not {i for i, _ in kept} & set(range(100, 110)) and set(range(300, 312)) <= {i for i, _ in kept}
    names = ["low", "key", "one", "LOW_", "print"]
    wide = spark.createDataFrame([(*r, *names) for r in rows[:90]], "doc_id long, text string" + "".join(f", `{n}` string" for n in names))
    some = simhash.keep_one_of_each_group(wide)
    assert some.columns == wide.columns and {tuple(r)[2:] for r in some.collect()} == {tuple(names)}
    assert simhash.keep_one_of_each_group(wide_docs).columns == wide_docs.columns
    assert simhash.keep_one_of_each_group(no_docs).count() == simhash.simhash_groups(no_docs).count() == 0
    assert simhash.simhash_groups(wide_docs).count() == 90


def test_a_hot_row_stays_once(spark):
    hot = spark.createDataFrame([(5, "a b c d")] * 400 + [(None, "a b c d"), (4, "x y z w v")], "doc_id long, text string").repartition(6)
    assert sorted(tuple(r) for r in simhash.keep_one_of_each_group(hot).collect()) == [(4, "x y z w v"), (5, "a b c d")]
