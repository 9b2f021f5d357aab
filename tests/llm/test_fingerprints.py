import hashlib
import math
import re
import struct

import regex
import xxhash

from askgrid.llm import fingerprints


def test_compare_with_edited(docs, rows):
    got = fingerprints.compare_with_edited(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in order]
    want = []
    for k, t in enumerate(texts):
        quarter, following = len(t) // 4, texts[(k + 1) % len(texts)]
        edited = t[:len(t) - quarter] + following[:quarter]
        want.append((order[k][0], len(t), hashlib.sha256(edited.encode()).hexdigest()))
    # Rows with one id may follow each other in any order: compare the others.
    ids = [i for i, _ in order]
    sure = {k for k, i in enumerate(ids) if ids.count(i) == 1 and ids.count(ids[(k + 1) % len(ids)]) == 1}
    mine = {(r["id"], r["n_chars"], r["edited_sha256"]) for r in got}
    assert {want[k] for k in sure} <= mine
    of = {}
    by_id = dict(rows)
    for r in got:
        of.setdefault(by_id[r["id"]] if r["id"] is not None else None, set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    for k in range(10):
        a, b = (next(r["fingerprint"] for r in got if r["id"] == i) for i in (k, 100 + k))
        assert a == b


def test_only_spark_on_the_main_path(docs):
    plan = fingerprints.compare_with_edited(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_defined_cases(spark, no_docs, wide_docs):
    assert fingerprints.compare_with_edited(no_docs).count() == 0
    assert fingerprints.compare_with_edited(wide_docs).count() == 90
    (only,) = fingerprints.compare_with_edited(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert only["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and only["near_next"] == 1.0


def test_an_edited_text_stays_closer_than_the_next_one(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(4)
    pool = [prose(rng, 3).replace(" ", "") for _ in range(20_000)]
    texts = [(k, " ".join(rng.choice(pool) for _ in range(200))) for k in range(300)]
    got = fingerprints.compare_with_edited(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 285


def brute_slots(text, lexicon):
    """The slots of one text, written out: Spark's hashes are XXH64 over little-endian numbers, folded by seed."""

    def folded(values, start=42):
        for v in values:
            start = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed=start)
        return start

    terms = sorted(words_of(text) & lexicon, key=signed)
    slots = []
    for seed in range(fingerprints.SEEDS):
        drawn = sorted((xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=folded([t])) for t in terms), key=signed)
        for rate in range(fingerprints.RATES):
            kept = [d for d in drawn if d % (1 << rate) == 0]
            slots.append(folded(kept) if kept else None)
    return slots


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def words_of(text):
    return {xxhash.xxh64_intdigest(w.encode(), seed=42) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def brute_likeness(a, b, same):
    filled = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in filled) / len(filled) if filled else float(same)


def test_fingerprints_against_brute_force(spark):
    import random

    rng = random.Random(8)
    pool = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(pool, k=rng.choice([0, 1, 5, 40, 200]))) for _ in range(150)]
    texts[20], texts[30], texts[149] = None, texts[10], "Üben, w7 w8!"
    band = (1.0, 4.5)
    docs = spark.createDataFrame([(3 * k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["id"]: r for r in fingerprints.compare_with_edited(docs, band=band).collect()}
    plain = [t or "" for t in texts]
    counts = {}
    for t in plain:
        for w in words_of(t):
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w for w, n in counts.items() if band[0] <= math.log(len(plain) / n) <= band[1]}
    slots = [brute_slots(t, lexicon) for t in plain]
    for k, t in enumerate(plain):
        following = (k + 1) % len(plain)
        quarter = len(t) // 4
        edited = t[:len(t) - quarter] + plain[following][:quarter]
        theirs = brute_slots(edited, lexicon)
        row = got[3 * k]
        if any(slots[k]):
            assert row["fingerprint"] == "-".join("" if x is None else f"{x:x}" for x in slots[k])
        else:
            assert row["fingerprint"] == f"={xxhash.xxh64_intdigest(t.encode(), seed=42):x}"
        assert math.isclose(row["near_edited"], brute_likeness(slots[k], theirs, t == edited))
        assert math.isclose(row["near_next"], brute_likeness(slots[k], slots[following], t == plain[following]))
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_a_third_of_the_rows_without_an_id(spark):
    texts = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"alpha w{k % 50} w{k % 7}") for k in range(600)]
    got = fingerprints.compare_with_edited(spark.createDataFrame(texts, "doc_id long, text string"), band=(0.0, 7.5)).collect()
    assert len(got) == 600 and sum(r["id"] is None for r in got) == 200 and sum(r["id"] == 5 for r in got) == 201
