import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from askgrid.llm import vector_codes

KINDS = "vec_id long, embedding array<float>, label int"


def brute(rows, entries, parts=4, rounds=4):
    """Every distance in Python integers; rows without ties among ids."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    at = [k * size // parts for k in range(parts + 1)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in zip(at, at[1:])]

    def assigned():
        out = []
        for _, v, _ in kept:
            near = []
            for p, (a, b) in enumerate(zip(at, at[1:])):
                near.append(min((sum((x - y) ** 2 for x, y in zip(v[a:b], c)), k) for k, c in enumerate(books[p])))
            out.append(near)
        return out

    for _ in range(rounds):
        codes = assigned()
        for p, (a, b) in enumerate(zip(at, at[1:])):
            for k in range(len(books[p])):
                own = [v[a:b] for (_, v, _), near in zip(kept, codes) if near[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    codes = assigned()
    errors = [sum(d for d, _ in near) for near in codes]
    of_label = {}
    for (_, _, label), e in zip(kept, errors):
        of_label[label] = of_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(
        (str(i), "".join(f"{k:02x}" for _, k in near), e, of_label[label], digest) for (i, _, label), near, e in zip(kept, codes, errors)
    )


def result(vectors, **settings):
    rows, books, at = vector_codes.compress_vectors(vectors, **settings)
    found = vector_codes.with_label_error(rows).withColumn("code", vector_codes.code_text(F.col("code"))).collect()
    digest = vector_codes.books_digest(books[-1], at)
    return sorted((str(r["id"]), r["code"], r["error"], r["label_error"], digest) for r in found)


def made(seed, n, size, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(size)] for _ in range(9)]
    rows = [(k * 3, [c + rng.gauss(0, scale / 4) for c in rng.choice(centres)], rng.choice([0, 1, None])) for k in range(n)]
    rows += [(10_000 + k, list(rows[k][1]), 1) for k in range(20)]  # copies
    rows += [(20_000 + k, list(rows[0][1]), 5) for k in range(n // 2)]  # a hot vector and label
    return [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("seed, entries, size, scale", [(1, 40, 16, 0.3), (2, 70, 9, 2.0), (3, 300, 8, 0.01), (4, 33, 12, 5000.0)])
def test_equals_brute_force(spark, seed, entries, size, scale):
    rows = made(seed, 120, size, scale)
    odd = [(1, None, 1), (2, [None] * size, 1), (4, [float("nan")] * size, 1), (5, [float("inf")] + [0.0] * (size - 1), 1), (None, [0.0] * size, None)]
    vectors = spark.createDataFrame(rows + odd, KINDS).withColumns({"id": F.lit("x"), "code": F.lit("y"), "error": F.lit(0), "its": F.lit(1)})
    assert result(vectors.repartition(5), entries=entries) == brute(rows + odd, entries)


def test_odd_tables(spark):
    assert result(spark.createDataFrame([], KINDS)) == []
    assert result(spark.createDataFrame([(1, None, 1)], KINDS)) == []
    one = spark.createDataFrame([(1, [0.5, -0.5, 0.0, 1.0], None), (2, [1.0], 3), (3, [1e30, 0.0, 0.0, 0.0], 3), (1, [0.5, -0.5, 0.0, 1.0], None)], KINDS)
    found = result(one)
    digest = hashlib.sha256(b"512,512,-512,-512,0,0,1024,1024").hexdigest()
    assert found == sorted([("1", "00000000", 0, 0, digest)] * 2 + [("2", None, None, None, digest), ("3", None, None, None, digest)], key=str) or {
        r[:3] for r in found
    } == {("1", "00000000", 0), ("2", None, None), ("3", None, None)}
    assert [r[3] for r in found if r[0] == "1"] == [0, 0]


def test_bounds_save_distances_and_lose_none(spark):
    rows = made(5, 600, 16, 0.3)
    vectors = spark.createDataFrame(rows, KINDS).coalesce(1)
    found, books, at = vector_codes.compress_vectors(vectors, entries=256)
    measured = found.agg(F.sum("measured")).first()[0]
    assert 0 < measured < 0.9 * found.count() * 4 * 8


def test_a_bound_uses_the_net_displacement():
    """An entry that went away and came back has moved by nothing since its stamp."""
    x = np.zeros((1, 2), dtype=np.int64)
    near, far, away = np.array([[1, 0]] * 32), np.array([[10, 0]] * 32), np.array([[10_000, 0]] * 32)
    books = [np.concatenate([near, b]) for b in (far, away, far)]
    bounds, stamps = np.array([[1.0, 10.0]]), np.array([[0, 0]])
    code, error, measured = vector_codes.nearest(x, np.stack(books), np.array([0]), bounds, stamps)
    assert (code[0], error[0], measured) == (0, 1, 1) and stamps.tolist() == [[2, 0]]


def test_wide_numbers_are_exact():
    x = np.array([[1 << 25, -(1 << 25)], [3, 4]], dtype=np.int64)
    e = np.array([[-(1 << 25), 1 << 25], [0, 0]], dtype=np.int64)
    assert vector_codes.squared(x, e).tolist() == [[1 << 53, 1 << 51], [(3 + (1 << 25)) ** 2 + (4 - (1 << 25)) ** 2, 25]]
