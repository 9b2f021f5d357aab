import numpy as np
import pytest
from pyspark.sql import functions as F

from askgrid.llm import sharding


def test_samples_follow_the_law():
    colours, size, n = np.array([5, 0, 90, 205]), 120, 4000
    rng = np.random.default_rng(1)
    drawn = np.array([sharding.hypergeometric(rng, colours, size) for _ in range(n)])
    assert (drawn.sum(axis=1) == size).all() and (drawn <= colours).all() and (drawn >= 0).all()
    total, share = colours.sum(), colours / colours.sum()
    spread = size * share * (1 - share) * (total - size) / (total - 1)
    assert (abs(drawn.mean(axis=0) - size * share) <= 5 * np.sqrt(spread / n) + 1e-9).all()
    assert np.allclose(drawn.var(axis=0), spread, rtol=0.15)
    theirs = np.random.default_rng(2).multivariate_hypergeometric(colours, size, n)
    for k in (0, 2, 3):
        assert abs(np.percentile(drawn[:, k], [5, 50, 95]) - np.percentile(theirs[:, k], [5, 50, 95])).max() <= 1


def test_samples_of_any_size():
    rng = np.random.default_rng(3)
    colours = np.array([10**15, 3 * 10**15, 7])
    drawn = sharding.hypergeometric(rng, colours, 2 * 10**15)
    assert drawn.sum() == 2 * 10**15 and abs(drawn[0] - 5 * 10**14) < 10**9 and 0 <= drawn[2] <= 7
    for size in (0, 1, 300):
        assert sharding.hypergeometric(rng, np.array([100, 200]), size).sum() == size
    with pytest.raises(ValueError):
        sharding.hypergeometric(rng, np.array([1, 2]), 4)
    matrix = sharding.communication_matrix(rng, [5, 0, 1000], sharding.even_sizes(1005, 24))
    assert matrix.sum(axis=1).tolist() == [5, 0, 1000] and (matrix.sum(axis=0) == sharding.even_sizes(1005, 24)).all()


def places(df):
    return [(r["row"], r["shard"], r["slot"]) for r in df.collect()]


@pytest.mark.parametrize("bits, size", [(16, 4096), (3, 2)])  # the second: many parts, many buckets
def test_every_row_has_one_place(docs, wide_docs, no_docs, bits, size):
    for given in (docs, wide_docs):
        found = places(sharding.shard_rows(given, 24, part_bits=bits, bucket_rows=size))
        assert sorted(map(str, (tuple(r) for r, _, _ in found))) == sorted(map(str, (tuple(r) for r in given.collect())))
        by_shard = {}
        for row, shard, slot in found:
            assert list(row.asDict()) == given.columns
            by_shard.setdefault(shard, []).append(slot)
        assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
        sizes = [len(by_shard.get(s, [])) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(found) and set(by_shard) <= set(range(24))
    assert sharding.shard_rows(no_docs).count() == 0


def test_fewer_rows_than_shards_and_hot_rows(spark):
    few = spark.createDataFrame([(1, None), (None, "a"), (1, None)], "doc_id long, text string")
    assert sorted(slot for _, _, slot in places(sharding.shard_rows(few))) == [0, 0, 0]
    hot = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("the same").alias("text"))
    sizes = [r["count"] for r in sharding.shard_rows(hot).groupBy("shard").count().collect()]
    assert sizes == [125] * 24


def test_places_are_uniform(spark):
    """Each row's shard and each pair of neighbours over many seeds: chi-square within its usual range."""
    given = spark.range(0, 64, 1, 4).select(F.col("id").alias("doc_id"))
    together, counts, slots, n = 0, np.zeros((64, 4)), np.zeros((64, 16)), 40
    for seed in range(n):
        found = {row[0]: (shard, slot) for row, shard, slot in places(sharding.shard_rows(given, 4, seed, part_bits=3, bucket_rows=4))}
        for i, (shard, slot) in found.items():
            counts[i, shard] += 1
            slots[i, slot] += 1
        together += sum(found[i][0] == found[i + 1][0] for i in range(63))
    chi = ((counts - n / 4) ** 2 / (n / 4)).sum()
    assert 120 < chi < 270  # 192 degrees of freedom, spread 20
    chi = ((slots - n / 16) ** 2 / (n / 16)).sum()
    assert 760 < chi < 1160  # 960, spread 44
    assert abs(together / (63 * n) - 15 / 63) < 0.04
    assert len({str(places(sharding.shard_rows(given, 4, seed).orderBy("shard", "slot"))) for seed in (1, 1, 2)}) == 2
