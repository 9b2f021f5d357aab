import random

import numpy as np

from askgrid.llm import toxicity
from tests.llm.conftest import prose


def made(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        words = prose(rng, rng.randint(20, 80)).split()
        for _ in range(rng.randint(2, 7) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Moron,", "vermin", "scumbag", "zerkel" + rng.choice("abcdef")]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 7 != 0), int(bad)))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = made(1500, 1)
    kinds = "doc_id long, quality int, toxic int"
    chain = toxicity.fit_chain(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, kinds))
    others, truth = made(500, 2)
    got = toxicity.score_toxicity(spark.createDataFrame(others, "doc_id long, text string"), chain).collect()
    wrong = [r["doc_id"] for r in got if r["toxicity"]["rejected"] != bool(truth[r["doc_id"]][2])]
    assert len(wrong) <= 5
    assert b"zerke*" in chain.marks
    kept = toxicity.without_toxic(spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "you moron vermin scumbag " * 9, "c")], "doc_id long, text string, toxicity string"), chain)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2] and kept.columns == ["doc_id", "text", "toxicity"]


def test_earlier_probabilities_are_out_of_fold():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(400), rng.normal(size=(400, 30))])
    y = rng.integers(0, 2, 400).astype(float)
    weights, last = toxicity.fit_chain_arrays(x, {"a": y, "b": y}, np.arange(400) % 5)
    assert len(weights["b"]) == x.shape[1] + 1
    assert np.corrcoef(last, y)[0, 1] < 0.25  # noise is not learnt by heart


def test_no_label_reaches_its_own_prediction():
    """Noise in three categories, several seeds; and a label that changes leaves its own fold's predictions alone."""
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = np.column_stack([np.ones(300), rng.normal(size=(300, 30))])
        y = rng.integers(0, 2, 300).astype(float)
        fold = np.arange(300) % 5
        _, last = toxicity.fit_chain_arrays(x, {"a": y, "b": y, "c": y}, fold)
        assert np.corrcoef(last, y)[0, 1] < 0.2
        other = np.where(fold == 2, 1 - y, y)
        _, changed = toxicity.fit_chain_arrays(x, {"a": other, "b": other, "c": other}, fold)
        assert np.array_equal(last[fold == 2], changed[fold == 2]) and not np.array_equal(last[fold == 1], changed[fold == 1])


def test_chain_equals_one_written_out():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(90), rng.normal(size=(90, 3))])
    a, b = (x[:, 1] + rng.normal(size=90) > 0).astype(float), (x[:, 2] + x[:, 1] > 0.3).astype(float)
    fold = np.arange(90) % 3
    sure = lambda m, w: 1 / (1 + np.exp(-(m @ w)))
    pa, pb = np.zeros(90), np.zeros(90)
    for k in range(3):
        rest, own = fold != k, fold == k
        inner = np.zeros(rest.sum())
        for j in set(fold[rest]):
            keep, out = fold[rest] != j, fold[rest] == j
            inner[out] = sure(x[rest][out], toxicity.fit_logistic(x[rest][keep], a[rest][keep]))
        pa[own] = sure(x[own], toxicity.fit_logistic(x[rest], a[rest]))
        wb = toxicity.fit_logistic(np.column_stack([x[rest], inner]), b[rest])
        pb[own] = sure(np.column_stack([x[own], pa[own]]), wb)
    weights, last = toxicity.fit_chain_arrays(x, {"a": a, "b": b}, fold)
    assert np.allclose(last, pb) and np.allclose(weights["a"], toxicity.fit_logistic(x, a))
    assert np.allclose(weights["b"], toxicity.fit_logistic(np.column_stack([x, pa]), b))


def test_scores_and_threshold_equal_a_dense_model(spark):
    """Scores of the query's way against the weights applied to a dense matrix."""
    rows, labels = made(400, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.fit_chain(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, chain).collect()}
    for i, text in rows:
        words = toxicity.plain_words(text.encode())
        have = toxicity.features(set(words))
        x = np.array([1.0, *[float(m in have) for m in chain.marks], *toxicity.style(text.encode(), words, len(set(words)))])
        for name, w in chain.weights.items():
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            assert abs(p - got[i][name]) < 1e-9
            x = np.append(x, p)
        assert got[i]["rejected"] == (p >= chain.threshold)


def test_own_categories_and_clashing_columns(spark):
    rows, labels = made(300, 5)
    names = ["p", "P_", "toxicity", "rejected", "data", "c0", "id"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string" + "".join(f", `{n}` string" for n in names))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, table, categories={"bad": "quality = 0 OR toxic = 1", "rude": "toxic = 1"})
    scored = toxicity.score_toxicity(docs, chain, name="verdict")
    assert scored.columns == [*docs.columns, "verdict"] and scored.schema["verdict"].dataType.names == ["bad", "rude", "rejected"]
    kept = toxicity.without_toxic(docs, chain)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {tuple(names)}


def test_nothing_to_learn(spark, docs, no_docs):
    for labels in ([], [(1, 1, 0), (2, 0, 0)], [(1, 1, 1)], [(None, 1, 1), (1, None, None)], [(1, 1, 1), (1, 1, 0), (2, 1, 0)]):
        chain = toxicity.fit_chain(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert toxicity.without_toxic(docs, chain).count() == docs.count()
        assert toxicity.score_toxicity(no_docs, chain).count() == 0


def test_repeated_ids_give_one_row_each(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "b"), (2, "b"), (3, None), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    one, two = (sorted((r["id"], bytes(r["data"]), r["c2"], 1 - r["c0"]) for r in toxicity.labelled_sample(d, labels, "doc_id", "text", 10).collect()) for d in (docs, docs.repartition(3)))
    assert [r[0] for r in one] == [1, 2, 3] and one == two
    assert one[1:] == [(2, b"b", 0, 0), (3, b"", 0, 1)]
