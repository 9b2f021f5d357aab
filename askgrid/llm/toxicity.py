"""Toxicity by a classifier chain.

Categories are predicted one after the other. The linear model of a category sees the
text's features and the probabilities of the categories before it; for its training
these come from models that did not see the row (out-of-fold), for scoring from the
models of the whole sample. What the threshold is set by comes from whole chains, each fitted
without the rows that it is asked about. Features are the words and word beginnings that speak most
clearly for toxic texts in the sample, found by counting, and a few shares of signs.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.common import free_name, plain_words, text_bytes, written

#: The default categories in the order of the chain, as conditions on the labels; the last one decides.
CHAIN = {"junk": "quality = 0", "toxic_junk": "toxic = 1 AND quality = 0", "toxic": "toxic = 1"}
FOLDS = 5
STYLES = 5
BEGINNINGS = (4, 5)

_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_PLAIN = bytes([*range(48, 58), 32, 10, 46, 44, *_LETTERS])


def features(words: set[bytes]) -> set[bytes]:
    """Words, and beginnings of longer words (marked by a star)."""
    found = set(words)
    for n in BEGINNINGS:
        found.update(w[:n] + b"*" for w in words if len(w) > n)
    return found


def style(data: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Shares of capitals, of unusual signs and of repeated words, length of words and text."""
    letters = len(data) - len(data.translate(None, _LETTERS))
    upper = len(data) - len(data.translate(None, _UPPER))
    odd = len(data.translate(None, _PLAIN))
    n = max(1, len(words))
    return [upper / max(1, letters), odd / max(1, len(data)), 1 - distinct / n, min(4.0, letters / n / 5), np.log1p(n) / 10]


@dataclass
class Chain:
    """A fitted chain: weights per category over constant, marks, style and earlier probabilities."""

    marks: dict[bytes, int] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    threshold: float = 1.0
    long_marks: tuple[int, ...] = BEGINNINGS
    categories: tuple[str, ...] = tuple(CHAIN)

    def rows(self, data: bytes) -> tuple[list[int], list[float]]:
        words = plain_words(data)
        distinct = set(words)
        marks, found = self.marks, set()
        for w in distinct:
            if w in marks:
                found.add(marks[w])
            for n in self.long_marks:
                if len(w) > n and (m := marks.get(w[:n] + b"*")) is not None:
                    found.add(m)
        return sorted(found), style(data, words, len(distinct))

    def scores(self, data: bytes) -> list[float]:
        if not self.weights:
            return [0.0] * len(self.categories)
        found, styles = self.rows(data)
        n, out = len(self.marks), []
        for weights in self.weights.values():
            z = weights[0] + weights[[1 + m for m in found]].sum() + weights[1 + n:1 + n + STYLES] @ np.array(styles)
            z += sum(w * p for w, p in zip(weights[1 + n + STYLES:], out))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return out


def _sure(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the first column isn't penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = _sure(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _plain_chain(x: np.ndarray, targets: dict[str, np.ndarray], fold: np.ndarray) -> dict[str, np.ndarray]:
    """Weights per category; each but the last also predicts every fold from the others, for those after it."""
    weights, seen, last = {}, x, list(targets)[-1]
    for name, y in targets.items():
        weights[name] = fit_logistic(seen, y)
        if name != last:
            held_out = np.full(len(y), y.mean() if len(y) else 0.0)
            for k in np.unique(fold):
                rest, own = fold != k, fold == k
                if rest.any():
                    held_out[own] = _sure(seen[own] @ fit_logistic(seen[rest], y[rest]))
            seen = np.column_stack([seen, held_out])
    return weights


def fit_chain_arrays(x: np.ndarray, targets: dict[str, np.ndarray], fold: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Weights per category, and the out-of-fold probabilities of the last one.

    For every fold a whole chain is fitted on the other folds, with inner folds among
    these, and asked about the fold: no label of a row has a part in any of its
    probabilities, neither as a target nor through an earlier category. The weights that
    are returned learn from these probabilities.
    """
    held_out = np.column_stack([np.full(len(y), y.mean() if len(y) else 0.0) for y in targets.values()])
    for k in np.unique(fold):
        rest, own = fold != k, fold == k
        if rest.any():
            chain = _plain_chain(x[rest], {n: y[rest] for n, y in targets.items()}, fold[rest])
            seen = x[own]
            for w in chain.values():
                seen = np.column_stack([seen, _sure(seen @ w)])
            held_out[own] = seen[:, x.shape[1]:]
    weights = {n: fit_logistic(np.column_stack([x, held_out[:, :c]]), y) for c, (n, y) in enumerate(targets.items())}
    return weights, held_out[:, -1]


def best_threshold(probability: np.ndarray, y: np.ndarray, precision: float, least: int) -> float:
    """The lowest threshold that keeps ``precision``, in the middle of the gap that it falls in.

    At least ``least`` rows must pass it rightly; else nothing is to be rejected, which
    a threshold above 1 does.
    """
    order = np.argsort(-probability, kind="stable")
    sorted_, hits = probability[order], np.cumsum(y[order])
    ends = np.append(sorted_[1:] < sorted_[:-1], True)  # ties pass together
    good = np.flatnonzero(ends & (hits >= precision * np.arange(1, len(y) + 1)) & (hits >= least))
    if not len(good):
        return 2.0
    # Among thresholds with as many right rows the highest: the others only let clean rows in.
    k = int(good[np.searchsorted(hits[good], hits[good[-1]])])
    after = sorted_[k + 1] if k + 1 < len(y) else 0.0
    return float((sorted_[k] + after) / 2)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text: str, rows: int, categories: dict[str, str] = CHAIN,
) -> DataFrame:
    """At most ``rows`` labelled documents, those whose id has the smallest digests: ``(id, data, c0, c1, ..)``.

    ``c0`` and so on are 0 or 1, by category. Of documents with one id the text with the
    smallest digest is taken.
    """
    marks = [f"c{k}" for k in range(len(categories))]
    says = [F.max(F.coalesce(F.expr(e).cast("int"), F.lit(0))).alias(c) for c, e in zip(marks, categories.values())]
    chosen = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*says).orderBy(F.xxhash64("id"), "id").limit(rows)
    joined = docs.select(F.col(id_col).alias("id"), text_bytes(text).alias("data")).join(F.broadcast(chosen), "id")
    one = joined.groupBy("id", *marks).agg(F.min(F.struct(F.xxhash64("data").alias("digest"), "data")).alias("low"))
    return written(one.select("id", "low.data", *marks), "labelled")


def fit_chain(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", rows: int = 20_000,
    marks: int = 128, least: int = 3, precision: float = 0.98, categories: dict[str, str] = CHAIN,
) -> Chain:
    """Fit the chain on at most ``rows`` labelled documents.

    ``categories`` are conditions on the columns of ``labels``, in the order of the
    chain; the last one decides. A condition that is null doesn't hold; of repeated labels
    one that holds is enough. ``marks`` features are chosen among those in at
    least ``least`` texts of the last category, and twice as common there as at random, by the
    likelihood ratio of their counts. The threshold is the lowest with ``precision`` among
    out-of-fold predictions. The sample's rows, marks and shares, a table of ``rows`` by
    ``marks`` numbers, are fitted on the driver. If the last category has no texts, or all,
    there is nothing to learn: the chain then gives 0 for everything and rejects nothing.
    """
    names = tuple(categories)
    columns = [f"c{k}" for k in range(len(names))]
    sample = labelled_sample(docs, labels, id_col, text, rows, categories).withColumn("toxic", F.col(columns[-1]))

    def count(batches):
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for data, bad in zip(batch.column("data"), batch.column("toxic").to_pylist()):
                (toxic if bad else clean).update(features(set(plain_words(data.as_py()))))
            keys = [*toxic, *(k for k in clean if k not in toxic)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())],
                names=["mark", "toxic", "clean"],
            )

    sizes = sample.groupBy("toxic").count().collect()
    toxic, clean = (sum(r["count"] for r in sizes if bool(r["toxic"]) == bad) for bad in (True, False))
    if not toxic or not clean:
        return Chain(categories=names)
    counts = sample.mapInArrow(count, "mark binary, toxic long, clean long").groupBy("mark").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c, share = F.col("t"), F.col("c"), toxic / (toxic + clean)
    surprise = t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0)
    often = counts.where((t >= least) & (t > 2 * share * (t + c)))
    chosen = often.orderBy(F.desc(surprise), "mark").limit(marks).collect()
    chain = Chain({bytes(r["mark"]): k for k, r in enumerate(chosen)}, categories=names)

    def lay(batches):
        for batch in batches:
            found = [chain.rows(data.as_py()) for data in batch.column("data")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", *columns)], pa.array([m for m, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64()))],
                names=["id", *columns, "marks", "style"],
            )

    kinds = ", ".join(f"{c} {sample.schema[c].dataType.simpleString()}" for c in ("id", *columns))
    laid = sample.mapInArrow(lay, kinds + ", marks array<int>, style array<double>")
    laid = laid.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS))).orderBy(F.xxhash64("id"), "id").collect()
    x = np.zeros((len(laid), 1 + len(chosen) + STYLES))
    x[:, 0] = 1
    for k, r in enumerate(laid):
        x[k, [1 + m for m in r["marks"]]] = 1
        x[k, 1 + len(chosen):] = r["style"]
    targets = {n: np.array([float(r[c]) for r in laid]) for n, c in zip(names, columns)}
    chain.weights, last = fit_chain_arrays(x, targets, np.array([r["fold"] for r in laid]))
    chain.threshold = best_threshold(last, targets[names[-1]], precision, least)
    return chain


def score_toxicity(docs: DataFrame, chain: Chain, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with ``name``: a struct of the categories' probabilities and ``rejected``, whether the last one passes the threshold.

    Null text counts as empty. Whole texts are scored; all other columns stay, one called
    ``name`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("array<double>")
    def scores(data):
        import pandas as pd

        fitted = held.value
        return pd.Series([fitted.scores(x) for x in data], index=data.index)

    own = free_name("p", docs)
    p = F.col(own)
    parts = [F.get(p, F.lit(k)).alias(c) for k, c in enumerate(chain.categories)]
    rejected = (F.get(p, F.lit(len(chain.categories) - 1)) >= F.lit(chain.threshold)).alias("rejected")
    return docs.withColumn(own, scores(text_bytes(text))).withColumn(name, F.struct(*parts, rejected)).drop(own)


def without_toxic(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The rows that the chain doesn't reject, with all their columns."""
    own = free_name("toxicity", docs)
    return score_toxicity(docs, chain, text, own).where(~F.col(f"{own}.rejected")).drop(own)
