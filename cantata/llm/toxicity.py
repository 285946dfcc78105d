"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts count as examples; every other text is unlabelled, and a share of them (the class prior)
is toxic too. The classifier is linear, its loss logistic, and its risk

    prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1))

whose second part, the risk on negatives, is not let below zero: where it would be, the step goes the other way.

A text is its distinct words in lower case; a word is itself and its beginnings of 3 to 6 letters. The model is
fitted on about ``max_positive`` toxic and ``max_unlabelled`` unlabelled texts, chosen by hash, with the
``max_features`` features whose shares differ most in standard errors (``min_z`` at least); so it is of bounded size
whatever the input.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import checkpointed, id_and_text, trained_on
from cantata.llm.pretokens import small_slices

_WORD = re.compile(r"[^\W\d_]+")
_CACHE_LIMIT = 200_000


def words(text: str) -> set[str]:
    found = _WORD.findall(text.lower()) if len(text) < 1 << 20 else (m.group() for m in _WORD.finditer(text.lower()))  # no list of a long text's words
    return set(found)


def features(word: str) -> set[str]:
    """The word and, marked by a hyphen, its beginnings."""
    return {word, *(word[:n] + "-" for n in range(3, 7) if len(word) >= n)}


class _WordScores(dict):
    """Word to the sum of its features' weights; emptied when full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        get = self.weights.get
        self[word] = s = sum(get(f, 0.0) for f in features(word)) if len(word) > 2 else get(word, 0.0)
        return s


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        scores = _WordScores(self.weights)

        def score(text: str | None) -> float:
            z = self.bias + math.fsum(map(scores.__getitem__, words(text or "")))
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

        return score


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 3e-3) -> tuple[np.ndarray, float]:
    """Weights and bias from documents given as feature numbers (repeats count). Full batches, Adam.

    The bias is bounded by the prior's: a text without any feature is no likelier toxic than any text. On few examples
    the risk alone leaves it loose.
    """
    docs = [*positive, *unlabelled]
    column = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    is_p = np.arange(len(docs)) < len(positive)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    w, b = np.zeros(n_features + 1), math.log(prior / (1 - prior))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = b
    softplus = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        f = np.bincount(row, weights=w[column], minlength=len(docs)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        negatives = softplus(f[~is_p]).sum() / n_u - prior * softplus(f[is_p]).sum() / n_p
        of_negatives = np.where(is_p, -prior * s / n_p, s / n_u)
        g = np.where(is_p, prior * (s - 1) / n_p, 0.0) + of_negatives if negatives >= 0 else -of_negatives
        gradient = np.append(np.bincount(column, weights=g[row], minlength=n_features), g.sum())
        gradient[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[-1] = min(w[-1], b)
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
    max_positive: int = 4000,
    max_unlabelled: int = 8000,
    max_features: int = 2000,
    min_z: float = 4.0,
) -> ToxicityModel:
    """Learn from docs and labels (those that the caller lets in). labels is about as large as docs at most.

    The prior is the share of toxic ones among the labels unless given. Without a toxic example every score is the
    prior's (or 0.01 if there are no labels at all).
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if prior is None:
        prior = min(0.9, max(0.001, toxic / n)) if n else 0.01
    if not toxic:
        return ToxicityModel({}, math.log(prior / (1 - prior)))
    texts = id_and_text(docs, id_col, text_col)
    total = texts.count()
    chosen = lambda share, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < min(1.0, share) * (1 << 20)
    positive_ids = known.filter("toxic = 1").filter(chosen(max_positive / toxic, 1)).select("doc_id").distinct()
    positive = texts.join(F.broadcast(positive_ids), "doc_id", "left_semi")  # about max_positive ids
    unlabelled = texts.filter(chosen(max_unlabelled / max(1, total), 2))
    both = positive.select("text", F.lit(1).alias("p")).unionByName(unlabelled.select("text", F.lit(0).alias("p")))
    sample = checkpointed(both.dropDuplicates(["p", "text"]))  # copies would pass for evidence

    def count(batches):
        seen = [Counter(), Counter()]
        for batch in batches:
            for flags, texts_ in small_slices(batch.select(["p", "text"])):
                for p, text in zip(flags, texts_, strict=True):
                    seen[p].update(set().union(*map(features, words(text))) if text else ())
        for p in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(seen[p]), pa.int32()), pa.array(list(seen[p]), pa.string()), pa.array(list(seen[p].values()), pa.int64())], names=["p", "feature", "n"])

    counts = sample.mapInArrow(count, "p int, feature string, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("p") == 1, F.col("n")).otherwise(0)).alias("np"), F.sum(F.when(F.col("p") == 0, F.col("n")).otherwise(0)).alias("nu")
    )
    sizes = {r["p"]: r["count"] for r in sample.groupBy("p").count().collect()}
    p_share, u_share = F.col("np") / max(1, sizes.get(1, 0)), F.col("nu") / max(1, sizes.get(0, 0))
    pooled = (F.col("np") + F.col("nu")) / max(1, sum(sizes.values()))
    noise = F.sqrt(pooled * (1 - pooled) * (1 / max(1, sizes.get(1, 0)) + 1 / max(1, sizes.get(0, 0))))
    told = counts.filter("np + nu >= 4").withColumn("z", F.abs(p_share - u_share) / (noise + 1e-12)).filter(F.col("z") >= min_z)
    names = [r[0] for r in told.orderBy(F.desc("z"), "feature").limit(max_features).select("feature").collect()]
    number = {f: i for i, f in enumerate(names)}

    def encode(batches):
        for batch in batches:
            for flags, texts_ in small_slices(batch.select(["p", "text"])):
                found = [[number[f] for w in sorted(words(t or "")) for f in features(w) if f in number] for t in texts_]
                yield pa.RecordBatch.from_arrays([pa.array(flags, pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["p", "found"])

    rows = sample.mapInArrow(encode, "p int, found array<int>").collect()  # the sample's numbers, not texts
    parts = [[np.asarray(f, dtype=np.int64) for f in sorted(r["found"] for r in rows if r["p"] == p)] for p in (1, 0)]
    if not parts[0] or not names:
        return ToxicityModel({}, math.log(prior / (1 - prior)))
    weights, bias = fit_nnpu(parts[0], parts[1], len(names), prior)
    return ToxicityModel({f: float(x) for f, x in zip(names, weights, strict=True)}, bias)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, score (0 to 1). A null text scores as an empty one: the bias alone.

    Each row, repeated and null ids included, is scored by its own text. An empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # max_features weights

    def run(batches):
        of = shipped.value.scorer()
        for batch in batches:
            for ids, texts in small_slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(of, texts)), pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def fit_on_training_part(docs: DataFrame, labels: DataFrame, **options) -> ToxicityModel:
    return fit(docs.filter(trained_on()), labels.filter(trained_on()), **options)
