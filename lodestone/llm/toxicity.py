"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) stand against unlabelled text (U) whose labels, whatever they are, stay unseen.
With the class prior p, the risk of a classifier f is

    p * E_P[loss(f)] + max(0, E_U[loss(-f)] - p * E_P[loss(-f)])

and its second part is kept from going below zero, as a flexible model would otherwise make it (Kiryo et al., 2017).
The classifiers are linear over the presence of words, trained in numpy on the driver from bounded samples
(`max_positive`, `max_unlabelled` documents, `n_features` words); every document is then scored in whole on the executors.

Null or empty texts and texts without a known word get the score of the bias alone. Null ids are scored and never learned from.
Rows that repeat an id are scored each by their own text, and the id's first text alone is learned from. Very long texts
are read in whole, in runs of bytes. Of equally common words the one with the smaller hash becomes a feature first. An
empty table gives an empty result; without any positive every score is the prior. Further columns, whatever their names,
stay as they are and are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common, words


def positive_unlabelled_fit(x_p: np.ndarray, x_u: np.ndarray, prior: float, *, steps: int = 250, rate: float = 0.1, decay: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier that minimises the non-negative risk over a bootstrap of both samples."""
    rng = np.random.default_rng(seed)
    p = x_p[rng.integers(0, len(x_p), len(x_p))].astype(np.float32)
    u = x_u[rng.integers(0, len(x_u), len(x_u))].astype(np.float32)
    w, b = np.zeros(p.shape[1], np.float32), np.float32(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for step in range(1, steps + 1):
        f_p, f_u = p @ w + b, u @ w + b
        s_p, s_u = 1 / (1 + np.exp(-f_p)), 1 / (1 + np.exp(-f_u))
        negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        if negative >= 0:
            d_p, d_u = np.full(len(p), -prior / len(p), np.float32), s_u / len(u)
        else:
            d_p, d_u = prior * s_p / len(p), -s_u / len(u)
        g = np.append(d_p @ p + d_u @ u + decay * w, d_p.sum() + d_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), b - np.float32(move[-1])
    return w, float(b)


class ToxicityModel:
    """Word hashes in order, and for each classifier a weight for each of them and a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, biases: np.ndarray, prior: float) -> None:
        self.hashes, self.weights, self.biases, self.prior = hashes, weights, biases, prior

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.prior)
        if not len(self.biases):
            return out
        for first, end, data, offsets in common.slices(column):
            found, bounds = words.hash_words(data, offsets, words.LETTERS)
            total = np.tile(self.biases, (end - first, 1))
            if len(self.hashes) and len(found):
                at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
                hit = np.flatnonzero(self.hashes[at] == found)
                seen = np.unique(np.stack([np.searchsorted(bounds, hit, "right") - 1, at[hit]]), axis=1)  # presence, not count
                np.add.at(total, seen[0], self.weights[seen[1]])
            out[first:end] = (1 / (1 + np.exp(-total))).mean(axis=1)
        return out


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in common.slices(batch.column("text"), 1 << 20):
            found, bounds = words.hash_words(data, offsets, words.LETTERS)
            sets = [np.unique(found[bounds[i] : bounds[i + 1]]).view(np.int64) for i in range(end - first)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), batch.column("is_p").slice(first, end - first), lists], names=["doc_id", "is_p", "words"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, max_positive: int = 4000, max_unlabelled: int = 12000, n_features: int = 512, n_models: int = 3, folds: int = 5, held_out: int = 0) -> ToxicityModel:
    """Learns from documents outside the held-out fold. labels: doc_id, toxic; only its ones are used, and the share of ones as the prior."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & (common.fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, ones = known.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    if not ones:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0), 0.0)
    prior = min(0.5, max(1e-3, ones / n))
    order = F.xxhash64("doc_id")
    positive = known.where("toxic = 1").orderBy(order, "doc_id").limit(max_positive).select("doc_id", F.lit(True).alias("is_p"))
    unlabelled = docs.select("doc_id").where(common.fold(F.col("doc_id"), folds) != held_out).orderBy(order, "doc_id").limit(max_unlabelled).select("doc_id", F.lit(False).alias("is_p")).distinct()
    chosen = F.broadcast(positive.unionByName(unlabelled))  # max_positive + max_unlabelled rows at most
    once = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy(F.col("doc_id").cast("long").alias("doc_id"), "is_p").agg(F.min("text").alias("text"))  # an id has one row, however many the table has
    sets = once.mapInArrow(_word_sets, "doc_id long, is_p boolean, words array<bigint>")
    sets = common.saved(sets, "toxicity-sample")
    sizes = {r["is_p"]: r["count"] for r in sets.groupBy("is_p").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0), prior)
    counts = sets.select("is_p", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("is_p").alias("p"), F.count_if(~F.col("is_p")).alias("u"))
    share = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    apart = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    chosen_words = counts.where(F.col("p") + F.col("u") >= 4).orderBy(apart.desc(), "word").limit(n_features).select("word")
    hashes = np.sort(np.array([r[0] for r in chosen_words.collect()], np.int64).view(np.uint64))
    rows = sets.select("doc_id", "is_p", F.array_intersect("words", F.array(*[F.lit(int(h)) for h in hashes.view(np.int64)]) if len(hashes) else F.array().cast("array<bigint>")).alias("words")).collect()  # n_features words a row at most
    rows.sort(key=lambda r: (r["doc_id"], sorted(r["words"])))  # the same model however the rows lie
    x = np.zeros((len(rows), len(hashes)), np.uint8)
    for i, r in enumerate(rows):
        x[i, np.searchsorted(hashes, np.array(r["words"], np.int64).view(np.uint64))] = 1
    is_p = np.array([r["is_p"] for r in rows])
    fits = [positive_unlabelled_fit(x[is_p], x[~is_p], prior, seed=k) for k in range(n_models)]
    return ToxicityModel(hashes, np.stack([w for w, _ in fits], axis=1).astype(float), np.array([b for _, b in fits]), prior)


def with_score(docs: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """docs and a column `out`, the probability that the text is toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(b.column("text")))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(spark, docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(b.column("text")))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held = common.fold(F.col("doc_id"), options.get("folds", 5)) == options.get("held_out", 0)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
