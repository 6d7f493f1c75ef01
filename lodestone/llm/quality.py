"""Quality by compression.

Two zstandard dictionaries are trained, one from labelled good text and one from labelled bad text. A whole text is cut
into windows of `WINDOW` bytes (so that the dictionaries, not the text's own past, explain most of each) and compressed
with either. The score is a logistic function, calibrated on other labelled documents, of

    difference = (size with bad - size with good) / (size with bad + size with good)
    density    = size with good / bytes

and their squares and product: text of one word over and over is equally small with both, which density shows.

Dictionaries come from `max_windows` windows of each kind, the calibration from `max_calibration` documents of each kind:
bounded, documented samples of labelled rows. Every document is scored over all of its bytes.

Null and empty texts have difference and density 0, and the score the calibration gives these, the share of good labels.
If either label is missing or too rare for a dictionary, every score is the share of good labels (1 without labels).
Null ids are scored and never learned from; rows that repeat an id are scored each by their own text, and the first one
by order alone is learned from. Very long texts are
compressed window by window. Equal texts have equal scores. An empty table gives an empty result; further columns,
whatever their names, stay as they are and are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

WINDOW = 2048


class QualityModel:
    """Dictionaries (bytes) of good and bad text, the calibration's coefficients and the share of good labels."""

    def __init__(self, good: bytes, bad: bytes, coefficients: np.ndarray | None, share: float, level: int = 1) -> None:
        self.good, self.bad, self.coefficients, self.share, self.level = good, bad, coefficients, share, level
        self._compressors = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_compressors": None}

    def measures(self, column: pa.Array) -> np.ndarray:
        """difference and density of each text."""
        if self._compressors is None:
            made = []
            for content in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(content)
                d.precompute_compress(level=self.level)
                made.append(zstandard.ZstdCompressor(dict_data=d, level=self.level, write_checksum=False, write_content_size=False, write_dict_id=False))
            self._compressors = made
        good, bad = (c.compress for c in self._compressors)
        data, offsets = common.utf8(column)
        view, out = memoryview(data), np.zeros((len(column), 2))
        for i in range(len(column)):
            a, z = int(offsets[i]), int(offsets[i + 1])
            if z == a:
                continue
            g = w = 0
            for k in range(a, z, WINDOW):
                part = view[k : min(z, k + WINDOW)]
                g += len(good(part)) - 6  # the frame's own bytes
                w += len(bad(part)) - 6
            out[i] = (w - g) / max(1, w + g), g / (z - a)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.coefficients is None:
            return np.full(len(column), self.share)
        m = self.measures(column)
        s = 1 / (1 + np.exp(-np.clip(inputs(m) @ self.coefficients, -40, 40)))
        return np.where(m.any(axis=1), s, self.share)


def inputs(m: np.ndarray) -> np.ndarray:
    d, r = np.clip(m[:, 0] * 4, -2, 2), np.clip(m[:, 1], 0, 2)
    return np.stack([np.ones(len(m)), d, r, d * d, r * r, d * r], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients of a weighted ridge logistic regression, by Newton steps."""
    c = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -40, 40)))
        g = x.T @ (weight * (p - y)) + ridge * c
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c))
        step = np.linalg.solve(h, g)
        c = c - step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return c


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = common.utf8(batch.column("text"))
        ids, labels = batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist()
        for i, doc in enumerate(ids):
            parts = [data[k : min(offsets[i + 1], k + WINDOW)].tobytes() for k in range(offsets[i], offsets[i + 1], WINDOW)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(parts), pa.int64()), pa.array([labels[i]] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "quality", "k", "part"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, dictionary_bytes: int = 1 << 16, max_windows: int = 4000, max_documents: int = 2000, max_calibration: int = 2000, folds: int = 3, held_out: int = 1, level: int = 1) -> QualityModel:
    """Learns from labelled documents outside the held-out fold; every other one of them makes dictionaries, the rest calibrate."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & (common.fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
    flat = QualityModel(b"", b"", None, share)
    if len(counts) < 2:
        return flat
    known = known.withColumn("use", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    chosen = None
    for use, most in ((0, max_documents), (1, max_calibration)):
        for label in (0, 1):
            part = known.where((F.col("use") == use) & (F.col("quality") == label)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
            chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # 2 * (max_documents + max_calibration) ids at most
    sample = common.saved(rows.groupBy("doc_id", "quality", "use").agg(F.min("text").alias("text")), "quality-sample")  # an id has one row, however many the table has
    cut = sample.where("use = 0").select("doc_id", "quality", "text").mapInArrow(_windows, "doc_id long, quality int, k int, part binary")
    dictionaries = []
    for label in (1, 0):
        parts = [bytes(r[0]) for r in cut.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k").limit(max_windows).select("part").collect()]
        try:
            dictionaries.append(zstandard.train_dictionary(min(dictionary_bytes, max(1024, sum(map(len, parts)) // 8)), parts).as_bytes())
        except (zstandard.ZstdError, ValueError):  # too little text
            return flat
    model = QualityModel(*dictionaries, None, share, level)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = model.measures(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(m[:, 0]), pa.array(m[:, 1])], names=["quality", "difference", "density"])

    rows = sample.where("use = 1").select("quality", "text").mapInArrow(measure, "quality int, difference double, density double").collect()
    y, m = np.array([r[0] for r in rows], float), np.array([[r[1], r[2]] for r in rows]).reshape(-1, 2)
    if len(set(y)) < 2:
        return flat
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))  # the sample has the labels in other shares
    model.coefficients = logistic(inputs(m), y, weight)
    return model


def with_score(docs: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """docs and a column `out`, the probability that the text is good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(b.column("text")))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(spark, docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(b.column("text")))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held = common.fold(F.col("doc_id"), options.get("folds", 3)) == options.get("held_out", 1)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
