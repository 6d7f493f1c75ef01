"""documents -> good, clean, distinct documents, packed into training batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, neardup, packing, quality, toxicity


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier scores below one half."""
    score = common.free_name(docs, "score")
    model = quality.fit(spark, docs, common.table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model, score).where(F.col(score) >= 0.5).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity classifier scores at one half or more."""
    score = common.free_name(docs, "score")
    model = toxicity.fit(spark, docs, common.table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates: five-word shingles, similarity 0.8."""
    gone = neardup.near_duplicates(docs, size=5, percent=80).where("NOT kept").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A batch for each document that is left."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_dedup", keep_one_of_each), ("packing", pack)]
#: No stage but the last two could be said in SQL; the tests hold the whole against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's output is a Parquet table in the shared folder that the next one reads."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_dir(spark)}/lodestone/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
