"""One generation of evidence: a revision and a job of each document, and of each of its chunks a block, a piece of evidence, the chunk and two links.

All rows of a generation come from one pass, with ids derived from their content (so that a second run makes the same ones),
and are written by one job, a folder for each kind. The job's commit is the generation's: until it is there, none is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scores

#: Ids are named in the public namespace of URLs.
NAMESPACE = uuid.NAMESPACE_URL
#: What each kind of row has, and what its references point to.
COLUMNS = {
    "revision": ("id", "document_id", "title", "text_hash", "status"), "job": ("id", "document_id", "revision_id", "status"),
    "block": ("id", "document_id", "revision_id", "seq", "source_start", "source_end", "text"),
    "evidence": ("id", "document_id", "revision_id", "block_id", "source_start", "source_end", "text", "text_hash", "status"),
    "chunk": ("id", "document_id", "revision_id", "block_id", "evidence_id", "seq", "source_start", "source_end", "text", "token_count"),
    "chunk_block": ("revision_id", "chunk_id", "block_id", "seq", "source_start", "source_end"), "chunk_evidence": ("revision_id", "chunk_id", "evidence_id", "seq"),
}
ROW = "kind string, id string, document_id long, revision_id string, block_id string, evidence_id string, chunk_id string, seq int, source_start long, source_end long, title string, text string, text_hash string, token_count long, status string"


def _id(kind: str, *parts: Column) -> Column:
    return scores.uuid5(NAMESPACE.bytes, F.concat_ws(":", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _rows(source: DataFrame, kinds: tuple[str, ...], given: dict[str, dict[str, Column]]) -> DataFrame:
    names = [c.split(" ") for c in ROW.split(", ")]

    def row(kind: str) -> Column:
        values = {c: given[kind].get(c, F.col(c)) for c in COLUMNS[kind]} | {"kind": F.lit(kind)}
        return F.struct(*[(values[n] if n in values else F.lit(None)).cast(t).alias(n) for n, t in names])

    return source.select(F.inline(F.array(*map(row, kinds))))


def generation(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows of a generation, all kinds in one table (ROW). docs: document_id, revision_no, content_hash, title; chunks: document_id, revision_no, content_hash, seq, source_start, source_end, text.

    A document without chunks has a revision and a job only. Rows without a document id take no part; rows that repeat a
    document or a chunk come out as often, with the same ids. A null text is an empty one.
    """
    revision = _id("revision", F.col("document_id"), F.col("revision_no"), F.col("content_hash"))
    d = docs.where("document_id IS NOT NULL").withColumn("revision_id", revision)
    heads = _rows(d, ("revision", "job"), {"revision": {"id": F.col("revision_id"), "text_hash": F.col("content_hash"), "status": F.lit("pending")}, "job": {"id": _id("job", F.col("revision_id")), "status": F.lit("pending")}})
    c = chunks.where("document_id IS NOT NULL").withColumns({"revision_id": revision, "text": F.coalesce("text", F.lit(""))})
    c = c.withColumns({f"{kind}_id": _id(kind, F.col("revision_id"), F.col("seq")) for kind in ("block", "evidence", "chunk")})
    own = {kind: {"id": F.col(f"{kind}_id"), "text_hash": F.sha2("text", 256), "status": F.lit("active"), "token_count": F.length("text")} for kind in ("block", "evidence", "chunk")}
    return heads.unionByName(_rows(c, ("block", "evidence", "chunk", "chunk_block", "chunk_evidence"), own | {"chunk_block": {}, "chunk_evidence": {}}))


def committed(spark: SparkSession, folder: str) -> bool:
    """Whether a generation's job has ended well."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def write(rows: DataFrame, folder: str) -> bool:
    """Writes a generation by one job; false if it is there already. What a run that failed has left is replaced."""
    if committed(rows.sparkSession, folder):
        return False
    rows.write.partitionBy("kind").mode("overwrite").parquet(folder)
    return True


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a generation that is whole, by kind; else an error."""
    if not committed(spark, folder):
        raise ValueError(f"no whole generation in {folder}")
    rows = spark.read.schema(ROW).parquet(folder)
    return {kind: rows.where(F.col("kind") == kind).select(*columns) for kind, columns in COLUMNS.items()}


def orphans(found: dict[str, DataFrame]) -> DataFrame:
    """kind, reference, total and orphans: of each kind's references how many there are and how many point nowhere."""
    out = None
    for kind, columns in COLUMNS.items():
        for reference in [c for c in columns if c.endswith("_id") and c != "document_id"]:
            there = found[reference.removesuffix("_id")].select(F.col("id").alias(reference)).distinct().withColumn("there", F.lit(True))
            part = found[kind].select(reference).join(there, reference, "left").agg(F.lit(kind).alias("kind"), F.lit(reference).alias("reference"), F.count("*").alias("total"), F.count_if(F.col("there").isNull()).alias("orphans"))
            out = part if out is None else out.unionByName(part)
    return out
