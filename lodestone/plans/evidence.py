"""Queries of evidence generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evidence as ev
from lodestone.plans.catalog import query
from lodestone.sources import points, rebuilt
from lodestone.sources.shared import shared
from lodestone.sources.tables import Tables


def _uuid(name: str) -> str:
    h = f"sha1(from_hex('{ev.NAMESPACE.hex}') || ({name})::BLOB)"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


_GENERATION = f"""r AS (SELECT doc_id AS document_id, title, content_hash, {_uuid("'revision:' || doc_id || ':1:' || content_hash")} AS revision_id FROM docs_v),
    c AS (SELECT document_id, revision_id, c.seq::INT AS seq, source_start, source_end, c.text, {_uuid("'block:' || revision_id || ':' || c.seq")} AS block_id, {_uuid("'evidence:' || revision_id || ':' || c.seq")} AS evidence_id, {_uuid("'chunk:' || revision_id || ':' || c.seq")} AS chunk_id FROM r JOIN chunks_v c ON c.doc_id = r.document_id)"""


def _generation(t: Tables) -> dict[str, DataFrame]:
    docs = t.docs_v.select("doc_id", "text", "title", "content_hash", "source", F.lit(1).alias("revision_no"))
    chunks = t.chunks_of(docs, "content_hash", "revision_no").withColumnRenamed("doc_id", "document_id")
    folder = shared(t.spark, "generation")
    ev.write(ev.generation(docs.withColumnRenamed("doc_id", "document_id"), chunks), folder)
    return ev.tables(t.spark, folder)


@query(f"WITH {_GENERATION} SELECT revision_id AS id, document_id, title, content_hash AS text_hash, 'pending' AS status, {_uuid("'job:' || revision_id")} AS job_id, 'pending' AS job_status FROM r", views="docs_v chunks_v")
def evidence_revisions(t: Tables) -> DataFrame:
    """DOM-06: revisions and their jobs."""
    found = _generation(t)
    return found["revision"].join(found["job"].select(F.col("revision_id").alias("id"), F.col("id").alias("job_id"), F.col("status").alias("job_status")), "id")


@query(f"WITH {_GENERATION} SELECT block_id AS id, document_id, revision_id, seq, source_start, source_end, text FROM c", views="docs_v chunks_v")
def evidence_blocks(t: Tables) -> DataFrame:
    """DOM-06: blocks of documents."""
    return _generation(t)["block"]


@query(f"WITH {_GENERATION} SELECT evidence_id AS id, document_id, revision_id, block_id, source_start, source_end, text, sha256(text) AS text_hash, 'active' AS status FROM c", views="docs_v chunks_v")
def evidence_units(t: Tables) -> DataFrame:
    """DOM-06: pieces of evidence with the hash of their quote."""
    return _generation(t)["evidence"]


@query(f"WITH {_GENERATION} SELECT chunk_id AS id, document_id, revision_id, block_id, evidence_id, seq, source_start, source_end, text, length(text) AS token_count FROM c", views="docs_v chunks_v")
def evidence_chunks(t: Tables) -> DataFrame:
    """DOM-06: chunks, of which a character counts as a token."""
    return _generation(t)["chunk"]


@query(f"WITH {_GENERATION} SELECT revision_id, chunk_id, block_id, seq, source_start, source_end, evidence_id FROM c", views="docs_v chunks_v")
def evidence_links(t: Tables) -> DataFrame:
    """DOM-06: the links of chunks with blocks and with evidence."""
    found = _generation(t)
    return found["chunk_block"].join(found["chunk_evidence"].select("chunk_id", "evidence_id"), "chunk_id")


@query(
    """WITH n AS (SELECT count(*) AS chunks, (SELECT count(*) FROM documents) AS docs FROM chunks_v) SELECT kind, reference, CASE kind WHEN 'job' THEN docs ELSE chunks END AS total, 0::BIGINT AS orphans
    FROM n, (VALUES ('job', 'revision_id'), ('block', 'revision_id'), ('evidence', 'revision_id'), ('evidence', 'block_id'), ('chunk', 'revision_id'), ('chunk', 'block_id'), ('chunk', 'evidence_id'), ('chunk_block', 'revision_id'), ('chunk_block', 'chunk_id'), ('chunk_block', 'block_id'), ('chunk_evidence', 'revision_id'), ('chunk_evidence', 'chunk_id'), ('chunk_evidence', 'evidence_id')) v(kind, reference)""",
    views="chunks_v",
)
def evidence_orphans(t: Tables) -> DataFrame:
    """DOM-06: no row of a generation points to one that is not there."""
    return ev.orphans(_generation(t))


@query("SELECT chunk_id, doc_id, seq, sha256(text) AS text_hash, source_start, source_end FROM chunks_v", views="chunks_v")
def lifecycle_rebuild_resumed(t: Tables) -> DataFrame:
    """STM-14: chunks of all documents rebuilt in five batches, stopped after two, taken up, and read through a pointer once they are whole."""
    folder = shared(t.spark, "rebuild")
    build = lambda docs: t.chunks_of(docs).select("chunk_id", "doc_id", "seq", F.sha2("text", 256).alias("text_hash"), "source_start", "source_end")
    for most in (2, None):
        rebuilt.run(t.documents, "doc_id", build, f"{folder}/a", batches=5, most=most)
    rebuilt.publish(t.spark, f"{folder}/a", f"{folder}/current")
    return rebuilt.current(t.spark, f"{folder}/current", "chunk_id long, doc_id long, seq long, text_hash string, source_start long, source_end long")


@query(
    """WITH p AS (SELECT doc_id AS document_id, 1::BIGINT AS revision, chunk_id::VARCHAR AS point_id, sha256(text) AS payload FROM chunks_v UNION ALL SELECT doc_id, 2, chunk_id::VARCHAR, 'second ' || seq FROM chunks_v WHERE doc_id % 3 = 0 AND seq % 2 = 0 UNION ALL SELECT doc_id, 3, NULL, NULL FROM documents WHERE doc_id % 10 = 0)
    SELECT document_id, revision, point_id, payload FROM p WHERE point_id IS NOT NULL QUALIFY revision = max(revision) OVER (PARTITION BY document_id) AND document_id % 10 <> 0""",
    views="chunks_v",
)
def sink_points(t: Tables) -> DataFrame:
    """SRC-15, SRC-16: points of all chunks, a second revision of every third document with half of them (written twice), and deletes of every tenth document."""
    folder = shared(t.spark, "points")
    first = t.chunks_v.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("revision"), F.col("chunk_id").alias("point_id"), F.sha2("text", 256).alias("payload"))
    second = t.chunks_v.where("doc_id % 3 = 0 AND seq % 2 = 0").select(F.col("doc_id").alias("document_id"), F.lit(2).alias("revision"), F.col("chunk_id").alias("point_id"), F.concat(F.lit("second "), F.col("seq").cast("string")).alias("payload"))
    gone = t.documents.where("doc_id % 10 = 0").select(F.col("doc_id").alias("document_id"), F.lit(3).alias("revision"), F.lit(None).alias("point_id"), F.lit(None).alias("payload"))
    for batch, rows in (("b1", first), ("b2", second), ("b2", second), ("b3", gone)):
        points.write(rows, folder, batch)
    return points.current(t.spark, folder)
