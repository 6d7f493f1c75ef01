"""The query of composed contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import context
from lodestone.plans.catalog import query
from lodestone.sources.tables import Tables

BUDGET = 1_900
_PIECE = "'{{\"block_kind\":null,\"chunk_kind\":\"text\",\"context_ref\":\"{ref}\",\"page_end\":null,\"page_start\":null,\"position\":null,\"role\":\"{role}\",\"source_end\":' || source_end || ',\"source_start\":' || source_start || ',\"text\":' || to_json(text) || ',\"title_path\":' || to_json(path) || '}}'"
_NEAR = ", ".join(f"{{'distance': abs({f}(seq, {n}) OVER w - seq), 'side': {side}, 'nth': {n}, 'id': {f}(chunk_id, {n}) OVER w, 'j': {f}(other, {n}) OVER w}}" for n in (1, 2) for side, f in enumerate(("lag", "lead")))
_ENTRY = "'\"{ref}\":{{\"chunk_id\":\"' || {id} || '\",\"evidence_ids\":[\"e' || {id} || '\"],\"primary_evidence_id\":\"e' || {id} || '\",\"role\":\"{role}\"}}'"


def _refs(letter: str) -> str:
    side = {"p": "previous", "n": "following"}[letter]
    return f"[replace(x.j, '\"context_ref\":\"p1\"', '\"context_ref\":\"{letter}' || i || '\"') FOR x, i IN {side}]"


def _named(letter: str) -> str:
    side = {"p": "previous", "n": "following"}[letter]
    return "[" + _ENTRY.format(ref=f"{letter}' || i || '", id="x.id", role="neighbor") + f" FOR x, i IN {side}]"


@query(
    f"""WITH c AS (SELECT doc_id, chunk_id, seq, source_start, source_end, c.text, CASE WHEN seq % 7 < 4 THEN [d.source] ELSE [] END AS path, chunk_id % 11 <> 0 AS fit, d.title, '{{"lang":"' || d.lang || '","source":"' || d.source || '"}}' AS metadata FROM chunks_v c JOIN docs_v d USING (doc_id)),
    j AS (SELECT *, {_PIECE.format(ref='c0', role='current')} AS own, {_PIECE.format(ref='p1', role='neighbor')} AS other, '],"document":{{"metadata":' || metadata || ',"title":' || to_json(title) || '}},"effective_title_path":' || to_json(path) || '}}' AS whole, '],"document":{{"metadata":null,"title":' || to_json(title) || '}},"effective_title_path":' || to_json(path) || '}}' AS bare FROM c),
    n AS (SELECT *, list_sort([x FOR x IN [{_NEAR}] IF x.distance IS NOT NULL]) AS near FROM j WINDOW w AS (PARTITION BY doc_id, path, fit ORDER BY seq)),
    s AS (SELECT *, len([i FOR x, i IN near IF list_sum([length(y.j) + 1 FOR y IN near[1:i]]) + 11 + length(own) + length(whole) <= {BUDGET}]) AS stay FROM n),
    t AS (SELECT *, stay > 0 OR 11 + length(own) + length(whole) <= {BUDGET} AS keeps FROM s), k AS (SELECT *, CASE WHEN keeps THEN whole ELSE bare END AS tail, [x FOR x IN near[1:stay] IF x.side = 0] AS previous, [x FOR x IN near[1:stay] IF x.side = 1] AS following FROM t),
    r AS (SELECT *, CASE WHEN NOT fit THEN 'no_evidence' WHEN 11 + length(own) + length(tail) > {BUDGET} THEN 'too_long' ELSE 'ok' END AS status, '{{"chunks":[' || array_to_string(list_concat([own], {_refs('p')}, {_refs('n')}), ',') || tail AS context, '{{' || array_to_string(list_concat([{_ENTRY.format(ref='c0', id='chunk_id', role='current')}], {_named('n')}, {_named('p')}), ',') || '}}' AS mapping FROM k)
    SELECT chunk_id::VARCHAR AS chunk_id, status, CASE WHEN status = 'ok' THEN [x.id::VARCHAR FOR x IN previous] END AS previous, CASE WHEN status = 'ok' THEN [x.id::VARCHAR FOR x IN following] END AS following, CASE WHEN status = 'ok' THEN length(context) END AS context_chars, CASE WHEN status = 'ok' THEN keeps END AS metadata_kept,
        CASE WHEN status = 'ok' THEN sha256('{{"context_json":' || context || ',"context_mapping":' || mapping || ',"context_policy_version":"context-v1","ontology_snapshot_hash":""}}') END AS context_hash FROM r""",
    views="docs_v chunks_v",
)
def graph_context_snapshots(t: Tables) -> DataFrame:
    """DOM-11: each chunk with its neighbours under one title and its document, rendered, cut to a budget and hashed."""
    none = F.array().cast("array<string>")
    path = F.when(F.col("seq") % 7 < 4, F.array("source")).otherwise(none)
    chunk = F.col("chunk_id").cast("string")
    unknown = {c: F.lit(None).cast(kind) for c, kind in (("block_kind", "string"), ("page_start", "int"), ("page_end", "int"), ("position", "string"))}
    chunks = t.chunks_v.withColumns({"title_path": path, "path_source": F.lit("chunk"), "evidence_ids": F.when(F.col("chunk_id") % 11 != 0, F.array(F.concat(F.lit("e"), chunk))).otherwise(none), "chunk_kind": F.lit("text"), **unknown})
    metadata = F.concat(F.lit('{"lang":"'), "lang", F.lit('","source":"'), "source", F.lit('"}'))
    found = context.snapshots(chunks, t.docs_v.select("doc_id", "title", metadata.alias("metadata")), budget=BUDGET)
    return found.select("chunk_id", "status", "previous", "following", "context_chars", "metadata_kept", "context_hash")
