"""What a model is shown of a document to read one chunk: the chunk, its nearest neighbours under the same title, and the document, as canonical JSON within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.nested import canonical_json

PARTS = ("text", "title_path", "chunk_kind", "block_kind", "page_start", "page_end", "source_start", "source_end", "position")


def _json(**fields: Column) -> Column:
    return canonical_json(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}))


def _value(x: Column) -> Column:
    """A value's canonical JSON; null for a null."""
    held = _json(v=x)  # {"v":...}
    return F.substring(held, F.lit(6), F.length(held) - 6)


def _inside(held: Column) -> Column:
    """What an object's JSON text has between its braces."""
    return F.substring(held, F.lit(2), F.length(held) - 2)


def _rendered(piece: Column, ref: Column, role: str) -> Column:
    """The canonical JSON of a chunk under a name: its parts, with name and role in their places among the keys."""
    return F.concat(F.lit("{"), piece["first"], F.lit(',"context_ref":"'), ref, F.lit('",'), piece["middle"], F.lit(f',"role":"{role}",'), piece["last"], F.lit("}"))


def snapshots(chunks: DataFrame, docs: DataFrame, *, before: int = 2, after: int = 2, budget: int = 3000, policy: str = "context-v1", ontology_hash: str = "") -> DataFrame:
    """chunk_id, status, previous, following, evidence, path_source, context, context_chars, mapping, context_hash, metadata_kept: a row for each chunk.

    chunks: doc_id, chunk_id, seq (unique in a document), title_path (array; null: none), path_source, evidence_ids (array of
    the active ones, the primary one first) and the PARTS, of which position is JSON text; docs: doc_id, title, metadata
    (JSON text). Neighbours are the nearest `before` and `after` chunks of the document with the same title path that have
    evidence. While the context is longer than the budget the farthest neighbour goes, of two as far the following one; then
    the metadata; and what is still too long is "too_long". A chunk without evidence is "no_evidence". Both have no context.
    The hash is that of context, mapping, policy and ontology together. Nulls are written as such; a chunk whose document is not there has a null title and metadata.
    """
    path = F.coalesce("title_path", F.array().cast("array<string>"))
    held = lambda *names: _inside(_json(**{n: F.try_parse_json("position") if n == "position" else F.col(n) for n in names}))
    # a chunk's text is made JSON once, whatever it is shown as
    piece = F.struct(held("block_kind", "chunk_kind").alias("first"), held("page_end", "page_start", "position").alias("middle"), held("source_end", "source_start", "text", "title_path").alias("last"))
    rows = chunks.select("doc_id", F.col("chunk_id").cast("string").alias("chunk_id"), "seq", "path_source", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), path.alias("title_path"), *[c for c in PARTS if c != "title_path"])
    rows = rows.select("doc_id", "chunk_id", "seq", "path_source", "evidence_ids", "title_path", piece.alias("piece"))
    rows = rows.withColumns({"fit": F.size("evidence_ids") > 0, "chars": F.length(_rendered(F.col("piece"), F.lit("p1"), "neighbor"))})
    w = Window.partitionBy("doc_id", "title_path", "fit").orderBy("seq", "chunk_id")
    at = lambda f, n, side: F.struct(F.abs(f("seq", n).over(w) - F.col("seq")).alias("distance"), F.lit(side).alias("side"), F.lit(n).alias("nth"), f("chunk_id", n).over(w).alias("chunk_id"), f("evidence_ids", n).over(w).alias("evidence_ids"), f("chars", n).over(w).alias("chars"), f("piece", n).over(w).alias("piece"))
    near = [at(F.lag, n, 0) for n in range(1, before + 1)] + [at(F.lead, n, 1) for n in range(1, after + 1)]
    rows = rows.withColumn("near", F.array_sort(F.filter(F.array(*near), lambda x: x["distance"].isNotNull())) if near else F.array())
    about = docs.select("doc_id", _value(F.col("title")).alias("_title"), F.col("metadata").isNotNull().alias("_told"), canonical_json(F.col("metadata")).alias("_metadata"))
    rows = rows.join(about, "doc_id", "left").withColumn("own", _rendered(F.col("piece"), F.lit("c0"), "current"))

    frame = lambda metadata: F.concat(F.lit('],"document":{"metadata":'), metadata, F.lit(',"title":'), F.coalesce("_title", F.lit("null")), F.lit('},"effective_title_path":'), _value(F.col("title_path")), F.lit("}"))
    rows = rows.withColumns({"whole": frame(F.coalesce("_metadata", F.lit("null"))), "bare": frame(F.lit("null"))})
    head = F.length("own") + 11  # {"chunks":[ and the chunk
    sizes = F.transform("near", lambda x, i: F.aggregate(F.slice("near", F.lit(1), i + 1), F.lit(0), lambda total, y: total + y["chars"] + 1))
    rows = rows.withColumn("stay", F.size(F.filter(sizes, lambda s: s + head + F.length("whole") <= budget)))
    keeps = (F.col("stay") > 0) | (head + F.length("whole") <= budget)
    tail = F.when(keeps, F.col("whole")).otherwise(F.col("bare"))
    status = F.when(~F.col("fit"), "no_evidence").when(head + F.length(tail) > budget, "too_long").otherwise("ok")
    kept = F.slice("near", F.lit(1), F.col("stay"))
    side = lambda n: F.filter("kept", lambda x: x["side"] == n)
    rows = rows.withColumns({"status": status, "tail": tail, "metadata_kept": keeps & F.coalesce("_told", F.lit(False)), "kept": kept}).withColumns({"previous": side(0), "following": side(1)})

    named = lambda x, i, letter: F.concat(F.lit(letter), (i + 1).cast("string"))
    put = lambda column, letter: F.transform(column, lambda x, i: _rendered(x["piece"], named(x, i, letter), "neighbor"))
    context = F.concat(F.lit('{"chunks":['), F.array_join(F.concat(F.array("own"), put("previous", "p"), put("following", "n")), ","), "tail")
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    entry = lambda ref, chunk, ids, role: F.concat(F.lit('"'), ref, F.lit('":{"chunk_id":'), quoted(chunk), F.lit(',"evidence_ids":'), F.to_json(ids), F.lit(',"primary_evidence_id":'), quoted(F.get(ids, F.lit(0))), F.lit(f',"role":"{role}"}}'))
    others = lambda column, letter: F.transform(column, lambda x, i: entry(named(x, i, letter), x["chunk_id"], x["evidence_ids"], "neighbor"))
    mapping = F.concat(F.lit("{"), F.array_join(F.concat(F.array(entry(F.lit("c0"), F.col("chunk_id"), F.col("evidence_ids"), "current")), others("following", "n"), others("previous", "p")), ","), F.lit("}"))
    done = rows.withColumns({"context": F.when(F.col("status") == "ok", context), "mapping": F.when(F.col("status") == "ok", mapping)})
    digest = F.sha2(F.concat(F.lit('{"context_json":'), "context", F.lit(',"context_mapping":'), "mapping", F.lit(',"context_policy_version":'), _value(F.lit(policy)), F.lit(',"ontology_snapshot_hash":'), _value(F.lit(ontology_hash)), F.lit("}")), 256)
    ids = lambda c: F.when(F.col("status") == "ok", F.transform(c, lambda x: x["chunk_id"]))
    return done.select("chunk_id", "status", ids("previous").alias("previous"), ids("following").alias("following"), F.get("evidence_ids", F.lit(0)).alias("evidence"), "path_source", "context", F.length("context").alias("context_chars"), "mapping", digest.alias("context_hash"), F.when(F.col("status") == "ok", F.col("metadata_kept")).alias("metadata_kept"))
