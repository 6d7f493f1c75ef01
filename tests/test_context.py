"""Context snapshots against a plain version that renders, trims and hashes with the standard library."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators.context import snapshots

SCHEMA = "doc_id long, chunk_id string, seq int, title_path array<string>, path_source string, evidence_ids array<string>, text string, chunk_kind string, block_kind string, page_start int, page_end int, source_start long, source_end long, position string"
FIELDS = ("text", "title_path", "chunk_kind", "block_kind", "page_start", "page_end", "source_start", "source_end", "position")


def canonical(x):
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def plain(chunks, docs, before, after, budget):
    out = {}
    for c in chunks:
        same = [x for x in chunks if x["doc_id"] == c["doc_id"] and (x["title_path"] or []) == (c["title_path"] or []) and x["evidence_ids"] and x is not c]
        previous = sorted((x for x in same if x["seq"] < c["seq"]), key=lambda x: c["seq"] - x["seq"])[:before]
        following = sorted((x for x in same if x["seq"] > c["seq"]), key=lambda x: x["seq"] - c["seq"])[:after]
        title, metadata = docs.get(c["doc_id"], (None, None))
        metadata = json.loads(metadata) if metadata else None
        if not c["evidence_ids"]:
            out[c["chunk_id"]] = ("no_evidence", None, None, None, None)
            continue

        def render(metadata, c=c, previous=previous, following=following, title=title):
            named = [("c0", c), *((f"p{i}", x) for i, x in enumerate(previous, 1)), *((f"n{i}", x) for i, x in enumerate(following, 1))]
            shown = [{"context_ref": ref, "role": "current" if ref == "c0" else "neighbor"} | {f: (x[f] or []) if f == "title_path" else json.loads(x[f]) if f == "position" and x[f] else x[f] for f in FIELDS} for ref, x in named]
            mapping = {ref: {"chunk_id": x["chunk_id"], "evidence_ids": x["evidence_ids"], "primary_evidence_id": x["evidence_ids"][0], "role": "current" if ref == "c0" else "neighbor"} for ref, x in named}
            return {"document": {"title": title, "metadata": metadata}, "effective_title_path": c["title_path"] or [], "chunks": shown}, mapping

        context, mapping = render(metadata)
        while len(canonical(context)) > budget and (previous or following):
            far = [(abs(x[-1]["seq"] - c["seq"]), k) for k, x in enumerate((previous, following)) if x]
            (previous, following)[max(far)[1]].pop()
            context, mapping = render(metadata)
        if len(canonical(context)) > budget and metadata is not None:
            context, mapping = render(None)
        if len(canonical(context)) > budget:
            out[c["chunk_id"]] = ("too_long", None, None, None, None)
            continue
        digest = hashlib.sha256(canonical({"context_json": context, "context_mapping": mapping, "context_policy_version": "v é", "ontology_snapshot_hash": "o"}).encode()).hexdigest()
        out[c["chunk_id"]] = ("ok", [x["chunk_id"] for x in previous], [x["chunk_id"] for x in following], canonical(context), digest)
    return out


def made():
    chunks, docs = [], {1: ("Title \"one\"", '{"b":[1,{"z":null,"a":"é"}],"a":"x"}'), 2: (None, None), 3: ("long", '{"more":"' + "m" * 260 + '"}')}
    for d in (1, 2, 3, 4):
        for k in range(9):
            text = None if (d, k) == (2, 3) else f"chunk {k}\n\t\"quoted\" \\ é\u0001\u001f 日本 " + "w" * (7 * k * d % 90) + ("v" * 900 if (d, k) == (1, 5) else "")
            chunks.append(dict(doc_id=d, chunk_id=f"{d}-{k}", seq=k * (1 + d % 2), title_path=[None, [], ["A", "B \"x\""]][k % 3 if d < 3 else 2], path_source="chunk", evidence_ids=[] if (d, k) == (1, 2) else None if (d, k) == (2, 1) else [f"e{k}", f"f{k}"][: 1 + k % 2], text=text, chunk_kind="text", block_kind=None if k % 2 else "paragraph", page_start=k if k % 3 else None, page_end=None, source_start=k * 10, source_end=k * 10 + 9, position='{"y":1,"x":[2]}' if k % 4 == 0 else None))
    return chunks, docs


@pytest.mark.parametrize(("before", "after", "budget"), [(2, 2, 1200), (2, 2, 100_000), (1, 3, 700), (0, 1, 500), (3, 0, 900)])
def test_same_as_plain(spark, before, after, budget):
    chunks, docs = made()
    c = spark.createDataFrame([tuple(x[f.split()[0]] for f in SCHEMA.split(", ")) for x in chunks], SCHEMA).withColumns({"near": F.lit("clash"), "own": F.lit("clash")})
    d = spark.createDataFrame([(k, *v) for k, v in docs.items()], "doc_id long, title string, metadata string")
    got = {r["chunk_id"]: (r["status"], r["previous"], r["following"], r["context"], r["context_hash"]) for r in snapshots(c, d, before=before, after=after, budget=budget, policy="v é", ontology_hash="o").collect()}
    expected = plain(chunks, docs, before, after, budget)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert got == expected


def test_a_position_that_looks_like_a_name(spark):
    chunks, docs = made()
    chunks = [x | {"position": '{"context_ref":"p1"}'} for x in chunks if x["doc_id"] == 1]
    c = spark.createDataFrame([tuple(x[f.split()[0]] for f in SCHEMA.split(", ")) for x in chunks], SCHEMA)
    d = spark.createDataFrame([(k, *v) for k, v in docs.items()], "doc_id long, title string, metadata string")
    got = {r["chunk_id"]: r["context"] for r in snapshots(c, d, budget=100_000).collect()}
    assert got == {k: v[3] for k, v in plain(chunks, docs, 2, 2, 100_000).items()}
    assert any('"context_ref":"p2"' in x for x in got.values() if x)
