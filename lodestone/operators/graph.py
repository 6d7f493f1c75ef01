"""The property graph: candidates from occurrences, confidence routes, publication, bounded traversal, evidence, entity linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scores
from lodestone.functions import text as tx
from lodestone.operators.candidates import lexical_candidates
from lodestone.sources.shared import saved
from lodestone.sources.tables import dealt

#: A cap of so many relations cuts no hub that is worth putting in order first.
_WIDE = 1 << 20


def entity_candidates(occurrences: DataFrame, key: str) -> DataFrame:
    """One row for each key: the payload of the first occurrence that has one, the greatest confidence, how many there are. occurrences: key, unit, ref, payload, confidence."""
    first = F.when(F.col("payload").isNotNull(), F.struct(F.col("unit").isNull(), "unit", "ref"))  # a row whose place is null is passed over
    return occurrences.groupBy(key).agg(F.min_by("payload", first).alias("payload"), F.max("confidence").alias("confidence"), F.count("*").alias("occurrences"))


def aliases(names: DataFrame, key: str) -> DataFrame:
    """The smallest original of each normal form, in order."""
    per_form = names.groupBy(key, tx.graph_name(F.col("name")).alias("form")).agg(F.min("name").alias("name"))
    return per_form.groupBy(key).agg(F.array_sort(F.collect_list("name")).alias("aliases"))


def property_values(rows: DataFrame, key: str) -> DataFrame:
    """key, property, value of the first row that has it, and whether there are others. rows: key, property, value, ord."""
    first = F.when(F.col("value").isNotNull(), F.col("ord"))
    return rows.groupBy(key, "property").agg(F.min_by("value", first).alias("value"), (F.count_distinct("value") > 1).alias("conflict"))


def evidence_quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """0 if any evidence is not valid or has no score, else the least score; support is group from two distinct pieces on."""
    bad = F.count_if(~F.coalesce("valid", F.lit(False)) | F.col("score").isNull())
    n = F.count_distinct(F.when(F.col("valid"), F.col("evidence_id")))
    return rows.groupBy(*keys).agg(F.when(bad == 0, F.min("score")).otherwise(F.lit(0.0)).alias("quality"), n.alias("valid_evidence"), F.when(n >= 2, "group").otherwise("single").alias("support"))


def route(confidence: Column, schema: Column, evidence: Column, conflict: Column, threshold: float = 0.85) -> Column:
    """The first rule that holds decides."""
    return scores.first_of((schema == 0, "reject"), (conflict, "review_conflict"), (evidence == 0, "review_evidence"), (confidence < 0.5, "review_low"), (schema < 1, "review_schema"), (confidence >= threshold, "auto"), otherwise="review")


#: Reasons that reject a candidate; any other reason leaves it to a review.
REJECTING = ("schema_invalid", "evidence_invalid", "endpoint_rejected")


def _routed(*rules: tuple[Column, str]) -> tuple[Column, Column]:
    """Status and reason by the first rule that holds; without any the candidate is validated. A flag that is null does not hold."""
    reason = scores.first_of(*[(F.coalesce(flag, F.lit(False)), name) for flag, name in rules], otherwise="")
    return F.when(reason == "", "validated").when(reason.isin(*REJECTING), "rejected").otherwise("pending_review"), F.nullif(reason, F.lit(""))


def route_entity(schema_invalid: Column, evidence_invalid: Column, evidence_ambiguous: Column, match_ambiguous: Column, conflict_open: Column, matched: Column, confidence: Column, threshold: float = 0.85) -> tuple[Column, Column]:
    """Status and reason of an entity candidate; the confidence matters only where no entity is matched."""
    return _routed(
        (schema_invalid, "schema_invalid"), (evidence_invalid, "evidence_invalid"), (evidence_ambiguous, "evidence_ambiguous"), (match_ambiguous, "entity_match_ambiguous"), (conflict_open, "conflict_open"),
        (~F.coalesce(matched, F.lit(False)) & (confidence < threshold), "low_confidence"),
    )


def route_relation(schema_invalid: Column, evidence_invalid: Column, endpoint_rejected: Column, evidence_ambiguous: Column, boundary_unclear: Column, conflict_open: Column, endpoint_pending: Column, support: Column) -> tuple[Column, Column]:
    """Status and reason of a relation candidate; evidence in groups is always reviewed."""
    return _routed(
        (schema_invalid, "schema_invalid"), (evidence_invalid, "evidence_invalid"), (endpoint_rejected, "endpoint_rejected"), (evidence_ambiguous, "evidence_ambiguous"),
        (boundary_unclear, "schema_boundary_unclear"), (conflict_open, "conflict_open"), (endpoint_pending, "endpoint_pending_review"), (support == "group", "evidence_group"),
    )


def expand(edges: DataFrame, frontier: DataFrame, *, direction: str = "both", relations: list[str] | None = None, most: int | None = None) -> DataFrame:
    """query, relation, src, tgt, node (the end reached) of the edges at each query's frontier (query, node); of a node's edges in a direction only the first `most` in canonical order, if that is given."""
    e = edges if relations is None else edges.where(F.col("relation").isin(*relations))

    def part(end: str, reached: str) -> DataFrame:
        own = e
        if most is not None:  # before the edges meet the queries: a hub's edges times its queries are far more than what can stay
            place = F.dense_rank().over(Window.partitionBy(end).orderBy("relation", "src", "tgt"))
            own = e.join(frontier.select(F.col("node").alias(end)).distinct(), end, "left_semi").withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
        f = frontier.withColumnRenamed("node", end)  # grows with the queries: how it is joined is left to its size
        return own.join(f, end).select("query", "relation", "src", "tgt", F.col(reached).alias("node"))

    parts = [part(end, reached) for name, end, reached in (("outbound", "src", "tgt"), ("inbound", "tgt", "src")) if direction in (name, "both")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def capped(found: DataFrame, known: DataFrame, max_nodes: int, max_relations: int, hop: int) -> DataFrame:
    """The prefix of a hop's edges, in their canonical order, that keeps a query within both caps; nothing follows the first edge that does not.

    known: query, node at the start of the hop, and n_relations kept so far. A relation between known nodes needs no room for nodes.
    """
    order = ["relation", "src", "tgt"]
    distinct = found.groupBy("query", *order).agg(F.min("node").alias("a"), F.max("node").alias("b"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))  # no more than these can stay; each task drops the rest of a hub's edges before they are dealt by query
    distinct = distinct.withColumn("_place", place).where(F.col("_place") <= max_relations + 1).drop("_place")
    ends = distinct.select("query", *order, F.explode(F.array_distinct(F.array("a", "b"))).alias("node")).join(known.select("query", "node").withColumn("old", F.lit(True)), ["query", "node"], "left")
    first = Window.partitionBy("query", "node").orderBy(*order)
    new = F.col("old").isNull() & (F.row_number().over(first) == 1)
    per_edge = ends.withColumn("new", new).groupBy("query", *order).agg(F.count_if("new").alias("new_nodes"))
    sizes = known.groupBy("query").agg(F.count("*").alias("n_nodes"), F.max("n_relations").alias("n_relations"))
    w = Window.partitionBy("query").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = per_edge.join(sizes, "query").withColumn("nodes", F.col("n_nodes") + F.sum("new_nodes").over(w)).withColumn("relations", F.col("n_relations") + F.count("*").over(w))
    over = (F.col("nodes") > max_nodes) & (F.col("new_nodes") > 0) | (F.col("relations") > max_relations)
    return rows.withColumn("cut", F.max(over).over(w)).select("query", *order, F.col("cut").alias("truncated"), F.lit(hop).alias("hop"))


def bounded_bfs(edges: DataFrame, seeds: DataFrame, *, hops: int = 2, direction: str = "both", relations: list[str] | None = None, max_nodes: int = 100, max_relations: int = 200) -> DataFrame:
    """query, hop, relation, src, tgt of the relations within a few hops of each query's seeds (query, node), under both caps, and whether the query was truncated.

    What a hop keeps or is cut by is among its first max_relations + 1 new edges. Those of a node are among its first
    max_relations + 1, and as many more as may have been kept before.
    """
    most = 2 * max_relations + 1 if max_relations < _WIDE else None
    nodes = seeds.select("query", "node").distinct().withColumn("n_relations", F.lit(0).cast("long"))
    frontier, kept, cut = nodes.select("query", "node"), None, None
    for hop in range(1, hops + 1):
        found = expand(edges, frontier, direction=direction, relations=relations, most=most)
        if kept is not None:
            found = found.join(kept.select("query", "relation", "src", "tgt"), ["query", "relation", "src", "tgt"], "left_anti")
        rows = capped(found, nodes, max_nodes, max_relations, hop)
        rows = rows if hop == hops else saved(rows, "graph-hop")
        inside, more = rows.where(~F.col("truncated")), rows.groupBy("query").agg(F.max("truncated").alias("t"))
        kept = inside.drop("truncated") if kept is None else kept.unionByName(inside.drop("truncated"))
        cut = more if cut is None else cut.unionByName(more)
        if hop < hops:
            reached = inside.select("query", F.explode(F.array("src", "tgt")).alias("node")).distinct()
            frontier = reached.join(nodes.select("query", "node"), ["query", "node"], "left_anti")
            n = kept.groupBy("query").agg(F.count("*").alias("n_relations"))
            nodes = nodes.select("query", "node").unionByName(frontier).join(n, "query", "left").select("query", "node", F.coalesce("n_relations", F.lit(0)).alias("n_relations"))
    truncated = cut.groupBy("query").agg(F.max("t").alias("truncated"))
    return kept.join(truncated, "query").select("query", F.col("hop").cast("long").alias("hop"), "relation", "src", "tgt", "truncated")


def same_title_neighbours(chunks: DataFrame) -> DataFrame:
    """chunk_id, path, before_, after_: the nearest chunks of a document with the same title path. chunks: chunk_id, doc_id, seq, own, block, linked titles, of which the first that is there counts."""
    rows = chunks.select("chunk_id", "doc_id", "seq", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("own", "block", "linked")]).alias("path"))
    w = Window.partitionBy("doc_id", "path").orderBy("seq")
    return rows.select("chunk_id", "path", F.lag("chunk_id").over(w).alias("before_"), F.lead("chunk_id").over(w).alias("after_"))


def primary_evidence(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """chunk_id, evidence_id: its direct one, else the first of its links by (seq, evidence_id), else null. chunks: chunk_id, direct; links: chunk_id, seq, evidence_id."""
    first = links.groupBy("chunk_id").agg(F.min_by("evidence_id", F.struct("seq", "evidence_id")).alias("first"))
    return chunks.join(first, "chunk_id", "left").select("chunk_id", F.coalesce("direct", "first").alias("evidence_id"))


def within_budget(neighbours: Column, size: Column, budget: int) -> Column:
    """The neighbours that stay when the farthest is dropped until all and the text of `size` characters fit: of two as far, the following one goes first.

    neighbours: array of structs that begin with distance and side (0: before, 1: after) and hold `size`; nulls and those
    without a distance are not there. Sizes are not negative, so what stays is the longest run of the nearest that fits.
    """
    near = F.array_sort(F.filter(neighbours, lambda x: x["distance"].isNotNull()))
    upto = lambda i: F.aggregate(F.slice(near, F.lit(1), i + 1), size.cast("long"), lambda total, x: total + x["size"])
    return F.filter(near, lambda x, i: upto(i) <= budget)


def hydrated(relations: DataFrame, evidence: DataFrame, cap: int = 20) -> DataFrame:
    """Up to `cap` pieces of evidence of each relation by id, with their place from 0; a relation without any keeps one row of nulls."""
    place = F.row_number().over(Window.partitionBy("src", "tgt").orderBy("evidence_id")).cast("long") - 1
    first = evidence.join(relations.select("src", "tgt").distinct(), ["src", "tgt"], "left_semi").withColumn("pos", place).where(F.col("pos") < cap)
    return relations.join(first.select("src", "tgt", "pos", "evidence_id"), ["src", "tgt"], "left")


def link_decisions(mentions: DataFrame, entities: DataFrame, *, floor: int = 500_000, margin: int = 50_000, least: int = 800_000, most: int = 10, block: int = 1024) -> DataFrame:
    """mention_id, status (linked, ambiguous, not_found), selected, score, margin, n_candidates (`most` at most).

    Equal normal forms are exact matches: one is linked, several are ambiguous. Of other mentions the best candidates among
    all entities of their type, or of all types if they have none, are sought, and the greatest lexical similarity decides. Of the entities of one name only
    those that can be among the best meet its mentions. Candidates stand in the order of score, type, name and id. A mention whose normal form is empty is not found.
    """
    m = mentions.select("mention_id", F.coalesce(F.concat(F.lit("="), "type_key"), F.lit("")).alias("scope"), tx.graph_name(F.col("text")).alias("m"))
    every = entities.select("node_id", F.col("type_key").alias("etype"), tx.graph_name(F.col("name")).alias("e")).where("node_id IS NOT NULL AND e <> ''")
    known = every.withColumn("scope", F.explode(F.array(F.lit(""), F.concat(F.lit("="), "etype")))).where("scope IS NOT NULL")
    asked = known.join(m.select("scope").distinct(), "scope", "left_semi").repartition("scope", "e").groupBy("scope", "e", "node_id").agg(F.min("etype").alias("etype"))
    place = F.row_number().over(Window.partitionBy("scope", "e").orderBy("etype", "node_id"))
    first = asked.withColumn("_n", place).where(F.col("_n") <= max(2, most))  # however many entities have a name, the best and how many count are among these
    exact = m.join(first, (m.m == first.e) & (m.scope == first.scope)).select("mention_id", "node_id", "etype", "e", F.lit(1_000_000).cast("long").alias("score"))
    rest = m.where("m <> ''").join(exact.select("mention_id").distinct(), "mention_id", "left_anti")
    found = lexical_candidates(rest.select("scope", "m").distinct(), known, floor=floor, most=max(2, most), block=block)
    pairs = rest.join(found, ["scope", "m"]).select("mention_id", "node_id", "etype", "e", "score")
    one = exact.unionByName(pairs).where(F.col("score") >= floor).groupBy("mention_id", "node_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "etype", "e")).alias("at"))
    w = Window.partitionBy("mention_id").orderBy("at", "node_id")
    ranked = one.withColumn("score", -F.col("at.minus"))
    top = ranked.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where(F.col("n") <= most)
    best = top.groupBy("mention_id").agg(F.count("*").alias("n_candidates"), F.min_by(F.struct("node_id", "score", "next"), "n").alias("best"))
    out = m.select("mention_id").join(best, "mention_id", "left")
    gap = F.col("best.score") - F.coalesce(F.col("best.next"), F.lit(0))
    status = F.when(F.col("best").isNull(), "not_found").when((F.col("best.score") >= least) & (gap >= margin), "linked").otherwise("ambiguous")
    return out.select("mention_id", status.alias("status"), F.when(status == "linked", F.col("best.node_id")).alias("selected"), F.col("best.score").alias("score"), gap.alias("margin"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def planned_entities(nodes: DataFrame, *, least: float = 0.85) -> DataFrame:
    """nodes with the first reason that blocks each (null: published). nodes: node_id, status, confidence, evidence."""
    reason = scores.first_of((F.col("status") != "active", "not_active"), (F.col("confidence") < least, "low_confidence"), (F.col("evidence") == 0, "no_evidence"), otherwise="ok")
    return nodes.withColumn("reason", F.nullif(reason, F.lit("ok")))


def relation_reason(status: Column, confidence: Column, blocked: Column, least: float = 0.85) -> Column:
    """The first reason that blocks a relation, null if none does. blocked: whether one of its ends is."""
    return F.nullif(scores.first_of((status != "active", "not_active"), (confidence < least, "low_confidence"), (blocked, "endpoint_blocked"), otherwise="ok"), F.lit("ok"))


def publication_plan(nodes: DataFrame, edges: DataFrame, *, least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Items with the first reason that blocks each (null: published); relations wait for both of their ends. nodes: node_id, status, confidence, evidence; edges: relation, src, tgt, status, confidence."""
    entities = planned_entities(nodes, least=least)
    live = entities.where("reason IS NULL").select("node_id")
    a, b = live.select(F.col("node_id").alias("src"), F.lit(True).alias("_a")), live.select(F.col("node_id").alias("tgt"), F.lit(True).alias("_b"))
    reason = relation_reason(F.col("status"), F.col("confidence"), F.col("_a").isNull() | F.col("_b").isNull(), least)
    relations = edges.join(a, "src", "left").join(b, "tgt", "left").withColumn("reason", reason).drop("_a", "_b")
    return entities, relations


def manifest_hash(items: DataFrame, by: list[str], hash_column: str, policy: str) -> DataFrame:
    """A digest of each group's sorted item digests, by way of digests of groups of them by their first two characters, so that no row holds them all."""
    part = items.groupBy(*by, F.left(hash_column, F.lit(2)).alias("_p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(hash_column)), ""), 256).alias("h"), F.count("*").alias("n"))
    return part.groupBy(*by).agg(F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "h"))), lambda x: x["h"]), ""), F.lit(policy)), 256).alias("manifest_hash"), F.sum("n").alias("items"))


def planned_items(ends: DataFrame, n_rows: int, sources: DataFrame, targets: DataFrame, *, once: bool) -> DataFrame:
    """source, target, stored and planned: how often each relation is stored, and how often it is planned anew from published ends. ends: source, target, in n_rows rows (once: equal ones are one); sources, targets: the key of each published entity.

    Rows go to their target and then to their source, where equal ones meet as well: two keys of each row are shuffled twice.
    """
    many = lambda side, name: side.groupBy(F.col("key").alias(name)).agg(F.count("*").alias(f"_{name}"))
    met = dealt(ends, n_rows, "target").join(many(targets, "target"), "target", "left")
    met = dealt(met, n_rows, "source").join(many(sources, "source"), "source", "left")
    stored = F.lit(1).cast("long") if once else F.count("*")
    rows = met.groupBy("source", "target", F.coalesce(F.col("_source") * F.col("_target"), F.lit(0)).alias("_each")).agg(stored.alias("stored"))
    return rows.select("source", "target", "stored", (F.col("stored") * F.col("_each")).alias("planned"))


def reconciled(stored: Column, planned: Column) -> Column:
    """same, changed or missing of a stored item's hash against that planned anew (null: none is)."""
    return F.when(planned.isNull(), "missing").when(planned != stored, "changed").otherwise("same")
