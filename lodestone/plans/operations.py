"""Queries of the operations, evaluation, scan, hash and ordering families."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import nested, scores
from lodestone.functions import text as tx
from lodestone.operators import evaluation as ev
from lodestone.operators import ops
from lodestone.operators import privacy as pv
from lodestone.operators import retrieval as rt
from lodestone.plans.catalog import query
from lodestone.plans.lifecycle import now
from lodestone.plans.retrieval import _DENSE, _RANKED, asked
from lodestone.sources.tables import Tables

_STATUSES = ["pending", "processing", "done", "failed", "superseded"]
_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in _STATUSES)


@query(f"SELECT user_id, {_COUNTS}, count(*) AS total FROM jobs_v GROUP BY user_id", views="jobs_v")
def ops_status_pivot(t: Tables) -> DataFrame:
    """AGG-01."""
    return ops.status_counts(t.jobs_v, ["user_id"], _STATUSES)


@query(
    "WITH d AS (SELECT source, count(*) AS documents FROM documents GROUP BY source), c AS (SELECT source, count(*) AS chunks FROM chunks_v GROUP BY source), l AS (SELECT source, count(*) AS labelled FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, documents, coalesce(chunks, 0) AS chunks, coalesce(labelled, 0) AS labelled FROM d LEFT JOIN c USING (source) LEFT JOIN l USING (source)",
    views="chunks_v",
)
def ops_library_stats(t: Tables) -> DataFrame:
    """AGG-02, JN-22."""
    d = t.documents.groupBy("source").agg(F.count("*").alias("documents"))
    c = t.chunks_v.groupBy("source").agg(F.count("*").alias("chunks"))
    labelled = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("labelled"))
    return d.join(c, "source", "left").join(labelled, "source", "left").select("source", "documents", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("labelled", F.lit(0)).alias("labelled"))


@query("SELECT o_custkey, count(*) AS expected, count(*) FILTER (o_orderstatus = 'F') AS done, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS percent FROM orders GROUP BY o_custkey")
def ops_progress(t: Tables) -> DataFrame:
    """JN-22, MTH-05."""
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("expected"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return g.withColumn("percent", scores.progress(F.col("done"), F.col("expected")))


_BEATS = "b AS (SELECT event_id, event_type AS service, user_id % 10 AS instance, ts, CASE WHEN value < 5 THEN 'degraded' WHEN value > 60 THEN 'stopping' ELSE 'ok' END AS state FROM events)"


@query(f"""WITH {_BEATS}, l AS (SELECT service, instance, max(ts) AS seen, arg_max(state, {{'ts': ts, 'id': event_id}}) AS state FROM b GROUP BY service, instance),
    f AS (SELECT *, (epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(date_trunc('second', seen)) <= 200000 AND state <> 'stopping') AS live FROM l)
    SELECT service, count(*) FILTER (live) AS online, count(*) FILTER (live AND state = 'degraded') AS degraded, CASE WHEN count(*) FILTER (live) = 0 THEN 'offline' WHEN count(*) FILTER (live AND state = 'degraded') > 0 THEN 'degraded' ELSE 'online' END AS status, arg_max(instance, {{'s': seen, 'i': instance}}) AS latest FROM f GROUP BY service""")
def ops_service_status(t: Tables) -> DataFrame:
    """AGG-31, STM-15."""
    state = F.when(F.col("value") < 5, "degraded").when(F.col("value") > 60, "stopping").otherwise("ok")
    beats = t.events.select("event_id", F.col("event_type").alias("service"), (F.col("user_id") % 10).alias("instance"), "ts", state.alias("state"))
    return ops.service_states(beats, "service", F.col("ts"), now(), 200000)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 100 LIMIT 50")
def ops_page_offset(t: Tables) -> DataFrame:
    """TOP-09: a page is the feature."""
    return ops.offset_page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100, 50)


@query("WITH p AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 AND o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderkey LIMIT 51) SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM p) > 50 AS has_more FROM p ORDER BY o_orderkey LIMIT 50")
def ops_page_keyset(t: Tables) -> DataFrame:
    """TOP-11, FLT-19, FLT-20: the next page after a key, with optional equality and time filters."""
    rows = t.orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= F.expr("to_timestamp_ntz('1995-01-01 00:00:00')")))
    return ops.keyset_page(rows.select("o_orderkey", "o_orderstatus"), "o_orderkey", 1000, 50)


@query("SELECT kind, id, amount FROM (SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount FROM orders UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, l_extendedprice FROM lineitem) ORDER BY amount DESC, kind, id OFFSET 20 LIMIT 40")
def ops_merge_page(t: Tables) -> DataFrame:
    """TOP-10: a page of two sources in one order; each side gives what the page can reach."""
    order = [F.desc("amount"), F.col("kind"), F.col("id")]
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount")).orderBy(*order).limit(60)
    b = t.lineitem.select(F.lit("line").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("amount")).orderBy(*order).limit(60)
    return ops.offset_page(a.unionByName(b), order, 20, 40)


@query("SELECT event_id, ts FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 32")
def ops_claim_oldest(t: Tables) -> DataFrame:
    """TOP-12: a claim takes a batch of the oldest."""
    return t.events.where("event_type = 'signup'").select("event_id", "ts").orderBy("ts", "event_id").limit(32)


@query("WITH g(user_id, library, action) AS (VALUES (1, 'src1', 'read'), (1, 'src2', 'read'), (1, 'src2', 'write'), (2, 'src3', 'write')) SELECT user_id, doc_id, source FROM documents JOIN (SELECT DISTINCT user_id, library FROM g WHERE action = 'read') r ON r.library = source")
def ops_permissions(t: Tables) -> DataFrame:
    """FLT-27, DOM-37: documents each user may read."""
    grants = t.spark.createDataFrame([(1, "src1", "read"), (1, "src2", "read"), (1, "src2", "write"), (2, "src3", "write")], "user_id int, library string, action string")
    return ops.permitted(t.documents.select("doc_id", "source"), grants, "source", "read").select("user_id", "doc_id", "source")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 AND NOT (role = 'assistant' AND trim(text) = '')")
def chat_recent_turns(t: Tables) -> DataFrame:
    """WIN-04."""
    return ops.recent_turns(t.conversations, 2).select("conv_id", "turn", "role", "pos")


@query("SELECT conv_id, turn, used::BIGINT AS used, left(text, (600 - used)::INT) AS block FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations) WHERE used < 600")
def chat_context_budget(t: Tables) -> DataFrame:
    """WIN-06, DOM-36."""
    return ops.packed(t.conversations, 600).select("conv_id", "turn", "used", "block")


@query("SELECT a.conv_id, a.turn, length(a.text) AS answer_chars, length(q.text) AS question_chars, n.turns FROM conversations a LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) n ON n.conv_id = a.conv_id WHERE a.role = 'assistant'")
def chat_logs(t: Tables) -> DataFrame:
    """JN-21: answers with the question before them."""
    c = t.conversations
    asked_ = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.length("text").cast("long").alias("question_chars"))
    turns = c.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return c.where("role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("answer_chars")).join(asked_, ["conv_id", "turn"], "left").join(turns, "conv_id").select("conv_id", "turn", "answer_chars", "question_chars", "turns")


@query("SELECT conv_id, list(turn ORDER BY turn) AS turns, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def chat_history_full(t: Tables) -> DataFrame:
    """DOM-52, DOM-58: a conversation's history in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(rows.alias("h")).select("conv_id", F.col("h.turn").alias("turns"), F.col("h.role").alias("roles"))


_HITS = f"{_DENSE}, r AS (SELECT *, {_RANKED} AS rank FROM s WHERE id <> query_id), h AS (SELECT query_id, min(CASE WHEN label = ql THEN rank END) AS first_hit FROM r WHERE rank <= 10 GROUP BY query_id)"


def _ranked(t: Tables) -> DataFrame:
    hits = rt.exact_topk(t.embeddings, asked(t), 11).where("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    labels = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    own = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    return hits.withColumn("rank", place).where("rank <= 10").join(labels, "id").join(own, "query_id")


@query(f"WITH {_HITS} SELECT query_id, first_hit FROM h")
def eval_first_hit(t: Tables) -> DataFrame:
    """WIN-02, STR-08: rank of the first hit of the query's own label."""
    return ev.first_hits(_ranked(t), F.col("label") == F.col("ql"))


@query(f"WITH {_HITS} SELECT count(*) AS queries, round(avg((coalesce(first_hit <= 1, false))::INT::DOUBLE), 9) AS hit_at_1, round(avg((coalesce(first_hit <= 3, false))::INT::DOUBLE), 9) AS hit_at_3, round(avg((coalesce(first_hit <= 5, false))::INT::DOUBLE), 9) AS hit_at_5, round(sum(coalesce(1.0::DOUBLE / first_hit, 0)) / count(*), 9) AS mrr FROM h")
def eval_hit_at_k(t: Tables) -> DataFrame:
    """AGG-09, AGG-10, DOM-32."""
    return ev.hit_rates(eval_first_hit(t))


@query(f"WITH {_HITS}, g AS (SELECT label, count(*) - 1 AS gold FROM embeddings GROUP BY label) SELECT r.query_id, round(count(*) FILTER (r.label = r.ql)::DOUBLE / nullif(max(g.gold), 0), 9) AS recall FROM r JOIN g ON g.label = r.ql WHERE r.rank <= 10 GROUP BY r.query_id")
def eval_recall(t: Tables) -> DataFrame:
    """AGG-11."""
    gold = t.embeddings.groupBy(F.col("label").alias("ql")).agg((F.count("*") - 1).alias("gold"))
    return _ranked(t).join(gold, "ql").groupBy("query_id").agg(F.round(F.try_divide(F.count_if(F.col("label") == F.col("ql")).cast("double"), F.max("gold")), 9).alias("recall"))


@query("WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), p AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 400), j AS (SELECT g.doc_id AS g, p.doc_id AS p FROM g FULL JOIN p USING (doc_id)) SELECT count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn, round(count(*) FILTER (g IS NOT NULL AND p IS NOT NULL)::DOUBLE / nullif(count(p), 0), 9) AS precision, round(count(*) FILTER (g IS NOT NULL AND p IS NOT NULL)::DOUBLE / nullif(count(g), 0), 9) AS recall FROM j")
def eval_set_precision_recall(t: Tables) -> DataFrame:
    """AGG-12, SET-01."""
    return ev.set_scores(t.labels.where("quality = 1"), t.documents.where("n_chars > 400"), ["doc_id"])


@query("SELECT source, count(*) AS n, count(DISTINCT content_hash) AS distinct_n, round((count(*) - count(DISTINCT content_hash))::DOUBLE / count(*), 9) AS duplicate_rate FROM docs_v GROUP BY source", views="docs_v")
def eval_duplicate_rate(t: Tables) -> DataFrame:
    """AGG-13."""
    n, d = F.count("*"), F.count_distinct("content_hash")
    return t.docs_v.groupBy("source").agg(n.alias("n"), d.alias("distinct_n"), F.round((n - d).cast("double") / n, 9).alias("duplicate_rate"))


@query("SELECT event_type, count(*) AS cases, sum((value >= 10)::INT)::BIGINT AS passed, round(sum((value >= 10)::INT)::DOUBLE / count(*), 9) AS pass_rate, bool_and(value >= 0) AS hard_gate FROM events GROUP BY event_type")
def eval_case_rates(t: Tables) -> DataFrame:
    """AGG-14, DOM-34."""
    ok = F.sum((F.col("value") >= 10).cast("long"))
    return t.events.groupBy("event_type").agg(F.count("*").alias("cases"), ok.alias("passed"), F.round(ok.cast("double") / F.count("*"), 9).alias("pass_rate"), F.bool_and(F.col("value") >= 0).alias("hard_gate"))


@query("SELECT event_type, quantile_disc(us, 0.5) AS p50, quantile_disc(us, 0.95) AS p95, max(us) AS max_us FROM (SELECT event_type, ceil(value * 1000)::BIGINT AS us FROM events) GROUP BY event_type")
def eval_latency_percentiles(t: Tables) -> DataFrame:
    """AGG-15, AGG-16: nearest-rank percentiles of whole microseconds."""
    us = F.ceil(F.col("value") * 1000).cast("long")
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY us)").cast("long")
    return t.events.select("event_type", us.alias("us")).groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("us").alias("max_us"))


@query(f"WITH {_HITS}, a AS (SELECT query_id, ql, list(id ORDER BY id) AS got, list(id ORDER BY id) FILTER (label = ql) AS good FROM r WHERE rank <= 10 GROUP BY ALL) SELECT query_id, ((2 * len(coalesce(good, [])) * 1000000 + len(got)) // (2 * len(got)))::BIGINT AS precision_micros, len(coalesce(good, [])) > 0 AS any_gold, len(coalesce(good, [])) = len(got) AS complete FROM a")
def eval_utility_macro(t: Tables) -> DataFrame:
    """AGG-17: shares of a result list in millionths."""
    got = _ranked(t).groupBy("query_id").agg(F.collect_list("id").alias("got"), F.collect_list(F.when(F.col("label") == F.col("ql"), F.col("id"))).alias("good"))
    n = F.size("good")
    return got.select("query_id", tx.micros(n, F.size("got")).alias("precision_micros"), (n > 0).alias("any_gold"), (n == F.size("got")).alias("complete"))


@query("""WITH s AS (SELECT event_id // 30 AS run, ceil(value * 1000)::BIGINT AS micros FROM events WHERE event_id % 211 <> 5), g AS (SELECT run, count(*) AS n, list(micros ORDER BY micros) AS a FROM s GROUP BY run)
    SELECT run, n, CASE WHEN n = 30 THEN a[15] END AS p50, CASE WHEN n = 30 THEN a[29] END AS p95, CASE WHEN n = 30 THEN a[30] END AS most FROM g""")
def eval_latency_summary(t: Tables) -> DataFrame:
    """AGG-16: runs of thirty samples; one that lacks a sample has no summary."""
    samples = t.events.where("event_id % 211 <> 5").select(F.expr("event_id div 30").alias("run"), F.ceil(F.col("value") * 1000).cast("long").alias("micros"))
    return ev.latency_summary(samples, "run")


_CASES = "c AS (SELECT l_orderkey, (l_discount * 1000000)::BIGINT * 10 AS score, (l_tax * 1000000)::BIGINT * 5 AS margin, l_returnflag <> 'R' AS right_ FROM lineitem)"
_GRID = f"{_CASES}, g AS (SELECT s AS min_score, m AS min_margin FROM (VALUES (200000), (500000), (800000)) a(s), (VALUES (0), (100000), (200000)) b(m)), x AS (SELECT min_score, min_margin, count(*) FILTER (score >= min_score AND margin >= min_margin) AS linked, count(*) FILTER (score >= min_score AND margin >= min_margin AND right_) AS right_, count(*) FILTER (score >= min_score AND margin >= min_margin AND NOT right_) AS wrong, count(*) FILTER (NOT (score >= min_score AND margin >= min_margin)) AS abstained FROM c, g GROUP BY ALL)"


def _grid(t: Tables) -> DataFrame:
    cases = t.lineitem.select((F.round(F.col("l_discount") * 1000000).cast("long") * 10).alias("score"), (F.round(F.col("l_tax") * 1000000).cast("long") * 5).alias("margin"), (F.col("l_returnflag") != "R").alias("right"))
    return ev.threshold_grid(cases, [200000, 500000, 800000], [0, 100000, 200000])


@query(f'WITH {_GRID} SELECT min_score::BIGINT AS min_score, min_margin::BIGINT AS min_margin, linked, right_ AS "right", wrong, abstained FROM x')
def eval_threshold_grid(t: Tables) -> DataFrame:
    """AGG-18, AGG-19."""
    return _grid(t)


@query(f'WITH {_GRID}, e AS (SELECT * FROM x WHERE wrong <= 3000) SELECT min_score::BIGINT AS min_score, min_margin::BIGINT AS min_margin, linked, right_ AS "right", wrong, (SELECT count(*) FROM e) AS eligible FROM e ORDER BY linked DESC, min_score DESC, min_margin DESC LIMIT 1')
def eval_grid_select(t: Tables) -> DataFrame:
    """AGG-20."""
    return ev.best_of_grid(_grid(t), 3000)


@query()
def eval_bootstrap(t: Tables) -> DataFrame:
    """AGG-21: 10,000 stratified replicates; only tests can hold its random draws against anything."""
    cases = t.events.select("event_type", (F.col("value") >= 10).cast("double").alias("a"), (F.col("value") >= 12).cast("double").alias("b"))
    return ev.interval(ev.paired_bootstrap(cases, "event_type", "a", "b"))


@query("SELECT doc_id, lower(regexp_extract('doc' || doc_id || '.TXT', '\\.([^.]+)$', 1)) AS suffix, strlen(text) AS bytes FROM documents WHERE strlen(text) <= 50000")
def scan_text_size_cap(t: Tables) -> DataFrame:
    """The size cap over a table of texts; the readers of files are in `files`."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    return t.documents.where(F.octet_length("text") <= 50000).select("doc_id", F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1)).alias("suffix"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT doc_id FROM documents WHERE trim(text) <> ''")
def scan_text_nonblank(t: Tables) -> DataFrame:
    """Blank texts left out of a table."""
    return t.documents.where(F.trim("text") != "").select("doc_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scan_json_props(t: Tables) -> DataFrame:
    """FLT-15: fields of JSON by a schema."""
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT doc_id // 1000 AS batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1")
def scan_keyset_batches(t: Tables) -> DataFrame:
    """What batches of a thousand ids hold."""
    return t.documents.groupBy(F.expr("doc_id div 1000").alias("batch")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("SELECT chunk_id, (sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY seq) - length(text) - 2)::BIGINT AS base FROM chunks_v", views="chunks_v")
def scan_page_offsets(t: Tables) -> DataFrame:
    """SRC-07, WIN-08: where each page begins once pages are joined by two characters."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    return t.chunks_v.select("chunk_id", (F.sum(F.length("text") + 2).over(w) - F.length("text") - 2).alias("base"))


@query("WITH n AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 1 ELSE label END AS label FROM embeddings WHERE vec_id % 10 <> 0) SELECT coalesce(o.vec_id, n.vec_id) AS vec_id, CASE WHEN n.vec_id IS NULL THEN 'delete' WHEN o.label <> n.label THEN 'upsert' ELSE 'noop' END AS action FROM embeddings o FULL JOIN n USING (vec_id)")
def sink_change_feed(t: Tables) -> DataFrame:
    """SRC-22: what a full new copy of a table changes."""
    old = t.embeddings.select("vec_id", F.col("label").alias("o"))
    new = t.embeddings.where("vec_id % 10 <> 0").select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.col("label") + 1).otherwise(F.col("label")).alias("n"))
    return old.join(new, "vec_id", "full_outer").select("vec_id", F.when(F.col("n").isNull(), "delete").when(F.col("o") != F.col("n"), "upsert").otherwise("noop").alias("action"))


@query("SELECT event_id, (json_keys(props) = ['k'] AND length(props) <= 65536) AS accepted, 'sys-' || event_id AS document_id FROM events")
def filter_metadata_guard(t: Tables) -> DataFrame:
    """FLT-15, FLT-16, FLT-17: user metadata of a bounded size that names no system field; system fields win."""
    ok = (F.json_object_keys("props") == F.array(F.lit("k"))) & (F.length("props") <= 65536)
    user = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k != "document_id")
    return t.events.select("event_id", ok.alias("accepted"), F.map_concat(user, F.create_map(F.lit("document_id"), F.concat(F.lit("sys-"), F.col("event_id").cast("string"))))["document_id"].alias("document_id"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3 AND l_linenumber + l_quantity >= 10")
def filter_page_containment(t: Tables) -> DataFrame:
    """FLT-18: a range that begins by page 3 and reaches page 10."""
    return t.lineitem.where((F.col("l_linenumber") <= 3) & (F.col("l_linenumber") + F.col("l_quantity") >= 10)).select("l_orderkey", "l_linenumber")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE CASE WHEN l.toxic = 1 THEN 'secret' WHEN l.quality = 1 THEN 'public' ELSE 'internal' END IN ('public', 'internal')")
def filter_security_level(t: Tables) -> DataFrame:
    """FLT-28."""
    level = F.when(F.col("toxic") == 1, "secret").when(F.col("quality") == 1, "public").otherwise("internal")
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where(F.array_contains(F.array(F.lit("public"), F.lit("internal")), level)).select("doc_id")


@query("SELECT o.o_orderkey, n.n FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) n ON n.l_orderkey = o.o_orderkey")
def join_header_optional(t: Tables) -> DataFrame:
    """JN-07."""
    n = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t.orders.select("o_orderkey").join(n, "o_orderkey", "left")


@query("SELECT e.relation, e.src, e.tgt, a.type_key AS src_type, b.type_key AS tgt_type FROM edges_v e JOIN nodes_v a ON a.node_id = e.src JOIN nodes_v b ON b.node_id = e.tgt", views="nodes_v edges_v")
def join_candidates_double(t: Tables) -> DataFrame:
    """JN-16: edges with the types of both of their ends."""
    a, b = (t.nodes_v.select(F.col("node_id").alias(k), F.col("type_key").alias(f"{k}_type")) for k in ("src", "tgt"))
    return t.edges_v.join(a, "src").join(b, "tgt").select("relation", "src", "tgt", "src_type", "tgt_type")


@query("SELECT k, list(DISTINCT j ORDER BY j) AS jobs FROM (SELECT l_partkey AS k, l_orderkey % 100 AS j FROM lineitem UNION ALL SELECT p_partkey, p_size FROM part) GROUP BY k")
def join_source_jobs(t: Tables) -> DataFrame:
    """JN-23, SET-07: the jobs that an item comes from, out of two kinds of rows."""
    a = t.lineitem.select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") % 100).alias("j"))
    b = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("j"))
    return a.unionByName(b).groupBy("k").agg(F.array_sort(F.collect_set("j")).alias("jobs"))


@query("SELECT n.type_key, count(*) AS items, count(DISTINCT n.node_id) AS distinct_items, count(*) = count(DISTINCT n.node_id) AS whole FROM nodes_v n GROUP BY n.type_key", views="nodes_v")
def join_published_rows(t: Tables) -> DataFrame:
    """JN-24, DOM-46: as many rows as members."""
    n, d = F.count("*"), F.count_distinct("node_id")
    return t.nodes_v.groupBy("type_key").agg(n.alias("items"), d.alias("distinct_items"), (n == d).alias("whole"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '-7'), doc_id LIMIT 50")
def sample_hash_order(t: Tables) -> DataFrame:
    """JN-27, TOP-13: a sample by the order of hashes is the feature."""
    return t.documents.select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id").limit(50)


@query("SELECT user_id, count(*) AS n, arg_max(event_type, {'ts': ts, 'id': event_id}) AS latest FROM events GROUP BY user_id")
def agg_latest_and_count(t: Tables) -> DataFrame:
    """AGG-05."""
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@query("""SELECT user_id, count(*) FILTER (status IN ('pending', 'processing')) AS live, count(*) FILTER (status IN ('failed', 'superseded')) AS failed, count(*) FILTER (status = 'done') AS done,
    CASE WHEN count(*) FILTER (status IN ('pending', 'processing')) > 0 THEN 'processing' WHEN count(*) FILTER (status IN ('failed', 'superseded')) > 0 AND count(*) FILTER (status = 'done') > 0 THEN 'partially_succeeded' WHEN count(*) FILTER (status IN ('failed', 'superseded')) > 0 THEN 'failed' ELSE 'succeeded' END AS state FROM jobs_v GROUP BY user_id""", views="jobs_v")
def agg_job_state(t: Tables) -> DataFrame:
    """AGG-32."""
    return ops.folded_state(t.jobs_v, "user_id")


@query("SELECT coalesce(CASE WHEN p_size > 40 THEN NULL ELSE p_type END, 'none') AS bucket, count(*) AS n FROM part GROUP BY 1")
def agg_counter(t: Tables) -> DataFrame:
    """AGG-35."""
    return t.part.groupBy(F.coalesce(F.when(F.col("p_size") > 40, None).otherwise(F.col("p_type")), F.lit("none")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active, count(DISTINCT c_nationkey) AS nations FROM customer")
def agg_users(t: Tables) -> DataFrame:
    """AGG-04, AGG-37."""
    return t.customer.agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("active"), F.count_distinct("c_nationkey").alias("nations"))


@query("SELECT metric, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT 'requests' AS metric, 1.0::DOUBLE AS v FROM events UNION ALL SELECT 'value', value FROM events UNION ALL SELECT 'errors', 1.0::DOUBLE FROM events WHERE event_type = 'error') GROUP BY metric")
def agg_metric_samples(t: Tables) -> DataFrame:
    """AGG-38: several samples of each request, some of them optional."""
    error = F.when(F.col("event_type") == "error", F.struct(F.lit("errors").alias("metric"), F.lit(1.0).alias("v")))
    samples = F.filter(F.array(F.struct(F.lit("requests").alias("metric"), F.lit(1.0).alias("v")), F.struct(F.lit("value").alias("metric"), F.col("value").alias("v")), error), lambda s: s.isNotNull())
    return t.events.select(F.explode(samples).alias("s")).groupBy("s.metric").agg(F.count("*").alias("n"), F.round(F.sum("s.v"), 2).alias("total"))


@query("SELECT user_id, event_type, min(event_id) AS first_seen FROM events GROUP BY user_id, event_type")
def order_dedupe_first(t: Tables) -> DataFrame:
    """WIN-13."""
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_seen"))


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels)")
def set_required_keys(t: Tables) -> DataFrame:
    """SET-04: requested keys that were not found."""
    return t.events.select("user_id").distinct().join(t.labels.select(F.col("doc_id").alias("user_id")), "user_id", "left_anti")


@query("SELECT l_orderkey, len(list_distinct(list(l_partkey) FILTER (l_returnflag = 'R'))) AS gold, len(list_distinct(list(l_partkey) FILTER (l_linestatus = 'F'))) AS got, coalesce(len(list_intersect(list(l_partkey) FILTER (l_returnflag = 'R'), list(l_partkey) FILTER (l_linestatus = 'F'))), 0) AS both_ FROM lineitem GROUP BY l_orderkey")
def set_pair_scores(t: Tables) -> DataFrame:
    """SET-06, DOM-33."""
    gold, got = (F.collect_set(F.when(c, F.col("l_partkey"))) for c in (F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"))
    g = t.lineitem.groupBy("l_orderkey").agg(gold.alias("g"), got.alias("p"))
    n = lambda c: F.when(F.size(c) > 0, F.size(c).cast("long"))
    return g.select("l_orderkey", n("g").alias("gold"), n("p").alias("got"), F.size(F.array_intersect("g", "p")).cast("long").alias("both_"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","key":"' || p_partkey || '","name":"' || p_name || '"}') AS value_hash, left(sha256(p_name), 16) AS span_hash FROM part""")
def hash_canonical_json(t: Tables) -> DataFrame:
    """HSH-01 to HSH-03, HSH-05."""
    return t.part.select("p_partkey", scores.value_hash(brand=F.col("p_brand"), key=F.col("p_partkey").cast("string"), name=F.col("p_name")).alias("value_hash"), F.left(scores.content_hash(F.col("p_name")), F.lit(16)).alias("span_hash"))


@query("""SELECT relation, src, tgt, sha256('{"relation":"' || relation || '","src":"' || src || '","tgt":"' || tgt || '"}') AS relation_key FROM edges_v""", views="edges_v")
def hash_candidate_keys(t: Tables) -> DataFrame:
    """HSH-04, HSH-06."""
    return t.edges_v.select("relation", "src", "tgt", scores.value_hash(relation=F.col("relation"), src=F.col("src"), tgt=F.col("tgt")).alias("relation_key"))


_NS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL namespace


@query(f"SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT c_custkey, sha1(from_hex('{_NS.hex}') || c_name::BLOB) AS h FROM customer)")
def hash_uuid5(t: Tables) -> DataFrame:
    """HSH-08."""
    return t.customer.select("c_custkey", scores.uuid5(_NS.bytes, F.col("c_name")).alias("point_id"))


@query("SELECT event_type, least(greatest(ceil(1.25::DOUBLE * p95), p95 + 5000), 2400000)::BIGINT AS ceiling FROM (SELECT event_type, quantile_disc(ceil(value * 1000)::BIGINT, 0.95) AS p95 FROM events GROUP BY 1)")
def math_calibration(t: Tables) -> DataFrame:
    """MTH-07."""
    return eval_latency_percentiles(t).select("event_type", scores.latency_ceiling(F.col("p95")).alias("ceiling"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' ORDER BY source, doc_id DESC OFFSET 10 LIMIT 100")
def doc_listing(t: Tables) -> DataFrame:
    """DOM-55, DOM-38: a page of a listing is the feature."""
    return ops.offset_page(t.documents.where("lang = 'en'").select("doc_id", "lang", "source"), [F.col("source"), F.desc("doc_id")], 10, 100)


@query("SELECT doc_id, source, sha256(text) AS content_hash, 'legacy-' || doc_id AS legacy_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def doc_backfill(t: Tables) -> DataFrame:
    """DOM-07: rows for documents that have none yet."""
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("legacy-"), F.col("doc_id").cast("string")).alias("legacy_id"))


@query("SELECT source, count(*) AS documents, list(DISTINCT lang ORDER BY lang) AS langs FROM documents GROUP BY source")
def faq_folder_listing(t: Tables) -> DataFrame:
    """DOM-38."""
    return t.documents.groupBy("source").agg(F.count("*").alias("documents"), F.array_sort(F.collect_set("lang")).alias("langs"))


@query("SELECT event_id, ts, event_type FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_listing(t: Tables) -> DataFrame:
    """DOM-53."""
    return t.events.where(F.col("event_type").isin("error", "signup")).select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("SELECT event_id, NOT regexp_matches(props, '[0-9a-f]{32}|@|https?://') AS clean FROM events")
def eval_privacy_scan(t: Tables) -> DataFrame:
    """DOM-39: no hashes, addresses or links in what is kept of a request."""
    return t.events.select("event_id", (~F.col("props").rlike("[0-9a-f]{32}|@|https?://")).alias("clean"))


_RECORD = """CASE event_id % 6 WHEN 0 THEN '{"user":' || user_id || ',"kind":"' || event_type || '","more":' || props || '}' WHEN 1 THEN '{"kind":"' || event_type || '","user":' || user_id || ',"more":[{"deep":[' || props || ',{"Canonical_Name":"x"}]},"a@b.example"]}'
    WHEN 2 THEN '{"user":' || user_id || ',"extra":{"k":"SQL"},"more":null}' WHEN 3 THEN '["' || event_type || '",' || props || ']' WHEN 4 THEN '{"kind":"https://x.example/' || event_id || '","more":{"a":{"b":{"c":{"d":' || props || '}}}},"user":"' || user_id || '"}' ELSE 'user ' || user_id END"""


@query(
    f"""WITH r AS (SELECT event_id, {_RECORD} AS record FROM events), j AS (SELECT event_id, record::JSON AS j FROM r WHERE json_valid(record)), n AS (SELECT j.event_id, t.key, t.type, t.atom, t.fullkey, len(regexp_replace(regexp_replace(t.fullkey, '"', '', 'g'), '[^.\\[]', '', 'g')) AS level FROM j, json_tree(j.j) t),
    m AS (SELECT event_id, replace(fullkey, '"', '') AS path, level, CASE WHEN type <> 'ARRAY' OR true THEN key END AS key, lower(coalesce(CASE WHEN type = 'VARCHAR' THEN atom->>'$' WHEN type NOT IN ('OBJECT', 'ARRAY') THEN atom::VARCHAR END, '')) AS text, ends_with(fullkey, ']') AS item FROM n),
    o AS (SELECT event_id, path, unnest([x FOR x IN [CASE WHEN level = 1 AND NOT item AND key NOT IN ('user', 'kind', 'more') THEN 'unexpected field' END, CASE WHEN (NOT item AND lower(coalesce(key, '')) IN ({", ".join(f"'{p}'" for p in pv.PRIVATE)})) OR text IN ({", ".join(f"'{p}'" for p in pv.PRIVATE)}) THEN 'private field' END,
        CASE WHEN contains(text, '@') OR contains(text, 'https://') THEN 'private marker' END] IF x IS NOT NULL]) AS offence FROM m)
    SELECT event_id, path, offence FROM o UNION ALL SELECT event_id, '$.' || f, 'missing field' FROM j, (VALUES ('user'), ('kind'), ('more')) v(f) WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.' || f) IS NULL UNION ALL SELECT r.event_id, '$', 'not an object' FROM r LEFT JOIN j USING (event_id) WHERE j.event_id IS NULL OR json_type(j.j) <> 'OBJECT'"""
)
def eval_privacy_offences(t: Tables) -> DataFrame:
    """DOM-39: what is kept of requests against the fields that it may have, names of private things and marks of addresses, at any depth."""
    e = F.col("event_id") % 6
    user, kind, props = F.col("user_id").cast("string"), F.col("event_type"), F.col("props")
    made = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    record = (
        F.when(e == 0, made('{"user":', user, ',"kind":"', kind, '","more":', props, "}")).when(e == 1, made('{"kind":"', kind, '","user":', user, ',"more":[{"deep":[', props, ',{"Canonical_Name":"x"}]},"a@b.example"]}'))
        .when(e == 2, made('{"user":', user, ',"extra":{"k":"SQL"},"more":null}')).when(e == 3, made('["', kind, '",', props, "]"))
        .when(e == 4, made('{"kind":"https://x.example/', F.col("event_id").cast("string"), '","more":{"a":{"b":{"c":{"d":', props, '}}}},"user":"', user, '"}')).otherwise(made("user ", user))
    )
    return pv.offences(t.events.select("event_id", record.alias("record")), "event_id", "record", allowed=("user", "kind", "more"), forbidden=("@", "HTTPS://"))


@query(
    """WITH p AS (SELECT l_suppkey, l_partkey, '{"flags":{"return":"' || l_returnflag || '","line":"' || l_linestatus || '"},"at":["' || l_linenumber % 2 || '",{"z":null,"a":"é"}]}' AS given, '{"at":["' || l_linenumber % 2 || '",{"a":"é","z":null}],"flags":{"line":"' || l_linestatus || '","return":"' || l_returnflag || '"}}' AS canonical FROM lineitem)
    SELECT l_suppkey, l_partkey, count(DISTINCT canonical) AS forms, min(canonical) AS first_, min(sha256(canonical)) AS digest, count(DISTINCT canonical) = 1 AS consistent FROM p GROUP BY ALL"""
)
def graph_relation_properties(t: Tables) -> DataFrame:
    """AGG-26, HSH-02: whole nested property sets of a relation's occurrences compared in canonical form."""
    given = F.concat(F.lit('{"flags":{"return":"'), "l_returnflag", F.lit('","line":"'), "l_linestatus", F.lit('"},"at":["'), (F.col("l_linenumber") % 2).cast("string"), F.lit('",{"z":null,"a":"é"}]}'))
    rows = t.lineitem.select("l_suppkey", "l_partkey", nested.canonical_json(given).alias("form"))
    n = F.count_distinct("form")
    return rows.groupBy("l_suppkey", "l_partkey").agg(n.alias("forms"), F.min("form").alias("first_"), F.min(F.sha2("form", 256)).alias("digest"), (n == 1).alias("consistent"))
