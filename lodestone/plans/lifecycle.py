"""Queries of the ingest and lifecycle family."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scores
from lodestone.operators import lifecycle as lc
from lodestone.plans.catalog import query
from lodestone.sources.tables import Tables

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def now() -> F.Column:
    return F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))


_KEY = "CASE WHEN doc_id % 3 = 0 THEN 's|' || library_id || '|sync|' || external_id WHEN doc_id % 3 = 1 THEN 'e|' || library_id || '|' || external_id ELSE 'h|' || library_id || '|' || content_hash END"


def _identified(t: Tables) -> DataFrame:
    third = F.col("doc_id") % 3
    key = lc.identity_key(F.col("library_id"), F.when(third == 0, "sync"), F.when(third < 2, F.col("external_id")), F.col("content_hash"))
    return t.docs_v.select(key.alias("identity_key"), "doc_id", "content_hash")


@query(f"WITH k AS (SELECT {_KEY} AS identity_key, doc_id, content_hash FROM docs_v) SELECT identity_key, max(doc_id) AS doc_id, arg_max(content_hash, doc_id) AS content_hash, count(*) AS versions FROM k GROUP BY identity_key", views="docs_v")
def ingest_identity_dedupe(t: Tables) -> DataFrame:
    """HSH-01, STM-12, WIN-03: the newest row of each identity."""
    return _identified(t).groupBy("identity_key").agg(F.max("doc_id").alias("doc_id"), F.max_by("content_hash", "doc_id").alias("content_hash"), F.count("*").alias("versions"))


def _incoming(t: Tables) -> DataFrame:
    d = t.docs_v.select("doc_id", "content_hash", "lang")
    changed = F.when(F.col("doc_id") % 7 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash"))
    return d.where("doc_id % 11 <> 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 13 == 0, 1000000).otherwise(0)).alias("doc_id"), changed.alias("content_hash"), "lang")


_INCOMING = "n AS (SELECT doc_id + CASE WHEN doc_id % 13 = 0 THEN 1000000 ELSE 0 END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN reverse(content_hash) ELSE content_hash END AS content_hash, lang FROM docs_v WHERE doc_id % 11 <> 0)"


@query(
    f"""WITH {_INCOMING} SELECT coalesce(s.doc_id, n.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'keep'
    WHEN s.content_hash IS NOT DISTINCT FROM n.content_hash AND s.lang IS NOT DISTINCT FROM n.lang THEN 'noop' ELSE 'update' END AS action FROM docs_v s FULL JOIN n ON s.doc_id = n.doc_id""",
    views="docs_v",
)
def ingest_upsert_diff(t: Tables) -> DataFrame:
    """STM-11, STM-13, DOM-05, DOM-56."""
    return lc.upsert_actions(t.docs_v, _incoming(t), "doc_id", ["content_hash", "lang"])


@query(
    f"""WITH {_INCOMING}, c AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'delete' ELSE 'upsert' END AS action FROM n)
    SELECT coalesce(s.doc_id, c.doc_id) AS doc_id, coalesce(c.content_hash, s.content_hash) AS content_hash, coalesce(c.lang, s.lang) AS lang FROM docs_v s FULL JOIN c ON s.doc_id = c.doc_id WHERE c.action IS DISTINCT FROM 'delete'""",
    views="docs_v",
)
def ingest_merge_apply(t: Tables) -> DataFrame:
    """STM-11, SRC-22, DOM-56: an upsert and delete feed applied."""
    changes = _incoming(t).withColumn("action", F.when(F.col("doc_id") % 17 == 0, "delete").otherwise("upsert"))
    return lc.merged(t.docs_v.select("doc_id", "content_hash", "lang"), changes, "doc_id")


@query(
    """SELECT source, count(*) AS total, count(*) FILTER (trim(title) = '' OR n_chars < 60) AS failed, CASE WHEN count(*) FILTER (trim(title) = '' OR n_chars < 60) = 0 THEN 'success' WHEN count(*) FILTER (trim(title) = '' OR n_chars < 60) < count(*) THEN 'partial' ELSE 'error' END AS status FROM docs_v GROUP BY source""",
    views="docs_v",
)
def ingest_import_summary(t: Tables) -> DataFrame:
    """DOM-57, SRC-02."""
    bad = (F.trim("title") == "") | (F.col("n_chars") < 60)
    failed = F.count_if(bad)
    return t.docs_v.groupBy("source").agg(F.count("*").alias("total"), failed.alias("failed"), F.when(failed == 0, "success").when(failed < F.count("*"), "partial").otherwise("error").alias("status"))


@query(
    """WITH c AS (SELECT user_id, max(revision) AS current FROM jobs_v GROUP BY user_id)
    SELECT event_id, user_id, revision, current, CASE WHEN revision < current AND status IN ('pending', 'processing', 'done') THEN 'superseded' ELSE status END AS fenced FROM jobs_v JOIN c USING (user_id)""",
    views="jobs_v",
)
def lifecycle_generation_fold(t: Tables) -> DataFrame:
    """STM-03, STM-04."""
    return lc.generations(t.jobs_v, "user_id", "revision").select("event_id", "user_id", "revision", "current", "fenced")


@query("SELECT event_id, user_id, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS is_current FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lifecycle_publish_scd2(t: Tables) -> DataFrame:
    """STM-05."""
    return lc.published_history(t.events.where("event_type = 'purchase'"), "user_id", "ts", ["ts", "event_id"]).select("event_id", "user_id", "valid_from", "valid_to", "is_current")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)")
def lifecycle_tombstone(t: Tables) -> DataFrame:
    """STM-10, SRC-16."""
    gone = t.events.where("event_type = 'error'").select(F.col("user_id").alias("doc_id")).distinct()
    return t.documents.join(gone, "doc_id", "left_anti").select("doc_id", "lang", "source")


@query("WITH g AS (SELECT user_id, max(revision) AS target FROM jobs_v WHERE status = 'done' GROUP BY user_id) SELECT event_id, user_id, revision FROM jobs_v LEFT JOIN g USING (user_id) WHERE target IS NULL OR revision >= target", views="jobs_v")
def lifecycle_delete_before_revision(t: Tables) -> DataFrame:
    """SRC-16."""
    targets = t.jobs_v.where("status = 'done'").groupBy("user_id").agg(F.max("revision").alias("revision"))
    return lc.before_revision(t.jobs_v, targets, "user_id").select("event_id", "user_id", "revision")


@query("SELECT user_id, event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def lifecycle_outbox_dedupe(t: Tables) -> DataFrame:
    """STM-08: one event of a kind for a user and day."""
    e = t.events.select("user_id", "event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_id", "value")
    return lc.outbox(e, ["user_id", "event_type", "day"], ["event_id"])


_JOBS = "j AS (SELECT *, event_id % 7 AS attempts FROM jobs_v)"


@query(f"WITH {_JOBS} SELECT event_id, status, CASE WHEN status = 'processing' AND epoch({NOW}) - epoch(date_trunc('second', ts)) > 864000 AND attempts >= 5 THEN 'failed' WHEN status = 'processing' AND epoch({NOW}) - epoch(date_trunc('second', ts)) > 864000 THEN 'pending' ELSE status END AS next_status FROM j", views="jobs_v")
def lifecycle_stale_recovery(t: Tables) -> DataFrame:
    """STM-06."""
    jobs = t.jobs_v.withColumn("attempts", F.col("event_id") % 7)
    return lc.recovered(jobs, now(), 864000, 5).select("event_id", "status", "next_status")


@query("SELECT event_id, least(2.0::DOUBLE * pow(2, (event_id % 12 + 1) - 1), 300.0) AS delay FROM events")
def lifecycle_backoff(t: Tables) -> DataFrame:
    """MTH-06."""
    return t.events.select("event_id", scores.backoff(F.col("event_id") % 12 + 1, 2.0, 300.0).alias("delay"))


@query(f"""WITH d AS (SELECT *, (ts < {NOW} - INTERVAL 20 DAY AND (user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR event_type = 'error')) AS due FROM events)
    SELECT event_id, CASE WHEN due THEN NULL ELSE props END AS props, CASE WHEN due THEN NULL ELSE value END AS value, CASE WHEN due THEN {NOW} END AS purged_at FROM d""")
def lifecycle_retention_exists(t: Tables) -> DataFrame:
    """STM-16, FLT-26."""
    users = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id")).distinct().withColumn("_p", F.lit(True))
    e = t.events.join(users, "user_id", "left")
    due = (F.col("ts") < F.expr("to_timestamp_ntz('2024-01-12 00:00:00')")) & (F.col("_p").isNotNull() | (F.col("event_type") == "error"))
    return lc.purged(e.withColumn("due", due), F.col("due"), ["props", "value"], now()).select("event_id", "props", "value", "purged_at")


@query(
    "WITH c AS (SELECT user_id, max(revision) AS current FROM jobs_v GROUP BY user_id) SELECT event_id, (d.doc_id IS NOT NULL AND j.revision = c.current AND j.status IN ('pending', 'processing') AND coalesce(l.toxic, 0) = 0) AS eligible FROM jobs_v j JOIN c USING (user_id) LEFT JOIN documents d ON d.doc_id = j.user_id LEFT JOIN labels l ON l.doc_id = j.user_id",
    views="jobs_v",
)
def lifecycle_eligibility(t: Tables) -> DataFrame:
    """FLT-29."""
    jobs = lc.generations(t.jobs_v, "user_id", "revision")
    docs = t.documents.select(F.col("doc_id").alias("user_id"), F.lit(True).alias("live"))
    flags = t.labels.select(F.col("doc_id").alias("user_id"), "toxic")
    ok = F.col("live").isNotNull() & (F.col("revision") == F.col("current")) & F.col("status").isin(*lc.LIVE) & (F.coalesce("toxic", F.lit(0)) == 0)
    return jobs.join(docs, "user_id", "left").join(flags, "user_id", "left").select("event_id", ok.alias("eligible"))


@query("SELECT o_orderkey, count(l_orderkey) FILTER (l_returnflag <> 'R') AS active, CASE WHEN count(l_orderkey) FILTER (l_returnflag <> 'R') = 0 THEN 'stale' ELSE 'active' END AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def lifecycle_stale_propagation(t: Tables) -> DataFrame:
    """STM-17, AGG-36: an order without any line that has not been returned is stale."""
    lines = t.lineitem.where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    active = F.coalesce("n", F.lit(0))
    return t.orders.select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", active.alias("active"), F.when(active == 0, "stale").otherwise("active").alias("status"))


@query("WITH c AS (SELECT user_id, max(revision) AS current FROM jobs_v GROUP BY user_id), e AS (SELECT j.*, current FROM jobs_v j JOIN c USING (user_id) WHERE status = 'processing') SELECT event_id, CASE WHEN revision = current THEN 'written' ELSE 'superseded' END AS outcome FROM e", views="jobs_v")
def lifecycle_two_phase_fence(t: Tables) -> DataFrame:
    """STM-02: what is no longer current when it would be written is superseded."""
    j = lc.generations(t.jobs_v, "user_id", "revision").where("status = 'processing'")
    return j.select("event_id", F.when(F.col("revision") == F.col("current"), "written").otherwise("superseded").alias("outcome"))


@query("SELECT event_id, event_type, CASE WHEN event_type = 'error' AND event_id % 12 + 1 >= 10 THEN 'dead' WHEN event_type = 'error' THEN 'retry' ELSE 'applied' END AS outcome, CASE WHEN event_type = 'error' AND event_id % 12 + 1 < 10 THEN least(2.0::DOUBLE * pow(2, event_id % 12), 300.0) END AS delay FROM events")
def lifecycle_outbox_apply(t: Tables) -> DataFrame:
    """STM-09: errors are tried again with growing delays and given up at the tenth attempt."""
    attempt = F.col("event_id") % 12 + 1
    error = F.col("event_type") == "error"
    return t.events.select("event_id", "event_type", F.when(error & (attempt >= 10), "dead").when(error, "retry").otherwise("applied").alias("outcome"), F.when(error & (attempt < 10), scores.backoff(attempt, 2.0, 300.0)).alias("delay"))


@query("SELECT user_id, count(*) AS expected, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'done') >= count(*) THEN 'done' ELSE 'running' END AS state FROM jobs_v GROUP BY user_id", views="jobs_v")
def lifecycle_rebuild_swap(t: Tables) -> DataFrame:
    """STM-14, AGG-33: a rebuild is swapped in only if all of it is done."""
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "failed")
    return t.jobs_v.groupBy("user_id").agg(F.count("*").alias("expected"), done.alias("done"), failed.alias("failed"), F.when(failed > 0, "failed").when(done >= F.count("*"), "done").otherwise("running").alias("state"))


@query("WITH p AS (SELECT user_id AS doc_id, max(ts) AS published_at FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT d.doc_id, published_at FROM documents d JOIN p USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def lifecycle_compensation(t: Tables) -> DataFrame:
    """STM-18: published documents that no job covers yet."""
    published = t.events.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("ts").alias("published_at"))
    return t.documents.select("doc_id").join(published, "doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "published_at")


@query("SELECT event_id, status, CASE WHEN status = 'failed' AND event_id % 7 < 5 THEN 'pending' ELSE status END AS after_retry, CASE WHEN status IN ('pending', 'processing') THEN 'superseded' ELSE status END AS after_cancel FROM jobs_v", views="jobs_v")
def lifecycle_job_transitions(t: Tables) -> DataFrame:
    """STM-19, DOM-45, DOM-54."""
    s = F.col("status")
    return t.jobs_v.select("event_id", "status", F.when((s == "failed") & (F.col("event_id") % 7 < 5), "pending").otherwise(s).alias("after_retry"), F.when(s.isin(*lc.LIVE), "superseded").otherwise(s).alias("after_cancel"))


@query("SELECT event_id, user_id, CASE WHEN status = 'failed' AND user_id % 3 = 0 THEN 'pending' ELSE status END AS status, status = 'failed' AND user_id % 3 = 0 AS requeued FROM jobs_v", views="jobs_v")
def lifecycle_requeue(t: Tables) -> DataFrame:
    """DOM-54: failed work of some libraries waits again, all other work stays as it is."""
    libraries = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id")).unionByName(t.events.where("user_id % 3 = 0").select("user_id")).distinct()
    return lc.requeued(t.jobs_v.select("event_id", "user_id", "status"), libraries, "user_id")


@query("SELECT doc_id, count(*) AS chunks, min(chunk_id) AS first_chunk, max(source_end) AS last_end, sum(length(text))::BIGINT AS chars FROM chunks_v GROUP BY doc_id", views="chunks_v")
def evidence_generation_counts(t: Tables) -> DataFrame:
    """DOM-06: chunks of one generation of each document."""
    return t.chunks_v.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_chunk"), F.max("source_end").alias("last_end"), F.sum(F.length("text")).alias("chars"))


@query("SELECT c.chunk_id, substr(d.text, greatest(c.source_start - 40, 0) + 1, least(c.source_end + 40, length(d.text)) - greatest(c.source_start - 40, 0)) AS window_text, substr(d.text, c.source_start + 1, c.source_end - c.source_start) = c.text AS verified FROM chunks_v c JOIN documents d USING (doc_id)", views="chunks_v")
def evidence_source_window(t: Tables) -> DataFrame:
    """DOM-08, DOM-09: a chunk's surroundings in its document, and whether the document still holds it at its place."""
    full = t.documents.select("doc_id", F.col("text").alias("full"))
    begin = F.greatest(F.col("source_start") - 40, F.lit(0))
    size = F.least(F.col("source_end") + 40, F.length("full")) - begin
    rows = t.chunks_v.join(full, "doc_id")
    return rows.select("chunk_id", F.substring("full", (begin + 1).cast("int"), size.cast("int")).alias("window_text"), (F.substring("full", (F.col("source_start") + 1).cast("int"), (F.col("source_end") - F.col("source_start")).cast("int")) == F.col("text")).alias("verified"))


@query("""WITH s AS (SELECT vec_id, label, 1 AS revision, embedding FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100, 2, embedding FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, label + 200, 3, embedding FROM embeddings WHERE vec_id % 10 = 0)
    SELECT vec_id, label, revision, len(embedding)::INT AS dimensions FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY revision DESC) AS n FROM s) WHERE n = 1""")
def sink_embedding_upsert(t: Tables) -> DataFrame:
    """SRC-15: points that are stored, and two batches of new and changed ones: the last revision of each id stays."""
    e = t.embeddings
    stored = e.where("vec_id % 3 <> 0").select("vec_id", "label", F.lit(1).alias("revision"), "embedding")
    batches = [e.where(f"vec_id % {n} = 0").select("vec_id", (F.col("label") + more).alias("label"), F.lit(k).alias("revision"), "embedding") for k, n, more in ((2, 2, 100), (3, 10, 200))]
    return lc.newest(stored.unionByName(batches[0]).unionByName(batches[1]), ["vec_id"], ["revision"]).select("vec_id", "label", "revision", F.size("embedding").alias("dimensions"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, coalesce(max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS highest_before FROM events")
def agg_next_attempt(t: Tables) -> DataFrame:
    """AGG-06, DOM-44: the number of each attempt, one more than the highest before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.row_number().over(w).cast("long").alias("attempt"), F.coalesce(F.max("event_id").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)).alias("highest_before"))
