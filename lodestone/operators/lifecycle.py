"""Versions of documents and the work on them: identity, upserts, generations, outbox, tombstones, leases, retention, rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIVE = ("pending", "processing")


def identity_key(library: Column, sync_source: Column, external_id: Column, content_hash: Column) -> Column:
    """What makes two live rows one document: source and external id, or external id alone, or the content."""
    return F.when(sync_source.isNotNull() & external_id.isNotNull(), F.concat_ws("|", F.lit("s"), library, sync_source, external_id)).when(external_id.isNotNull(), F.concat_ws("|", F.lit("e"), library, external_id)).otherwise(F.concat_ws("|", F.lit("h"), library, content_hash))


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order, by a partial aggregate instead of a sort of whole groups."""
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(last).select(*keys, "_row.*")


def upsert_actions(stored: DataFrame, incoming: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key and action (insert, update, noop, keep) of each row of either side; nulls are values when compared."""
    s = stored.select(key, F.struct(*compared).alias("_old"), F.lit(True).alias("_s"))
    n = incoming.select(key, F.struct(*compared).alias("_new"), F.lit(True).alias("_n"))
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_n").isNull(), "keep").when(F.col("_old").eqNullSafe(F.col("_new")), "noop").otherwise("update")
    return s.join(n, key, "full_outer").select(key, action.alias("action"))


def merged(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """stored with changes (the same columns and `action`: upsert or delete) applied; a change's null keeps the stored value."""
    others = [c for c in stored.columns if c != key]
    c = changes.select(key, "action", *[F.col(x).alias(f"_{x}") for x in others])
    both = stored.join(c, key, "full_outer").where(~F.coalesce(F.col("action") == "delete", F.lit(False)))
    return both.select(key, *[F.coalesce(f"_{x}", x).alias(x) for x in others])


def generations(jobs: DataFrame, key: str, revision: str) -> DataFrame:
    """jobs with `current` (the key's highest revision) and `fenced` status: of an older revision, live work is superseded."""
    top = jobs.groupBy(key).agg(F.max(revision).alias("current"))
    stale = F.col(revision) < F.col("current")
    return jobs.join(top, key).withColumn("fenced", F.when(stale & F.col("status").isin(*LIVE, "done"), "superseded").otherwise(F.col("status")))


def published_history(events: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """Each publication with the time it held: from its own to the next one of its key; the last is current."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w)).withColumn("is_current", F.col("valid_to").isNull())


def outbox(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first event of each idempotency key."""
    others = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row")).select(*key, "_row.*")


def recovered(jobs: DataFrame, now: Column, stale_seconds: int, max_attempts: int) -> DataFrame:
    """jobs with `next_status`: processing for too long is requeued while attempts are left, else failed."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    stale = (F.col("status") == "processing") & (age > stale_seconds)
    return jobs.withColumn("next_status", F.when(stale & (F.col("attempts") >= max_attempts), "failed").when(stale, "pending").otherwise(F.col("status")))


def purged(rows: DataFrame, due: Column, columns: list[str], now: Column) -> DataFrame:
    """rows, kept, with the sensitive columns of due ones set to null and `purged_at` stamped."""
    for c in columns:
        rows = rows.withColumn(c, F.when(~F.coalesce(due, F.lit(False)), F.col(c)))
    return rows.withColumn("purged_at", F.when(due, now))


def before_revision(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """rows that a delete-before-revision leaves: those at or after the key's target (a missing revision is before any)."""
    return rows.join(targets.select(key, F.col("revision").alias("_target")), key, "left").where(F.col("_target").isNull() | (F.coalesce("revision", F.lit(-1)) >= F.col("_target"))).drop("_target")


def requeued(jobs: DataFrame, libraries: DataFrame, library: str) -> DataFrame:
    """jobs with failed work of the given libraries waiting again, and whether it was requeued."""
    chosen = libraries.select(library, F.lit(True).alias("_chosen"))
    again = (F.col("status") == "failed") & F.col("_chosen").isNotNull()
    return jobs.join(chosen, library, "left").withColumn("requeued", again).withColumn("status", F.when(F.col("requeued"), "pending").otherwise(F.col("status"))).drop("_chosen")
