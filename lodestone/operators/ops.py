"""Operations: status counts, progress, service states, pages, claims, permissions, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_counts(rows: DataFrame, by: list[str], statuses: list[str]) -> DataFrame:
    """A column for each status, 0 if there is none, and the total."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.count("*").alias("total"))


def folded_state(rows: DataFrame, by: str) -> DataFrame:
    """A job's state from its units': processing while any is live; else failed or partially_succeeded if any failed; else succeeded."""
    live, failed, done = (F.count_if(F.col("status").isin(*s)) for s in (("pending", "processing"), ("failed", "superseded"), ("done",)))
    state = F.when(live > 0, "processing").when((failed > 0) & (done > 0), "partially_succeeded").when(failed > 0, "failed").otherwise("succeeded")
    return rows.groupBy(by).agg(live.alias("live"), failed.alias("failed"), done.alias("done"), state.alias("state"))


def offset_page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def keyset_page(rows: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """The next rows by key, with has_more: one row more than asked for is looked at."""
    page = rows.where(F.col(key) > after).orderBy(key).limit(limit + 1)
    w = Window.orderBy(key)  # over limit + 1 rows
    return page.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def service_states(beats: DataFrame, service: str, at: Column, now: Column, online_seconds: int) -> DataFrame:
    """online, degraded or offline of each service by its instances' last beats; stopping ones do not count."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("seen").cast("timestamp"))
    last = beats.groupBy(service, "instance").agg(F.max(at).alias("seen"), F.max_by("state", F.struct(at, F.col("event_id"))).alias("state"))
    live = (age <= online_seconds) & (F.col("state") != "stopping")
    n, bad = F.count_if(live), F.count_if(live & (F.col("state") == "degraded"))
    return last.groupBy(service).agg(n.alias("online"), bad.alias("degraded"), F.when(n == 0, "offline").when(bad > 0, "degraded").otherwise("online").alias("status"), F.max(F.struct("seen", "instance"))["instance"].alias("latest"))


def permitted(rows: DataFrame, grants: DataFrame, library: str, action: str) -> DataFrame:
    """user_id and the rows of the libraries in which the user may do the action. grants: user_id, library, action."""
    return rows.join(grants.where(F.col("action") == action).select("user_id", F.col("library").alias(library)).distinct(), library)


def recent_turns(messages: DataFrame, n: int) -> DataFrame:
    """The last 2 n turns of each conversation, oldest first, without blank answers."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = messages.withColumn("_n", place).where(F.col("_n") <= 2 * n).drop("_n").where(~((F.col("role") == "assistant") & (F.trim("text") == "")))
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))


def packed(messages: DataFrame, budget: int) -> DataFrame:
    """Blocks of each conversation in order until `budget` characters are used; the last one is cut to fit."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = messages.withColumn("used", before).where(F.col("used") < budget)
    return rows.withColumn("block", F.substring("text", F.lit(1), (F.lit(budget) - F.col("used")).cast("int")))
