"""Occurrences that are delivered again: what a stream of relation and entity occurrences makes of replays, changed ends and changed properties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import scores
from lodestone.sources.tables import dealt
from lodestone.streaming.events import any_written

OUTCOMES = T.StructType([T.StructField(n, kind) for n, kind in (("unit", T.LongType()), ("ordinal", T.IntegerType()), ("seq", T.LongType()), *((n, T.StringType()) for n in ("source", "target", "outcome", "held_source", "held_target")))])
#: Of each ordinal of a unit: the ends that came first, whether it was purged, and which other ends have been told.
HELD = "unit long, ordinal int, held_source string, held_target string, purged boolean, told array<struct<source: string, target: string>>"
_KEY = ["unit", "ordinal"]
#: About so many rows of a batch are shuffled at once.
AT_ONCE = 1 << 24
#: Outcomes that change what is held, and those whose own ends are the held ones.
_NEWS, _OWN = ("created", "purged", "conflict_opened"), ("created", "replayed")


def occurrences_of(rows: DataFrame) -> DataFrame:
    """The delivered rows that take part: those with a unit, ordinal and seq."""
    return rows.where("unit IS NOT NULL AND ordinal IS NOT NULL AND seq IS NOT NULL").select(F.col("unit").cast("long").alias("unit"), F.col("ordinal").cast("int").alias("ordinal"), "kind", "source", "target", F.col("seq").cast("long").alias("seq"))


def outcomes(rows: DataFrame, held: DataFrame) -> DataFrame:
    """unit, ordinal, seq, source, target, outcome, held_source, held_target of the rows of a batch. held: what the batches before have left.

    Each row's place in the order of its ordinal decides: what is held comes from the table, or from the first occurrence
    of the batch if the table does not have it.
    """
    order = [F.col("seq"), F.col("kind"), F.asc_nulls_last("source"), F.asc_nulls_last("target")]
    upto = Window.partitionBy(*_KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*_KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pair = F.struct("source", "target")
    occurs = F.coalesce(F.col("kind") != "purge", F.lit(True))
    known = rows.join(held.withColumn("_old", F.lit(True)), _KEY, "left").withColumn("_old", F.coalesce("_old", F.lit(False))).withColumn("_pair", pair)
    first = F.first(F.when(occurs, F.col("_pair")), ignorenulls=True).over(upto)
    ends = F.when(F.col("_old"), F.struct(F.col("held_source").alias("source"), F.col("held_target").alias("target"))).otherwise(first)
    known = known.withColumn("_ends", ends).withColumn("_known", F.col("_old") | F.coalesce(F.count_if(occurs).over(before) > 0, F.lit(False)))
    purging = ~occurs & F.col("_known")
    known = known.withColumn("_gone", F.coalesce("purged", F.lit(False)) | F.coalesce(F.count_if(purging).over(before) > 0, F.lit(False)))
    other = occurs & F.col("_known") & ~F.col("_gone") & ~F.col("_pair").eqNullSafe(F.col("_ends"))
    known = known.withColumn("_other", other)
    again = F.row_number().over(Window.partitionBy(*_KEY, "_other", "source", "target").orderBy("seq", "kind")) > 1
    told = F.coalesce(F.exists("told", lambda x: x.eqNullSafe(F.col("_pair"))), F.lit(False))
    outcome = scores.first_of(
        (~occurs & ~F.col("_known"), "purge_of_unknown"), (~occurs, "purged"), (~F.col("_known"), "created"), (F.col("_gone"), "error_purged"), (~F.col("_other"), "replayed"), (told | again, "conflict_known"),
        otherwise="conflict_opened",
    )
    return known.select(*_KEY, "seq", "source", "target", outcome.alias("outcome"), F.col("_ends.source").alias("held_source"), F.col("_ends.target").alias("held_target"))


def held_of(news: DataFrame) -> DataFrame:
    """What is held (HELD) after the batches whose news these are: of their outcomes (see outcomes) those that change it, of which each ordinal has one that created it."""
    first = news.where("outcome = 'created'").select(*_KEY, "held_source", "held_target")
    opened = F.array_sort(F.collect_list(F.when(F.col("outcome") == "conflict_opened", F.struct("source", "target"))))
    since = news.where("outcome <> 'created'").groupBy(*_KEY).agg(F.bool_or(F.col("outcome") == "purged").alias("purged"), opened.alias("told"))
    return first.join(since, _KEY, "left")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes as they were told, with batch and news; files leave out the held ends of those that have them as their own."""
    rows = spark.read.schema(T.StructType([*OUTCOMES.fields, T.StructField("batch", T.LongType()), T.StructField("news", T.BooleanType())])).parquet(f"{folder}/rows")
    own = F.col("outcome").isin(*_OWN)
    return rows.withColumns({f"held_{end}": F.when(own, F.col(end)).otherwise(F.col(f"held_{end}")) for end in ("source", "target")})


def replayed(occurrences: DataFrame, folder: str, taken: Callable[[DataFrame], DataFrame] | None = None, *, at_once: int = AT_ONCE) -> DataFrame:
    """unit, ordinal, seq, source, target, outcome, held_source, held_target and batch of each delivered row of a stream, run until its source is read; run again over the same folder it goes on where it was.

    occurrences: unit, ordinal, kind (occurrence or purge), source, target, seq (the rows of an ordinal count in its order
    within a batch, and batches as they come). An ordinal's first occurrence is created. The same ends again are a replay
    and change nothing; other ends open a conflict, once for each pair of ends, and what is held stays; nothing may come for
    an ordinal that was purged, and a purge of what is not held changes nothing. Rows without a unit, ordinal or seq take no
    part; null ends are ends like others. What is held (of each ordinal the ends that came first, the other ones that were
    told, and whether it was purged) is no table of its own: it follows from the outcomes that were news, which lie apart
    from those that repeat. Each batch reads the news of those before and writes its own outcomes, so a batch that is run
    again replaces itself. A large batch is done in parts by ordinal, of about `at_once` rows each: the shuffle files of
    a part go when it is written, so what lies on disk beside the outcomes does not grow with the batch.

    taken: where the rows of the stream are notices, gives the occurrences that the notices of a batch stand for, from
    where they lie; it must give the same ones if it is asked again.
    """

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession  # the stream's own
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        rows = occurrences_of(taken(rows) if taken else rows)
        n, held = rows.count(), held_of(_rows(spark, folder).where((F.col("batch") < batch) & F.col("news"))) if batch else spark.createDataFrame([], HELD)
        parts, own = max(1, -(-n // at_once)), F.col("outcome").isin(*_OWN)
        for k in range(parts):
            here = F.pmod(F.xxhash64(*_KEY), F.lit(parts)) == k
            told = outcomes(dealt(rows.where(here), n // parts, *_KEY), held.where(here))
            brief = told.withColumns({f"held_{end}": F.when(~own, F.col(f"held_{end}")) for end in ("source", "target")}).withColumn("news", F.col("outcome").isin(*_NEWS))
            brief.write.mode("append" if k else "overwrite").partitionBy("news").option("compression", "zstd").parquet(f"{folder}/rows/batch={batch}")

    occurrences.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark, schema = occurrences.sparkSession, T.StructType([*OUTCOMES.fields, T.StructField("batch", T.LongType())])
    return _rows(spark, folder).select(*schema.names) if any_written(spark, folder) else spark.createDataFrame([], schema)


def _value_hash(x: Column) -> Column:
    """Digest of a text's JSON."""
    held = F.to_json(F.struct(x.alias("v")))  # {"v":...}
    return F.sha2(F.substring(held, F.lit(6), F.length(held) - 6), 256)


def conflict_key(kind: str, entities: Column, relations: Column, fields: Column) -> Column:
    """Digest of a conflict's identity in canonical JSON: type, ids, and the fields with their value hashes."""
    return scores.value_hash(conflict_type=F.lit(kind), conflicting_fields=fields, entity_candidate_ids=entities, relation_candidate_ids=relations)


def endpoint_conflicts(outcomes: DataFrame) -> DataFrame:
    """conflict_key, unit, ordinal, fields, status, errors: the conflicts that replays opened; fields: those ends that differ, by name, with the sorted hashes of both values."""
    none = F.array().cast("array<string>")
    pair = lambda name, a, b: F.when(~F.col(a).eqNullSafe(F.col(b)), F.struct(F.lit(name).alias("field"), F.array_sort(F.array(_value_hash(F.coalesce(a, F.lit("None"))), _value_hash(F.coalesce(b, F.lit("None"))))).alias("value_hashes")))
    fields = F.filter(F.array(pair("source_candidate_id", "held_source", "source"), pair("target_candidate_id", "held_target", "target")), lambda x: x.isNotNull())
    relation = F.array(F.concat_ws("-", F.col("unit").cast("string"), F.col("ordinal").cast("string")))
    rows = outcomes.where("outcome = 'conflict_opened'").withColumn("fields", fields)
    return rows.select(conflict_key("endpoint_mismatch", none, relation, F.col("fields")).alias("conflict_key"), "unit", "ordinal", "fields", F.lit("open").alias("status"), F.transform("fields", lambda x: F.concat(F.lit("endpoint_mismatch:"), x["field"])).alias("errors"))


def property_sets(occurrences: DataFrame, properties: list[str]) -> DataFrame:
    """candidate and, of each property, the sorted different values so far: a stream in update mode, whose state is these sets. occurrences: candidate and the properties."""
    sets = [F.array_sort(F.collect_set(F.col(p).cast("string"))).alias(p) for p in properties]
    return occurrences.where("candidate IS NOT NULL").groupBy("candidate").agg(*sets)


def property_conflicts(updates: DataFrame, properties: list[str]) -> DataFrame:
    """conflict_key, candidate, fields, status, batch: each conflict that a candidate's properties have made, of which the last one is open and those before are superseded.

    updates: of `property_sets`, drained with `batch`. A property with several different values is in conflict, and a
    conflict is told by the fields and the hashes of their values, so one that does not change is no new one.
    """
    field = lambda p: F.when(F.size(p) > 1, F.struct(F.lit(p).alias("field"), F.array_sort(F.transform(p, _value_hash)).alias("value_hashes")))
    rows = updates.withColumn("fields", F.filter(F.array(*[field(p) for p in sorted(properties)]), lambda x: x.isNotNull())).where("size(fields) > 0")
    keyed = rows.withColumn("conflict_key", conflict_key("property_conflict", F.array(F.col("candidate").cast("string")), F.array().cast("array<string>"), F.col("fields")))
    first = keyed.groupBy("candidate", "conflict_key").agg(F.min("batch").alias("batch"), F.min_by("fields", "batch").alias("fields"))
    last = F.max("batch").over(Window.partitionBy("candidate"))  # as many as a candidate's properties have values
    return first.select("conflict_key", "candidate", "fields", F.when(F.col("batch") == last, "open").otherwise("superseded").alias("status"), "batch")
