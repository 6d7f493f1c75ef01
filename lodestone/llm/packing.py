"""Packing into padded batches with optimal length buckets.

The histogram of all lengths goes into a dynamic programme that chooses the upper ends of at most `buckets` buckets so
that padding each text up to its bucket's end costs the fewest tokens over the whole table. Inside a bucket, batches hold
as many texts as fit the token budget at the padded length; a text longer than the budget is a batch of its own.

The histogram has a row for each length that occurs, at most as many as the longest text has words, and every bucket ends
at the length of a text in it. Places inside a bucket come from counts of (bucket, salt) groups and places within these,
so no bucket meets in one task.

Texts are counted in words between blanks. Null and empty texts have length 0; they get bucket -1, batch -1 and place -1,
as there is nothing to pack. Rows are placed by length and id; rows that repeat an id have each a place of their own, and
which of rows equal in both comes first does not matter. A null id is placed as all others. A text however long is one
row, in a batch of its own if it is over the budget. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common, words


def bucket_ends(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ends of at most `buckets` buckets with the least padding. lengths: ascending, above 0; the last one is always an end.

    With a[j] the count of texts up to the jth length, a bucket of lengths i+1..j costs lengths[j] * (a[j] - a[i]) less a part
    that all choices share. The best i never falls as j grows, so the middle j of a range bounds the choices of both halves;
    all ranges of one depth are worked out in one array expression.
    """
    n = len(lengths)
    if not n:
        return []
    lengths = lengths.astype(float)
    a = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    best = np.full(n + 1, np.inf)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, n)):
        now, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0
        low, high, least, most = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(low):
            j = (low + high) // 2
            sizes = np.minimum(most, j - 1) - least + 1
            begin = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(j)), sizes)
            i = np.arange(len(owner)) - (begin - least)[owner]
            cost = best[i] - lengths[j - 1][owner] * a[i]
            found = np.minimum.reduceat(cost, begin)
            at = np.flatnonzero(cost == found[owner])
            choice[j] = i[at[np.unique(owner[at], return_index=True)[1]]]
            now[j] = found + lengths[j - 1] * a[j]
            low, high, least, most = (np.concatenate(x) for x in ((low, j + 1), (j - 1, high), (least, choice[j]), (choice[j], most)))
            some = low <= high
            low, high, least, most = low[some], high[some], least[some], most[some]
        best = now
        choices.append(choice)
    ends, j = [], n
    for choice in reversed(choices):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = choice[j]
    return ends[::-1]


def n_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [np.zeros(0, np.int64)]
        for _, _, data, offsets in common.slices(b.column("text")):
            word = words.NOT_SPACE[data]
            begins = word.copy()
            begins[1:] &= ~word[:-1]
            at = offsets[:-1][np.diff(offsets) > 0]
            begins[at] = word[at]
            counts.append(np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(counts), pa.int64())], names=["doc_id", "n_tokens"])


def pack(docs: DataFrame, *, length: Column | None = None, buckets: int = 16, budget: int = 16384, salts: int | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), padded_to, batch (within its bucket, from 0) and place (within its batch)."""
    spark = docs.sparkSession
    if length is None:
        measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(n_words, "doc_id long, n_tokens long")
    else:
        measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"))
    measured = common.saved(measured, "lengths")
    histogram = measured.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()  # a row for each length that occurs
    counts = histogram["n"].to_numpy()
    ends = bucket_ends(histogram["n_tokens"].to_numpy(), counts, buckets)
    total = int(counts.sum())
    salts = salts or max(1, total // 4000)
    array = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array().cast("array<bigint>")
    bucket = F.when(F.col("n_tokens") > 0, F.size(F.filter(array, lambda e: e < F.col("n_tokens")))).otherwise(F.lit(-1))
    placed = measured.withColumn("bucket", bucket.cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(salts)))
    counts = placed.groupBy("bucket", "salt").agg(F.count("*").alias("n"))
    block = F.floor(F.col("salt") / 1024)  # offsets in two steps: of blocks of salts, then within each
    blocks = counts.groupBy("bucket", block.alias("block")).agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bucket", "block").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("block", block).withColumn("inside", inside).join(blocks.withColumn("before", before).drop("n"), ["bucket", "block"]).select("bucket", "salt", (F.col("before") + F.col("inside")).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("n_tokens", "doc_id")) - 1
    rows = placed.withColumn("nth", nth).join(offsets, ["bucket", "salt"]).withColumn("nth", F.col("nth") + F.col("offset"))
    sizes = spark.createDataFrame([(k, e, max(1, budget // e)) for k, e in enumerate(ends)], "bucket int, padded_to long, capacity long")
    rows = rows.join(F.broadcast(sizes), "bucket", "left")  # a row for each bucket
    return rows.select("doc_id", "n_tokens", "bucket", F.coalesce("padded_to", F.lit(0)).alias("padded_to"), F.coalesce(F.floor(F.col("nth") / F.col("capacity")), F.lit(-1)).alias("batch"), F.coalesce(F.col("nth") % F.col("capacity"), F.lit(-1)).alias("place"))
