"""Hard negatives by distributed radix selection.

Scores are whole numbers: inner products of vectors whose components were multiplied by SCALE and rounded down. For each
anchor the best rows of its own label are sought, its positives, and for each of these the best rows of other labels whose
scores lie in a window that the positive's score sets. Both are one search: the k greatest scores of a window.

The k-th score of each window is found digit by digit. Every task counts the scores of its rows in each window's buckets
and sends on the counts of the highest buckets, as far as these hold k; lower ones cannot hold the k-th score of all. The
sums tell in which bucket it lies; this bucket is the next window, until it is one score wide. A last pass gathers the rows
above that score, fewer than k, and of those at it the smallest ids, as many as the window still needs from each task. So
no list of candidates grows with a window's rows, however many of them are equal.

Scores are not kept but computed in each pass: blocks of anchors meet blocks of rows, and a task holds one of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common

#: Fixed value: what components are multiplied by.
SCALE = 256
#: So many anchors are scored against a block of rows at once.
TILE = 64
#: Scores must stay below this, so that a hundred times a score is a 64-bit number.
GREATEST = 1 << 55


def participants(vectors: DataFrame, label: Column, *, id_column: str, vector_column: str) -> DataFrame:
    """id, label, vector, dim of the rows that take part: one for each id, of several the one with the smallest label, then vector."""
    vector = F.col(vector_column)
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = vectors.where(F.col(id_column).isNotNull() & vector.isNotNull() & label.isNotNull() & finite)
    one = rows.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.min(F.struct(label.cast("long").alias("label"), vector.cast("array<double>").alias("vector"))).alias("row"))
    return one.select("id", "row.label", "row.vector", F.size("row.vector").alias("dim"))


def _quantised(column: pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(len(column), dim).astype(kind)


def _in_windows(key: tuple, asked: pa.Table, rows: pa.Table, same: bool, kind: type) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray]]:
    """Anchor, window, and the scores and ids of the block's rows from the window's lower end to its top."""
    dim = key[0].as_py()
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    own, own_labels, windows = asked["id"].to_numpy(), asked["label"].to_numpy(), asked["windows"].to_pylist()
    right, left = _quantised(rows["vector"], dim, kind), _quantised(asked["vector"], dim, kind)
    for first in range(0, len(left), TILE):
        found = left[first : first + TILE] @ right.T
        least = np.array([min(w["lo"] for w in ws) for ws in windows[first : first + TILE]])[:, None]
        most = np.array([max(w["top"] for w in ws) for ws in windows[first : first + TILE]])[:, None]
        inside = (found >= least) & (found <= most)
        inside &= (labels == own_labels[first : first + TILE, None]) == same
        inside &= ids != own[first : first + TILE, None]
        for k in range(len(found)):
            at = np.flatnonzero(inside[k])
            scores = found[k, at].astype(np.int64)
            for w in windows[first + k]:
                here = (scores >= w["lo"]) & (scores <= w["top"])
                yield int(own[first + k]), w, scores[here], ids[at[here]]


def _counted(base: int) -> Callable:
    """For each window the counts of its highest buckets that together hold as many rows as it needs."""

    def count(w: dict, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = (w["hi"] - w["lo"] + base) // base
        per_bucket = np.bincount((scores[scores <= w["hi"]] - w["lo"]) // step)
        full = np.flatnonzero(per_bucket)[::-1]
        full = full[: np.searchsorted(np.cumsum(per_bucket[full]), w["need"]) + 1]
        return full, per_bucket[full]

    return count


def _gathered(w: dict, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the rows above the window's lower end, and of the smallest ids at it."""
    above, level = scores > w["lo"], np.sort(ids[scores == w["lo"]])[: w["need"]]
    return np.concatenate((ids[above], level)), np.concatenate((scores[above], np.full(len(level), w["lo"], np.int64)))


def _pass(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, kind: type, per_window: Callable, names: tuple[str, str]) -> DataFrame:
    """anchor, w and two columns that per_window makes of the rows of each block that lie in the window."""
    per_anchor = windows.groupBy("anchor").agg(F.collect_list(F.struct("w", "lo", "hi", "top", "need")).alias("windows"))  # as many as an anchor has positives
    asked = anchors.join(per_anchor, anchors.id == per_anchor.anchor).drop("anchor").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rows_in") - 1)))
    rows = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("anchors_in") - 1)))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        anchor, w, one, two = [], [], [], []
        for a, window, scores, ids in _in_windows(key, left, right, same, kind) if left.num_rows and right.num_rows else ():
            x, y = per_window(window, scores, ids) if len(scores) else ((), ())
            anchor.append(np.full(len(x), a))
            w.append(np.full(len(x), window["w"]))
            one.append(x)
            two.append(y)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in (anchor, w, one, two)]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["anchor", "w", *names])

    place = ["dim", "i", "j"]
    asked, rows = asked.select(*place, "id", "label", "vector", "windows"), rows.select(*place, "id", "label", "vector")
    return asked.groupBy(*place).cogroup(rows.groupBy(*place)).applyInArrow(run, f"anchor long, w long, {names[0]} long, {names[1]} long")


def greatest(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, *, same: bool, width: int, base: int, kind: type) -> DataFrame:
    """anchor, w, id, score, rank: the `need` greatest scores from lo to hi of each window, ties by the smaller id. windows: anchor, w, lo, hi, top (hi again) and need; none is wider than width."""
    state, keys = windows, ["anchor", "w"]
    while width > 1:
        counts = _pass(blocks, anchors, state.where("lo < hi"), same, kind, _counted(base), ("bucket", "n"))
        sums = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")).join(state.select(*keys, "need"), keys)
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0))  # `base` buckets at most
        at = sums.withColumn("upto", upto).where("upto >= need AND upto - n < need").select(*keys, "bucket", (F.col("upto") - F.col("n")).alias("above"))
        step = F.expr(f"(hi - lo + {base}) div {base}")
        lower = F.when(F.col("bucket").isNull(), F.col("lo")).otherwise(F.col("lo") + F.col("bucket") * step)  # no bucket: fewer rows than needed, all are taken
        upper = F.when(F.col("bucket").isNull(), F.col("lo")).otherwise(F.least("hi", lower + step - 1))
        state = common.saved(state.join(at, keys, "left").select(*keys, lower.alias("lo"), upper.alias("hi"), "top", (F.col("need") - F.coalesce("above", F.lit(0))).alias("need")), "negatives-windows")
        width = -(-width // base)
    rows = _pass(blocks, anchors, state, same, kind, _gathered, ("id", "score"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    wanted = windows.select(*keys, F.col("need").alias("wanted"))
    return rows.withColumn("rank", rank).join(wanted, keys).where(F.col("rank") <= F.col("wanted")).drop("wanted")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, *, id_column: str = "vec_id", vector_column: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, base: int = 1024, rows_a_block: int = 4096, anchors_a_block: int = 1024,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each anchor and each of its positives, the best of the hard negatives.

    is_anchor and label are expressions over vectors' columns. Positives are an anchor's `positives` other rows of its label
    with the greatest scores; hard negatives of a positive are the `negatives` rows of other labels with the greatest scores
    s for which low * p <= 100 * s <= high * p, where p is the positive's score (so a negative p has none). Ties go to the
    smaller id; where there are fewer rows, all count. Pairs without a hard negative give no row.

    Rows with a null id, label or vector, or with components that are null or not finite, take no part. Of rows that repeat
    an id only the one with the smallest label, then vector, does. Rows of other lengths than an anchor's are not compared
    with it; empty vectors score 0. No pair is skipped, however many rows share a label or a vector: the work is the product
    of anchors and rows. A norm whose square passes GREATEST raises an error. Empty tables, or no anchors, give no rows;
    further columns, whatever their names, are not looked at.
    """
    flagged = vectors.select(F.col(id_column).alias("_id"), F.col(vector_column).alias("_vector"), label.alias("_label"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    points = common.saved(participants(flagged, F.col("_label"), id_column="_id", vector_column="_vector"), "negatives-points")
    asked = common.saved(flagged.where("_anchor AND _id IS NOT NULL").select(F.col("_id").cast("long").alias("id")).distinct(), "negatives-anchors")
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + F.pow(F.floor(x * SCALE).cast("double"), F.lit(2.0)))
    chosen = common.saved(points.join(asked, "id", "left_semi"), "negatives-asked")
    sizes = points.groupBy("dim").agg(F.ceil(F.count("*") / rows_a_block).cast("int").alias("rows_in"), F.max(square).alias("square"))
    sizes = common.saved(sizes.join(chosen.groupBy("dim").agg(F.ceil(F.count("*") / anchors_a_block).cast("int").alias("anchors_in")), "dim"), "negatives-sizes")
    bound = sizes.agg(F.max("square")).first()[0] or 0.0
    if bound >= GREATEST:
        raise ValueError("vectors are too long: scores would not be 64-bit numbers")
    bound, kind = int(bound) + 1, np.float64 if bound < 1 << 52 else np.int64
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    blocks = points.join(sizes, "dim").withColumn("j", at("rows_in"))
    anchors = chosen.join(sizes, "dim").withColumn("i", at("anchors_in")).select("dim", "i", "id", "label", "vector", "rows_in")
    find = lambda windows, same, width, name: common.saved(greatest(blocks, anchors, windows, same=same, width=width, base=base, kind=kind), name)
    every = chosen.select(F.col("id").alias("anchor"), F.lit(0).cast("long").alias("w"), *[F.lit(x).cast("long").alias(n) for n, x in (("lo", -bound), ("hi", bound), ("top", bound), ("need", positives))])
    near = find(every, True, 2 * bound + 1, "negatives-positives").select("anchor", F.col("id").alias("w"), F.col("score").alias("p"))
    ends = near.where("p >= 0").selectExpr("anchor", "w", f"({low} * p + 99) div 100 AS lo", f"({high} * p) div 100 AS hi")
    windows = ends.where("lo <= hi").selectExpr("anchor", "w", "lo", "hi", "hi AS top", f"cast({negatives} AS long) AS need")
    hard = find(windows, False, bound * max(high, 100) // 100 + 1, "negatives-found")
    return hard.join(near, ["anchor", "w"]).select(
        F.col("anchor").alias("anchor_id"), F.col("w").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"),
    )
