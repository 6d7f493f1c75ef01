"""Quality measures: ranked hits, set precision and recall, rates in millionths, latency percentiles, threshold grids, bootstrap."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hits(ranked: DataFrame, hit: Column) -> DataFrame:
    """query_id, first_hit (null if none of its ranks is one)."""
    return ranked.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first_hit"))


def hit_rates(first: DataFrame, ks: tuple[int, ...] = (1, 3, 5), by: list[str] | None = None) -> DataFrame:
    """by, queries, hit_at_k of each k, and mrr; a query without a hit counts as a miss."""
    hits = [F.round(F.avg(F.coalesce(F.col("first_hit") <= k, F.lit(False)).cast("double")), 9).alias(f"hit_at_{k}") for k in ks]
    return first.groupBy(*(by or [])).agg(F.count("*").alias("queries"), *hits, F.round(F.sum(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))) / F.count("*"), 9).alias("mrr"))


def set_scores(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn of distinct keys, and precision and recall (null over nothing)."""
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, keys, "full_outer")
    tp, fp, fn = (F.count_if(c) for c in (F.col("_g").isNotNull() & F.col("_p").isNotNull(), F.col("_g").isNull(), F.col("_p").isNull()))
    counts = both.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return counts.select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 9).alias("recall"))


def latency_summary(samples: DataFrame, by: str, size: int = 30) -> DataFrame:
    """by, p50, p95 and most of groups of exactly `size` samples (the 15th, the 29th and the last of 30); groups of another size have nulls. samples: by, micros."""
    n = samples.groupBy(by).agg(F.count("*").alias("n"))
    few = samples.join(n.where(F.col("n") == size).select(by), by, "left_semi").groupBy(by).agg(F.array_sort(F.collect_list("micros")).alias("_all"))  # `size` samples at most
    at = lambda k: F.try_element_at("_all", F.lit(k))
    return n.join(few, by, "left").select(by, "n", at(size // 2).alias("p50"), at(size - size // 30).alias("p95"), at(size).alias("most"))


def threshold_grid(cases: DataFrame, scores: list[int], margins: list[int]) -> DataFrame:
    """For each pair of thresholds: cases linked, linked right, wrong, not linked. cases: score, margin, right."""
    points = []
    for low in scores:
        for gap in margins:
            linked = F.coalesce((F.col("score") >= low) & (F.col("margin") >= gap), F.lit(False))
            counts = {"linked": linked, "right": linked & F.col("right"), "wrong": linked & ~F.col("right"), "abstained": ~linked}
            points.append(F.struct(F.lit(low).cast("long").alias("min_score"), F.lit(gap).cast("long").alias("min_margin"), *[F.count_if(c).alias(n) for n, c in counts.items()]))
    return cases.agg(F.array(*points).alias("points")).select(F.inline("points"))  # one pass over the cases


def best_of_grid(grid: DataFrame, max_wrong: int) -> DataFrame:
    """The eligible point with the most links; of equal ones that with the higher score, then margin."""
    ok = grid.where(F.col("wrong") <= max_wrong)
    best = F.max_by(F.struct("min_score", "min_margin", "linked", "right", "wrong"), F.struct("linked", "min_score", "min_margin"))
    return ok.agg(best.alias("b"), F.count("*").alias("eligible")).select("b.*", "eligible").where("linked IS NOT NULL")


def paired_bootstrap(cases: DataFrame, stratum: str, a: str, b: str, *, replicates: int = 10_000, seed: int = 0, parallelism: int = 16, most: int = 100_000) -> DataFrame:
    """replicate, difference: mean of a - b over cases drawn anew within each stratum.

    Cases enter by the counts of each distinct difference, to six digits, in a stratum: at most `most` of them, as scores in
    steps (an evaluation set's rates) have; more are an error. Replicates are dealt out to tasks, each with a generator seeded by its own number.
    """
    diff = (F.col(a) - F.col(b)).cast("double")
    counts = cases.groupBy(F.col(stratum).cast("string").alias("s"), F.round(diff, 6).alias("d")).count().limit(most + 1).toPandas().sort_values(["s", "d"])
    if len(counts) > most:
        raise ValueError(f"over {most} distinct differences: round the scores first")
    strata = [(g["d"].to_numpy(float), g["count"].to_numpy(np.int64)) for _, g in counts.groupby("s", sort=True)]
    total = int(counts["count"].sum()) if len(counts) else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch["id"]:
                rng = np.random.Generator(np.random.MT19937(random.Random(seed * 1_000_003 + int(r)).getrandbits(64)))
                s = sum(float(rng.multinomial(n.sum(), n / n.sum()) @ d) for d, n in strata)
                out.append(s / total if total else 0.0)
            yield pd.DataFrame({"replicate": batch["id"], "difference": out})

    return cases.sparkSession.range(0, replicates, 1, parallelism).mapInPandas(run, "replicate long, difference double")


def interval(replicates: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return replicates.agg(F.expr(f"percentile_disc({low}) WITHIN GROUP (ORDER BY difference)").alias("low"), F.expr(f"percentile_disc({high}) WITHIN GROUP (ORDER BY difference)").alias("high"), F.avg("difference").alias("mean"))
