"""Hard negatives against all pairs scored plainly, with ties, hot labels, repeated rows and digits of every size."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from lodestone.llm import negatives, queries
from tests.llm.conftest import CLASHING

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=10, k=5, low=80, high=100):
    """The result by scoring all pairs. rows: id, vector, label."""
    best = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            best[i] = min(best.get(i, (label, v)), (label, v))
    points = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (label, v) in best.items()]
    out = []
    for a, label, v in points:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, other, w in points if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:k]:
            hard = [(i, -n) for n, i, own in scored if not own and low * -s <= 100 * -n <= high * -s][:k]
            out += [(a, p, r + 1, i, -s, n) for r, (i, n) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, every=10, **options):
    vectors = spark.createDataFrame(rows, SCHEMA)
    for name in (*CLASHING, "dim", "w", "lo", "i", "j", "id", "vector"):
        vectors = vectors.withColumn(f"{name}" if name not in vectors.columns else f"{name}_", F.lit("clash"))
    found = negatives.hard_negatives(vectors.repartition(5), F.col("vec_id") % every == 0, F.col("label"), **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def points(n, dim=8, labels=4, seed=0, spread=0.6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(3, dim))
    return [(k, [float(x) for x in centre[k % 3] + spread * rng.normal(size=dim)], int(rng.integers(labels))) for k in range(n)]


def test_same_as_sql(spark, same_as_sql):
    same_as_sql(queries.op13_hard_negatives(spark, SMALL), queries.ORACLE_SQL["op13_hard_negatives"])


@pytest.mark.parametrize("base", [2, 10, 1024])
def test_same_as_all_pairs_whatever_the_digits(spark, base):
    rows = points(300 if base > 2 else 80)
    expected = plain(rows)
    assert len(expected) > 100
    assert mined(spark, rows, base=base, rows_a_block=64, anchors_a_block=9) == expected


def test_other_windows_and_numbers(spark):
    rows = points(200, seed=1)
    assert mined(spark, rows, positives=3, negatives=3, low=50, high=90) == plain(rows, k=3, low=50, high=90)


def test_ties_and_a_vector_that_most_rows_share(spark):
    """Two rows in three have one vector, of two labels; scores tie by the hundred, so ids decide."""
    same = [0.5, 0.25, -0.125, 1.0]
    rows = [(k, same, k % 2) for k in range(400)] + [(1_000 + k, [0.5, 0.25, -0.125, 1.0 - k % 3 / 256], 3) for k in range(200)]
    expected = plain(rows)
    assert {r[3] for r in expected if r[0] == 0} == {1, 3, 5, 7, 9}
    assert mined(spark, rows, rows_a_block=50) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = points(120, seed=2) + [
        (None, [1.0] * 8, 1), (200, None, 1), (210, [1.0] * 8, None), (220, [1.0, None] + [0.0] * 6, 2), (230, [nan] + [1.0] * 7, 2), (240, [inf] + [1.0] * 7, 2), (250, [-inf] + [1.0] * 7, 2),
        (260, [0.0] * 8, 1), (270, [], 1), (271, [], 2), (272, [], 1), (280, [1.0, 2.0], 1), (281, [1.0, 2.0], 1), (282, [1.0, 1.9], 3), (290, [5.0], 1),
        (10, [9.0] * 8, 3), (10, [9.0] * 8, 3), (11, [0.5] * 8, 0), (11, [0.25] * 8, 0), (-20, [1.0] * 8, 2), (-21, [1.0] * 8, 2),
    ]
    expected = plain(rows)
    assert any(r[0] == 270 and r[4:] == (0, 0) for r in expected) and any(r[0] == 280 for r in expected) and any(r[0] == -20 for r in expected)
    assert mined(spark, rows) == expected


def test_one_label_only_and_nothing(spark):
    assert mined(spark, [(k, [1.0, float(k)], 1) for k in range(50)]) == []
    assert mined(spark, [(k, [1.0, float(k)], k) for k in range(1, 10)]) == []
    assert mined(spark, []) == []


def test_large_components(spark):
    """Scores beyond the whole numbers that doubles hold, and beyond what is allowed."""
    rows = [(k, [2.0**18 + k, float(k % 7), -3.0 * k], k % 3) for k in range(60)]
    assert mined(spark, rows) == plain(rows)
    with pytest.raises(ValueError, match="too long"):
        mined(spark, [(0, [2.0**30], 1), (1, [1.0], 1)])


def test_counts_hold_the_sought_score():
    """What a task leaves out lies below the bucket of its own k-th score."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = rng.integers(-50, 400, size=rng.integers(1, 80))
        w = {"lo": -50, "hi": 399, "top": 399, "need": int(rng.integers(1, 9))}
        buckets, n = negatives._counted(16)(w, scores, scores)
        step = -(-450 // 16)
        assert all(n[k] == np.sum((scores + 50) // step == b) for k, b in enumerate(buckets))
        assert n.sum() >= min(w["need"], len(scores)) and (n[:-1].sum() < w["need"])
        assert set(np.unique((scores + 50) // step)) - set(buckets) == {b for b in np.unique((scores + 50) // step) if b < buckets.min()}
