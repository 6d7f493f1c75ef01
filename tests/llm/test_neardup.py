"""Near-duplicates against all pairs."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SMALL
from lodestone.llm import common, neardup
from tests.llm.conftest import CLASHING, documents

_LOW = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_LOW))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute_force(rows, size, percent):
    """(doc_id, n_shingles, component_id, kept) of each row, by comparing all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def found(df, size, percent):
    return sorted((tuple(r) for r in neardup.near_duplicates(df, size=size, percent=percent).collect()), key=str)


def edited(rng, words, share):
    words = list(words)
    for k in np.flatnonzero(rng.random(len(words)) < share):
        words[k] = f"new{rng.integers(1 << 30)}"
    return words


def made(rng, n_groups=40):
    rows, i = [], 0
    license_lines = [f"license{k}" for k in range(60)]
    for g in range(n_groups):
        base = [f"w{rng.integers(5000)}" for _ in range(int(rng.integers(4, 120)))] + (license_lines if g % 3 == 0 else [])
        for share in (0, 0.005, 0.01, 0.02, 0.04, 0.08):
            rows.append((i, " ".join(edited(rng, base, share))))
            i += 1
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):  # each like the one before, the ends unlike
        rows.append((i, " ".join(chain)))
        i += 1
        chain = chain[2:] + [f"d{k}", f"e{k}"]
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_same_as_all_pairs(spark, size, percent):
    rows = made(np.random.default_rng(size))
    assert found(documents(spark, rows), size, percent) == brute_force(rows, size, percent)


def test_same_as_all_pairs_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, SMALL, "documents").collect()]
    assert found(common.table(spark, SMALL, "documents"), 3, 85) == brute_force(rows, 3, 85)


def test_many_copies_and_a_common_passage(spark):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(base)) for k in range(150)] + [(200 + k, " ".join(edited(rng, base, 0.01))) for k in range(120)]
    passage = " ".join(f"p{k}" for k in range(70))
    rows += [(400 + k, passage + " " + " ".join(f"own{k}-{j}" for j in range(int(rng.integers(1, 40))))) for k in range(90)]
    assert found(documents(spark, rows), 3, 85) == brute_force(rows, 3, 85)


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd, 3, 85) == brute_force(rows, 3, 85)
    assert found(empty, 3, 85) == []
    assert set(CLASHING) <= set(odd.columns)


def test_links_survive_any_partitioning(spark):
    rows = made(np.random.default_rng(5), 10)
    one, many = (found(documents(spark, rows).repartition(n), 3, 85) for n in (1, 13))
    assert one == many


def test_sets_are_those_of_the_words():
    texts = ["A b c D", "a  b\tc\nd", "a b", "", None, "a b c a b c a b c", "ÄB c d"]
    sets = list(neardup.shingle_sets(pa.array(texts), 3))
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 3, 1]
    assert (sets[0] == sets[1]).all()
