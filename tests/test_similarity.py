"""Word similarity against plain versions: by its definition, and over all pairs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL
from lodestone.operators import similarity
from lodestone.plans import QUERIES
from lodestone.sources.tables import Tables


def plain_trigrams(text):
    out = []
    for word in re.findall(r"[^\W_]+", text.lower()):
        padded = f"  {word} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def plain(query, text):
    """Every extent's sets are made anew."""
    wanted, found = set(plain_trigrams(query)), plain_trigrams(text)
    best, begin = np.float32(0), None
    for end, last in enumerate(found):
        if last not in wanted:
            continue
        begin = end if begin is None else begin
        scores = [np.float32(len(x & wanted) / len(x | wanted)) for x in (set(found[b : end + 1]) for b in range(begin, end + 1))]
        begin += scores.index(max(scores))
        best = max(best, *scores)
    return float(best)


WORDS = st.text(st.sampled_from("ab cAB1-_é "), max_size=40) | st.text(st.sampled_from("ab c"), max_size=70)


@settings(max_examples=2000, deadline=None)
@given(WORDS, WORDS)
def test_one_pair(query, text):
    assert similarity.word_similarity(query, text) == plain(query, text)
    codes, at = similarity.trigrams([text])
    wanted = similarity.trigrams([query])[0]
    assert similarity.best_extent(np.isin(codes, wanted), similarity.neighbours(codes, at)[1], len(set(wanted)), group=2) == plain(query, text)


def test_known_values():
    for query, text, expected in (("word", "two words", 0.8), ("words", "words", 1.0), ("", "words", 0.0), ("...", "x", 0.0), ("WORD", "word!", 1.0), ("日本語", "これは日本語", plain("日本語", "これは日本語"))):
        assert similarity.word_similarity(query, text) == pytest.approx(expected)
    codes, at = similarity.trigrams(["", "a", "a\nb", "..", "cat"])
    assert at.tolist() == [0, 0, 2, 6, 6, 10]
    assert [chr(codes[-1] >> 42) + chr(codes[-1] >> 21 & 0x1FFFFF) + chr(codes[-1] & 0x1FFFFF)] == ["at "]


def over_all_pairs(docs, queries, k, threshold=0.3, boosts=(1.0, 1.5, 2.0)):
    out = []
    for q, query in queries:
        if q is None or query is None:
            continue
        rows = []
        for i, *columns in docs:
            scores = [plain(query, c or "") for c in columns]
            if i is not None and max(scores) >= threshold:
                rows.append((-max(s * b for s, b in zip(scores, boosts, strict=True)), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def found(spark, docs, queries, k, **options):
    d = spark.createDataFrame(docs, "id long, text string, title string, external_id string").withColumns({"score": F.lit("x"), "q": F.lit("y")}).repartition(4)
    q = spark.createDataFrame(queries, "query_id long, query string").withColumns({"text": F.lit("x"), "need": F.lit("y")})
    return sorted(tuple(r) for r in similarity.similar_words(d, q, k, **options).select("query_id", "id", "score", "rank").collect())


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    parts = ["ka", "lo", "mi", "ten", "ra", "su", "vor", "e", "qui"]
    word = lambda: "".join(rng.choice(parts, size=rng.integers(1, 4)))
    text = lambda least, most: " ".join(word() for _ in range(rng.integers(least, most)))
    return [(k, text(0, 40), text(0, 6), f"ext-{k % 7} {word()}") for k in range(n)], [(1000 + k, text(1, 9)) for k in range(15)]


@pytest.mark.parametrize("threshold", [0.3, 0.05, 0.62, 1.0])
def test_same_as_all_pairs(spark, threshold):
    docs, queries = made(40)
    expected = over_all_pairs(docs, queries, 12, threshold)
    assert expected and found(spark, docs, queries, 12, threshold=threshold, block=10) == expected


def test_odd_rows_and_ties(spark):
    docs = [(1, None, None, None), (2, "", "", ""), (None, "one word", None, None), (4, "one word", None, "w"), (3, "one word", None, "w"), (5, "...", "one word", ""), (5, "one", "two", "three"), (6, "one more word " * 60, None, None), (-7, "One-Word", None, None), (8, "ünï ß word\x00", None, None)]
    queries = [(1, "one word"), (1, "word"), (2, None), (None, "word"), (3, ""), (4, "!?"), (5, "ünï"), (6, "one " * 300)]
    expected = over_all_pairs(docs, [q for q in queries if q[0] != 1], 5)
    got = found(spark, docs, queries, 5)
    assert [r for r in got if r[0] != 1] == expected
    assert [r[1] for r in sorted((r for r in got if r[0] == 1), key=lambda r: r[3])][:2] == [5, 5]
    assert found(spark, [], queries, 5) == [] and found(spark, docs, [], 5) == []


def test_long_texts(spark):
    docs = [(1, "one blah word blah " * 5_000, None, None), (2, "many other words " * 20_000 + "one word", None, None), (3, "x" * 300_000, None, None)]
    assert found(spark, docs, [(1, "one word"), (2, "x" * 1_000)], 5) == [(1, 1, plain("one word", "one blah word blah one"), 2), (1, 2, 1.0, 1), (2, 3, pytest.approx(4 / 4), 1)]


def test_registered_query_over_all_pairs(spark):
    t = Tables(spark, SMALL)
    queries = [tuple(r) for r in t.benchmark.where("item_id % 20 = 0").select("item_id", "text").collect()][:1]
    docs = [tuple(r) for r in t.chunks_v.join(t.docs_v.select("doc_id", "title", "external_id"), "doc_id").select("chunk_id", "text", "title", "external_id").collect()][:12]
    known = {r[0] for r in docs}
    got = [r for r in QUERIES["retrieval_word_similarity"](spark, SMALL).select("query_id", "id", "score", "rank").collect() if r[0] in {q for q, _ in queries}]
    scores = {(q, i): s for q, i, s, _ in over_all_pairs(docs, queries, len(docs))}
    assert got and all(scores.get((r["query_id"], r["id"])) == r["score"] for r in got if r["id"] in known)


@settings(max_examples=500, deadline=None)
@given(WORDS, st.lists(WORDS, max_size=5), st.floats(0, 1))
def test_texts_together(query, texts, least):
    wanted = np.unique(similarity.trigrams([query])[0])
    codes, at = similarity.trigrams(texts)
    hit = np.isin(codes, wanted)
    first, following, previous = similarity.neighbours(codes, at)
    expected = np.array([plain(query, t) for t in texts])
    if len(wanted):
        assert similarity.best_extents(hit, previous, at, len(wanted)).tolist() == expected.tolist()
        some = similarity.best_extents(hit, previous, at, len(wanted), least)
        assert (some[expected >= least] == expected[expected >= least]).all()
        index = similarity._Index([query], 0.3)
        for floor in (0.0, least):
            got = similarity._Field(texts, index).scores(np.arange(len(texts)), 0, floor)
            assert (got[expected >= floor] == expected[expected >= floor]).all() and set(got) <= {0.0, *expected}


@pytest.mark.parametrize("runs", [128, 2, 0])
def test_pairs_are_scored_together(monkeypatch, runs):
    docs, queries = made(80)
    alone = []
    monkeypatch.setattr(similarity, "RUNS", runs)
    monkeypatch.setattr(similarity, "best_extent", lambda *a, f=similarity.best_extent: alone.append(a) or f(*a))
    asked = pa.table({"q": [q for q, _ in queries], "query": [t for _, t in queries]})
    rows = pa.RecordBatch.from_pydict({name: [d[n] for d in docs] for n, name in enumerate(("id", "text", "title", "external_id"))})
    run = similarity._local(asked, {"text": 1.0, "title": 1.5, "external_id": 2.0}, 0.3, 7)
    got = [(r["query_id"], r["id"], r["score"]) for b in run([rows.slice(0, 45), rows.slice(45)]) for r in b.to_pylist()]
    assert sorted(got) == [r[:3] for r in over_all_pairs(docs, queries, 7)]
    assert bool(alone) == (runs < 128)
