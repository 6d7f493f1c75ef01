"""Chunks against a plain version on strings, sections, and tables."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import chunking
from lodestone.plans import QUERIES
from tests.conftest import SMALL


def plain(text, size, overlap, separators=chunking.SEPARATORS):
    """The same rule on strings: pieces with the separator in front, joined while they fit."""
    separator = next((s for s in separators if s == "" or s in text), separators[-1])
    rest = separators[separators.index(separator) + 1 :]
    if separator:
        bits = re.split(f"({re.escape(separator)})", text)
        pieces = [bits[0], *[bits[i] + bits[i + 1] for i in range(1, len(bits), 2)]]
    else:
        pieces = list(text)
    out, waiting = [], []

    def join():
        held, total = [], 0
        for p in waiting:
            if held and total + len(p) > size:
                out.append("".join(held))
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        if held:
            out.append("".join(held))
        waiting.clear()

    for p in (p for p in pieces if p):
        if len(p) < size:
            waiting.append(p)
            continue
        join()
        out.extend(plain(p, size, overlap, rest) if rest else [p])
    join()
    return [x.strip() for x in out if x.strip()]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab .?!\n。！cd"), max_size=200), st.integers(2, 30), st.integers(0, 12))
def test_same_chunks_as_on_strings(text, size, overlap):
    if overlap < size:
        found = list(chunking.spans(text, size, overlap))
        assert [text[a:z] for a, z in found] == plain(text, size, overlap)
        assert all(z - a <= size for a, z in found)


def test_chunks_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "one"), (None, "no id"), (5, "x" * 2500), (6, "first line\n\nsecond " + "word " * 300)], "doc_id long, text string").withColumn("chunk", F.lit("clash"))
    rows = chunking.chunks(docs).collect()
    assert {r["doc_id"] for r in rows} == {4, None, 5, 6}
    assert [len(r["chunk"]) for r in sorted((r for r in rows if r["doc_id"] == 5), key=lambda r: r["seq"])] == [1000, 1000, 740]
    assert [r["line"] for r in sorted((r for r in rows if r["doc_id"] == 6), key=lambda r: r["seq"])] == [1, 3, 3]
    assert chunking.chunks(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        chunking.chunks(docs, size=10, overlap=10)


def test_sections(spark):
    text = "before\n# A\none\n## B\n```\n# no heading\n```\ntwo\n# C\n\n## D #\nthree\n#none\n##### deep\nlast"
    rows = chunking.sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("section").collect()
    assert [(r["path"], r["body"]) for r in rows] == [([], "before"), (["A"], "one"), (["A", "B"], "```\n# no heading\n```\ntwo"), (["C", "D #"], "three\n#none\n##### deep\nlast")]
    assert all(text[r["source_start"] : r["source_end"]] == r["body"] for r in rows)


def test_table_chunks_same_as_a_loop(spark):
    found = {}
    for r in QUERIES["chunk_table_rows"](spark, SMALL).orderBy("l_suppkey", "seq").collect():
        found.setdefault(r["l_suppkey"], []).append(r)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").where("l_quantity > 49").orderBy("l_suppkey", "l_orderkey", "l_linenumber").collect()
    header, want = "order | line | part | quantity", {}
    for x in lines:
        row = f"{x['l_orderkey']} | {x['l_linenumber']} | {x['l_partkey']} | {x['l_quantity']}"
        groups = want.setdefault(x["l_suppkey"], [[]])
        if groups[-1] and sum(len(g) + 1 for g in groups[-1]) + len(row) + 1 > 400 - len(header):
            groups.append([])
        groups[-1].append(row)
    assert {k: [r["chunk"] for r in v] for k, v in found.items()} == {k: ["\n".join([header, *g]) for g in v] for k, v in want.items()}
    for v in found.values():
        assert [r["first_row"] for r in v] == [0, *[r["last_row"] + 1 for r in v[:-1]]]
        assert all(len(r["chunk"]) <= 400 for r in v)


def test_markdown_chunks_of_made_texts():
    text = "before\n\n# One \n  first\x00line  \nsecond\n\nthird\n## Two\n~~~\n# no heading\n\n``` \n~~~\n# \n#Three\n```\n## fenced\n```\n##### five\n"
    assert [(p, c) for p, c, _ in chunking.markdown_spans(text)] == [
        ((), "before"), (("One",), "firstline\nsecond  \nthird"), (("One", "Two"), "~~~\n# no heading\n\n```\n~~~"), (("",), "#Three\n```\n## fenced\n```\n##### five"),
    ]
    for _, chunk, ranges in chunking.markdown_spans(text):
        assert "".join(text[a:z] for a, z in ranges).replace("\n", "") == chunk.replace("  \n", "").replace("\n", "")
    assert [[text[a:z] for a, z in r] for _, _, r in chunking.markdown_spans(text)][1] == ["first", "line", "second", "third"]


def test_markdown_sections_over_the_size_are_cut_as_plain_text(spark):
    body = " ".join(f"word{k}" for k in range(200))
    text = f"# A\n{body}\n\n# B\nshort\n\nrest"
    found = chunking.markdown_chunks(spark.createDataFrame([(1, text), (2, None), (3, " \n")], "doc_id long, text string"), size=300, overlap=50).orderBy("seq").collect()
    plain = [body[a:z] for a, z in chunking.spans(body, 300, 50)]
    assert [r["chunk"] for r in found] == [*plain, "short  \nrest"] and [r["path"] for r in found] == [["A"]] * len(plain) + [["B"]]
    assert all(text[r["source_start"] : r["source_end"]] == r["chunk"] for r in found[:-1])
    assert [(x["start"], x["end"]) for x in found[-1]["source_ranges"]] == [(text.index("short"), text.index("short") + 5), (text.index("rest"), len(text))]
    with pytest.raises(ValueError, match="overlap"):
        chunking.markdown_chunks(spark.createDataFrame([], "doc_id long, text string"), size=10, overlap=10)
