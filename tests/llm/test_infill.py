"""Fill-in-the-middle against a plain version by regular expression and list slices; exact round trips."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL
from lodestone.llm import common, infill, queries
from tests.llm.conftest import ODD, documents

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\t-\r ]+|[^\t-\r ]+"}


def plain(i, text, unit="line", seed="7", percent=100, spm=50, markers=infill.MARKERS):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in markers) or h3 % 100 >= percent:
        return i, n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = markers
    form, out = ("spm", s + suffix + p + prefix + m + middle) if h4 % 100 < spm else ("psm", p + prefix + s + suffix + m + middle)
    return i, n, form, out, len(prefix), len(middle)


def check(docs, rows, **options):
    found = infill.transformed(docs, **options).withColumn("back", infill.restored(F.col("output"), F.col("form"), options.get("markers", infill.MARKERS))).collect()
    named = {k if k != "spm_percent" else "spm": v for k, v in options.items()}
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted((plain(i, t, **named) for i, t in rows), key=str)
    assert sorted((r["back"] for r in found)) == sorted(t or "" for _, t in rows)
    return {r["form"] for r in found}


def test_same_as_sql(spark, same_as_sql):
    same_as_sql(queries.op12_fill_in_middle(spark, SMALL), queries.ORACLE_SQL["op12_fill_in_middle"])


def test_odd_rows(spark, odd, empty):
    for unit in UNITS:
        check(odd, [(r[0], r[1]) for r in ODD], unit=unit)
    found = infill.transformed(empty)
    assert found.columns == ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"] and found.count() == 0


def test_lines_and_words_of_the_table(spark):
    docs = common.table(spark, SMALL, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert check(docs, rows) == {"psm", "spm"}
    assert check(docs, rows, unit="word", seed="other", percent=60, spm_percent=10) == {"psm", "spm", "plain"}


def test_markers_and_line_ends(spark):
    texts = ["<P>", "a <S> b\n", "x\n<M>", "<p>\n<<P\n>\n", "\n", "\n\n\n", "a\r\nb\r\n", "no end", "one\n", "  is\x85 no line end\n\x0b\x0c", "<\n" * 9 + "S>", "😀\n𐍈é\n" * 5, "a\nb\n" * 50]
    rows = [(k, texts[k % len(texts)]) for k in range(26 * len(texts))]
    assert check(documents(spark, rows), rows) == {"psm", "spm", "plain"}
    check(documents(spark, rows), rows, markers=("¤p", "§", "¶"))


def test_very_long_texts(spark):
    rows = [(1, "a line of the text é\n" * 400_000), (2, "x" * 5_000_000), (3, "\n" * 1_000_000)]
    check(documents(spark, rows), rows)


def test_markers_that_could_arise_at_a_cut(spark):
    for markers in (("<P>", "<P>", "<M>"), ("ab", "bc", "d"), ("aa", "b", "c"), ("", "b", "c"), ("a", "b")):
        with pytest.raises(ValueError, match="markers"):
            infill.transformed(documents(spark, []), markers=markers)
    with pytest.raises(ValueError, match="unit"):
        infill.transformed(documents(spark, []), unit="verse")


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab \n\t\r\x0b　é"), st.characters(codec="utf-8")), max_size=60), st.sampled_from(sorted(UNITS)))
def test_boundaries(text, unit):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.cumsum([0, *map(len, re.findall(UNITS[unit], text))])
    assert infill.boundaries(points, unit).tolist() == at.tolist()
