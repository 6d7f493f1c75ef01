"""Readers of files and the store."""

from __future__ import annotations

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "one", "title": "T", "external_id": "x", "metadata": {"k": "v"}},\n {"text": " "}, {"title": "no text"}]')
    (tmp_path / "b.json").write_text('{"text": "two"}')
    rows = files.json_documents(spark, str(tmp_path)).orderBy("text").collect()
    assert [(r["external_id"], r["title"], r["text"], r["metadata"]) for r in rows] == [("x", "T", "one", {"k": "v"}), (None, "b.json", "two", None)]


def test_csv_documents(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,Name,content\n1,First,"two\nlines"\n2,,plain\n3,Blank,\n')
    (tmp_path / "b.csv").write_text("body,other\nhello,x\n")
    rows = files.csv_documents(spark, str(tmp_path / "a.csv")).orderBy("external_id").collect()
    assert [(r["external_id"], r["title"], r["text"]) for r in rows] == [("1", "First", "two\nlines"), ("2", "a.csv", "plain")]
    assert [(r["external_id"], r["title"], r["text"]) for r in files.csv_documents(spark, str(tmp_path / "b.csv")).collect()] == [(None, "b.csv", "hello")]


def test_text_documents(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("héllo")
    (tmp_path / "blank.md").write_text(" \n\t")
    (tmp_path / "broken.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "large.txt").write_text("x" * 100)
    (tmp_path / "other.bin").write_text("x")
    assert [(r["title"], r["text"]) for r in files.text_documents(spark, str(tmp_path), cap=50).collect()] == [("a.TXT", "héllo")]


def test_evaluation_items(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('# comment\n\n// other\n{"query": "q1", "expected_doc_ids": ["a", "b"]}\n{"query": "q2", "expected_text": "one"}\n{"query": "q3"}\nbroken\n')
    rows = files.evaluation_items(spark, str(tmp_path)).orderBy("query").collect()
    assert [(r["query"], r["expected_doc_ids"], r["expected_text"], r["error"]) for r in rows] == [(None, None, None, "no query"), ("q1", ["a", "b"], None, None), ("q2", None, ["one"], None), ("q3", None, None, "nothing is expected")]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_word_and_sheet_files(spark, tmp_path):
    def cell(x):
        return f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("1")}{cell("2")}</w:tr></w:tbl><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S}><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row r="2"><c r="A2"><v> </v></c></row><row r="4"><c r="B4" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "c.docx").write_bytes(b"no archive")
    found = files.files(spark, str(tmp_path))
    rows = files.word_segments(found).orderBy("file", "pos").collect()
    assert [(r["kind"], r["level"], r["text"], r["rows"]) for r in rows[:3]] == [("prose", 2, "Title", []), ("table", 0, "a | b\n1 | 2", [["a", "b"], ["1", "2"]]), ("prose", 0, "end", [])]
    assert [r["kind"] for r in rows[3:]] == ["error"]
    assert [(r["sheet"], r["row_number"], r["cells"]) for r in files.sheet_rows(found).orderBy("row_number").collect()] == [("One", 1, ["head", "", "7"]), ("One", 4, ["", "in"])]


def test_store_keeps_each_content_once_and_never_overwrites(spark, tmp_path):
    for name, content in (("a.txt", "same"), ("b.txt", "same"), ("c.txt", "other")):
        (tmp_path / name).write_text(content)
    found = files.files(spark, str(tmp_path), suffixes=("txt",))
    folder = str(tmp_path / "store")
    rows = files.store(found, folder, F.lit("lib")).collect()
    assert sorted(r["sha256"] for r in rows) == sorted(hashlib.sha256(x).hexdigest() for x in (b"same", b"other"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        files.store(found, folder, F.lit("lib"))


def test_lines_are_dealt_into_tasks_of_bounded_size(spark, monkeypatch):
    from lodestone.sources import tables
    from tests.conftest import SMALL

    lines = tables.Tables(spark, SMALL).lineitem
    assert tables.dealt(lines, lines.count(), "l_orderkey").rdd.getNumPartitions() == 8
    before = {tuple(r) for r in tables.Tables(spark, SMALL).edges_v.collect()}
    monkeypatch.setattr(tables, "LINES", 500)
    n = -(-lines.count() // 500)
    edges = tables.Tables(spark, SMALL).edges_v
    assert n > 8 and "hashpartitioning(l_orderkey#" in edges._jdf.queryExecution().toString() and f", {n})" in edges._jdf.queryExecution().toString()
    rows = [tuple(r) for r in edges.collect()]
    assert set(rows) == before and len(rows) == len(before)
