"""Documents from files: JSON, CSV, text, word-processor and spreadsheet files; evaluation items; a store addressed by content.

Each reader is a Spark scan; a document has external_id, title (the file's name where it has none), text and file.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAP = 50 << 20
#: Which columns of a CSV file hold what, in order of preference.
TEXT_NAMES, TITLE_NAMES, ID_NAMES = ("text", "content"), ("title", "name"), ("external_id", "id")
SUFFIXES = ("json", "csv", "txt", "md", "docx", "xlsx", "pdf")


def suffix(path: Column) -> Column:
    """The last extension in lower case; empty if there is none."""
    return F.regexp_extract(F.lower(path), "\\.([^./]+)$", 1)


def files(spark: SparkSession, path: str, *, cap: int = CAP, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """file, name, suffix, length and content of the files up to `cap` bytes with a known suffix; larger ones are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= cap)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(F.col("path").alias("file"), name.alias("name"), suffix(F.col("path")).alias("suffix"), "length", "content").where(F.col("suffix").isin(*suffixes))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """From files that hold one object or an array of them. Documents without text are left out."""
    schema = "text string, title string, external_id string, metadata map<string,string>, splitter string"
    found = spark.read.schema(schema).option("multiLine", "true").json(path)
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("_metadata.file_name"))
    return found.select("external_id", title.alias("title"), "text", "metadata", "splitter", F.col("_metadata.file_path").alias("file")).where(F.trim("text") != "")


def csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """From files with a header. The text is in the first column where none has its name."""
    found = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    by_name = {c.strip().lower(): c for c in reversed(found.columns)}

    def one(names: tuple[str, ...], otherwise: Column) -> Column:
        return next((F.col(f"`{by_name[n]}`") for n in names if n in by_name), otherwise)

    name = F.col("_metadata.file_name")
    title = F.coalesce(F.nullif(one(TITLE_NAMES, F.lit(None).cast("string")), F.lit("")), name)
    text = one(TEXT_NAMES, F.col(f"`{found.columns[0]}`"))
    return found.select(one(ID_NAMES, F.lit(None).cast("string")).alias("external_id"), title.alias("title"), text.alias("text"), F.col("_metadata.file_path").alias("file")).where(F.trim("text") != "")


def text_documents(spark: SparkSession, path: str, *, cap: int = CAP) -> DataFrame:
    """From plain text and Markdown files. What is no UTF-8 or blank is left out."""
    found = files(spark, path, cap=cap, suffixes=("txt", "md"))
    valid = found.where(F.is_valid_utf8(F.col("content").cast("string")))
    return valid.select(F.lit(None).cast("string").alias("external_id"), F.col("name").alias("title"), F.col("content").cast("string").alias("text"), "file").where(F.trim(F.regexp_replace("text", "\\s", "")) != "")


def evaluation_items(spark: SparkSession, path: str) -> DataFrame:
    """query, library, expected_doc_ids, expected_text, note, file and error of each line; blank lines and comments (#, //) are left out.

    A list may be given as one string. A line that is no object with a query and an expectation has the reason in `error`.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_name").alias("file"))
    lines = lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("#")) & ~F.startswith("value", F.lit("//")))
    kept = F.from_json("value", "query string, library string, expected_doc_ids string, expected_text string, note string", {"mode": "PERMISSIVE"})

    def items(name: str) -> Column:
        many = F.from_json(F.col(name), "array<string>")
        return F.when(F.startswith(name, F.lit("[")), many).when(F.col(name).isNotNull(), F.array(name))

    read = lines.select("file", "value", kept.alias("x")).select("file", "value", "x.*")
    error = F.when(F.col("query").isNull(), "no query").when(F.col("expected_doc_ids").isNull() & F.col("expected_text").isNull(), "nothing is expected")
    return read.select("query", "library", items("expected_doc_ids").alias("expected_doc_ids"), items("expected_text").alias("expected_text"), "note", "file", error.alias("error"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _docx_segments(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(kind, heading level, texts) in the order of the document: a paragraph's text, or a table's rows."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")

    def words(node: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()

    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = "" if style is None else style.get(f"{_W}val", "")
            digits = name.lower().removeprefix("heading").strip()
            if text := words(node):
                yield "prose", int(digits) if name.lower().startswith("heading") and digits.isdigit() else 0, [text]
        elif node.tag == f"{_W}tbl":
            yield "table", 0, ["\x1f".join(words(c) for c in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr")]


def _xlsx_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number from 1, cells); blanks at a row's end and blank rows are left out."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    sheets = [s.get("name", "") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    for n, sheet in enumerate(sheets, 1):
        for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{n}.xml")).iter(f"{_S}row"):
            cells: list[str] = []
            for c in row.iter(f"{_S}c"):
                column = 0
                for letter in (x for x in c.get("r", "") if x.isalpha()):
                    column = column * 26 + ord(letter) - 64
                cells += [""] * (column - 1 - len(cells))
                value = c.find(f"{_S}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                cells.append(inline or ("" if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text or ""))
            while cells and not cells[-1].strip():
                cells.pop()
            if cells:
                yield sheet, int(row.get("r", "0")), cells


def word_segments(found: DataFrame) -> DataFrame:
    """file, pos, kind (prose or table), level (of a heading, else 0), text and rows (cells) of each segment of .docx files; an unreadable file has kind "error"."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["file"], b["content"], strict=True):
                try:
                    rows = [(file, k, kind, level, "\n".join(x.replace("\x1f", " | ") for x in texts), [x.split("\x1f") for x in texts] if kind == "table" else []) for k, (kind, level, texts) in enumerate(_docx_segments(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows = [(file, 0, "error", 0, str(e), [])]
                yield pd.DataFrame(rows, columns=["file", "pos", "kind", "level", "text", "rows"])

    return found.where("suffix = 'docx'").select("file", "content").mapInPandas(run, "file string, pos long, kind string, level int, text string, rows array<array<string>>")


def sheet_rows(found: DataFrame) -> DataFrame:
    """file, sheet, row_number and cells of each row of .xlsx files; an unreadable file has one row with sheet null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["file"], b["content"], strict=True):
                try:
                    rows = [(file, *r) for r in _xlsx_rows(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows = [(file, None, 0, [str(e)])]
                yield pd.DataFrame(rows, columns=["file", "sheet", "row_number", "cells"])

    return found.where("suffix = 'xlsx'").select("file", "content").mapInPandas(run, "file string, sheet string, row_number long, cells array<string>")


def store(found: DataFrame, folder: str, library: Column) -> DataFrame:
    """Writes files under their library and SHA-256, each content once, into a folder that must be new; returns library, sha256, length and name."""
    keyed = found.select(library.alias("library"), F.sha2("content", 256).alias("sha256"), "length", "name", "content").dropDuplicates(["library", "sha256"])
    keyed.write.partitionBy("library").mode("errorifexists").parquet(folder)
    return found.sparkSession.read.parquet(folder).select("library", "sha256", "length", "name")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """term, ordinal (from 0) and synonym of a dictionary in JSON. A value is a string or a list of them; names that begin with an underscore and blank synonyms are left out."""
    whole = spark.read.option("wholetext", "true").text(path)
    entries = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "value")).where(~F.startswith("term", F.lit("_")))
    many = F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    kept = F.filter(many, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return entries.select("term", F.posexplode(kept).alias("ordinal", "synonym")).withColumn("ordinal", F.col("ordinal").cast("long"))


def canonical_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, line_hash (SHA-256) and canonical of each line: whether it is JSON in its one form, keys sorted, without blanks, and nothing escaped that need not be."""

    def same(lines: pd.Series) -> pd.Series:
        return lines.map(_is_canonical)

    line = F.col("value")
    return spark.read.text(path).select(line.alias("line"), F.sha2(line, 256).alias("line_hash"), F.pandas_udf(same, "boolean")(line).alias("canonical"))


def _is_canonical(line: str) -> bool:
    try:
        return json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) == line
    except ValueError:
        return False


def write_once(df: DataFrame, folder: str) -> DataFrame:
    """df, written to a folder that must not be there yet, and read again."""
    df.write.mode("errorifexists").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
