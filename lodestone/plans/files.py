"""Queries of the file family: tables written out as files and read back by the readers of documents."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scores
from lodestone.plans.catalog import query
from lodestone.sources import files
from lodestone.sources.tables import Tables
from lodestone.streaming.events import shared


def _one_each(df: DataFrame, key: str, folder: str) -> str:
    """Writes the column `value` of each row as a file of its own; key must tell the rows apart."""
    df.select(key, "value").write.partitionBy(key).text(folder)
    return folder


@query("SELECT 'item-' || item_id AS external_id, 'passage ' || item_id AS title, sha256(text) AS text_hash, (item_id % 7)::VARCHAR AS tag FROM benchmark WHERE trim(text) <> ''")
def ingest_json_files(t: Tables) -> DataFrame:
    """SRC-03: files that hold an array of fifty documents each."""
    one = F.struct(F.concat(F.lit("item-"), "item_id").alias("external_id"), F.concat(F.lit("passage "), "item_id").alias("title"), "text", F.struct((F.col("item_id") % 7).cast("string").alias("tag")).alias("metadata"))
    arrays = t.benchmark.groupBy(F.expr("item_id div 50").alias("part")).agg(F.to_json(F.collect_list(one)).alias("value"))
    found = files.json_documents(t.spark, _one_each(arrays, "part", shared(t.spark, "json")))
    return found.select("external_id", "title", F.sha2("text", 256).alias("text_hash"), F.col("metadata")["tag"].alias("tag"))


@query("SELECT p_partkey::VARCHAR AS external_id, p_name AS title, p_brand || chr(10) || '\"' || p_type || '\", ' || p_size AS text FROM part")
def ingest_csv_files(t: Tables) -> DataFrame:
    """SRC-04: texts with line ends, quotes and commas; the columns are found by their names."""
    folder = shared(t.spark, "csv")
    text = F.concat("p_brand", F.lit("\n\""), "p_type", F.lit("\", "), F.col("p_size").cast("string"))
    t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("Name"), text.alias("content"), F.lit("x").alias("other")).write.option("header", "true").option("escape", '"').csv(folder)
    return files.csv_documents(t.spark, folder).select("external_id", "title", "text")


@query("SELECT sha256(text || chr(10)) AS text_hash, strlen(text) + 1 AS bytes FROM benchmark WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0 AND strlen(text) < 2000")
def ingest_text_files(t: Tables) -> DataFrame:
    """SRC-01, SRC-02, SRC-05: a file for each passage; files over the cap are not read."""
    folder = _one_each(t.benchmark.select("item_id", F.col("text").alias("value")), "item_id", shared(t.spark, "text"))
    found = files.text_documents(t.spark, folder, cap=2000)
    return found.select(F.sha2("text", 256).alias("text_hash"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT left(text, 40) AS query, 'lib' AS library, ['d' || item_id, 'e' || item_id] AS expected_doc_ids, NULL::VARCHAR AS error FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT left(text, 40), 'lib', NULL, 'nothing is expected' FROM benchmark WHERE item_id % 3 = 1")
def ingest_evaluation_items(t: Tables) -> DataFrame:
    """SRC-19: lines with items, comments and blank lines between them."""
    folder = shared(t.spark, "items")
    item = F.to_json(F.struct(F.left("text", F.lit(40)).alias("query"), F.lit("lib").alias("library"), F.when(F.col("item_id") % 3 == 0, F.array(F.concat(F.lit("d"), "item_id"), F.concat(F.lit("e"), "item_id"))).alias("expected_doc_ids")))
    t.benchmark.select(F.when(F.col("item_id") % 3 < 2, item).when(F.col("item_id") % 2 == 0, "# a comment").otherwise("").alias("value")).write.text(folder)
    return files.evaluation_items(t.spark, folder).select("query", "library", "expected_doc_ids", "error")


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def _book(names: list[str]) -> bytes:
    rows = "".join(f'<row r="{2 * k + 1}"><c r="A{2 * k + 1}"><v>{k}</v></c><c r="C{2 * k + 1}" t="inlineStr"><is><t>{n}</t></is></c></row>' for k, n in enumerate(names))
    return _archive({"xl/workbook.xml": f'<workbook xmlns="{_S}"><sheets><sheet name="Nations"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_S}"><sheetData>{rows}</sheetData></worksheet>'})


def _letter(names: list[str]) -> bytes:
    line = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
    rows = "".join(f"<w:tr><w:tc><w:p>{line(k)}</w:p></w:tc><w:tc><w:p>{line(n)}</w:p></w:tc></w:tr>" for k, n in enumerate(names))
    return _archive({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{line("Nations")}</w:p><w:tbl>{rows}</w:tbl><w:p>{line(len(names))}</w:p></w:body></w:document>'})


def _written(t: Tables, kind: str) -> DataFrame:
    """A file of each region's nations, as `files` would list them: file, suffix, content."""
    write = _book if kind == "xlsx" else _letter

    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda x: write(list(x)))

    names = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return names.select(F.concat(F.lit("region-"), "n_regionkey").alias("file"), F.lit(kind).alias("suffix"), F.pandas_udf(run, "binary")("names").alias("content"))


_NATIONS = "n AS (SELECT 'region-' || n_regionkey AS file, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS k FROM nation)"


@query(f"WITH {_NATIONS} SELECT file, 'Nations' AS sheet, 2 * k + 1 AS row_number, [k::VARCHAR, '', n_name] AS cells FROM n")
def ingest_sheet_files(t: Tables) -> DataFrame:
    """SRC-10: rows by their numbers, with the cells that are left out between others."""
    return files.sheet_rows(_written(t, "xlsx"))


@query(f"WITH {_NATIONS} SELECT file, 0::BIGINT AS pos, 'prose' AS kind, 1 AS level, 'Nations' AS text FROM n GROUP BY file UNION ALL SELECT file, 1, 'table', 0, string_agg(k || ' | ' || n_name, chr(10) ORDER BY k) FROM n GROUP BY file UNION ALL SELECT file, 2, 'prose', 0, count(*)::VARCHAR FROM n GROUP BY file")
def ingest_word_files(t: Tables) -> DataFrame:
    """SRC-08, SRC-09: headings, prose and tables in the order of the document."""
    return files.word_segments(_written(t, "docx")).select("file", "pos", "kind", "level", "text")


@query("""WITH s(term, ordinal, synonym) AS (VALUES ('the', 0::BIGINT, 'a'), ('and', 0, 'plus'), ('and', 1, 'also'), ('of', 0, 'from'))
    SELECT item_id, term, ordinal, replace(text, term, synonym) AS phrasing FROM benchmark JOIN s ON contains(text, term)""")
def ingest_synonyms(t: Tables) -> DataFrame:
    """STR-04, STR-05: a dictionary from a file, whose values are strings or lists and whose names with an underscore are notes."""
    folder = shared(t.spark, "synonyms")
    t.spark.createDataFrame([('{"the": "a", "and": ["plus", " ", "also"], "_note": "not a term", "of": ["from"], "empty": []}',)], "value string").write.text(folder)
    found = F.broadcast(files.synonyms(t.spark, folder))  # a dictionary that people write
    return t.benchmark.join(found, F.contains("text", "term")).select("item_id", "term", "ordinal", F.replace("text", "term", "synonym").alias("phrasing"))


@query("""WITH l AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN '{"name": "' || n_name || '"}' ELSE '{"key":"' || n_nationkey || '","name":"' || n_name || '"}' END AS line FROM nation)
    SELECT line, sha256(line) AS line_hash, n_nationkey % 4 <> 3 AS canonical FROM l""")
def ingest_canonical_lines(t: Tables) -> DataFrame:
    """SRC-20, HSH-02: a line is canonical if it is what its value is written as; every fourth is not."""
    folder = shared(t.spark, "canonical")
    line = F.when(F.col("n_nationkey") % 4 == 3, F.concat(F.lit('{"name": "'), "n_name", F.lit('"}'))).otherwise(scores.canonical(key=F.col("n_nationkey").cast("string"), name=F.col("n_name")))
    t.nation.select(line.alias("value")).write.text(folder)
    return files.canonical_lines(t.spark, folder)


@query("SELECT n_nationkey, n_name, true AS refused FROM nation")
def sink_write_once(t: Tables) -> DataFrame:
    """SRC-21: an artifact is written once; a second write to its place is refused and changes nothing."""
    folder = shared(t.spark, "artifact")
    kept = files.write_once(t.nation.select("n_nationkey", "n_name"), folder)
    try:
        files.write_once(t.nation.select("n_nationkey", F.lit("changed").alias("n_name")), folder)
        refused = False
    except AnalysisException:
        refused = True
    return kept.withColumn("refused", F.lit(refused))
