"""The surface form of queries, by examples of each rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.retrieval import query_plan

FORMS = {
    "《中华 人民》": "中华 人民", "【甲】〔乙〕［丙］": "[甲][乙][丙]", "「a」『b』〈c〉": "abc", "第 5 条": "第5条", "第　十二  款 第3项": "第十二款 第3项", "第 x 条": "第 x 条", "第5 页": "第5 页",
    "国发 〔 2020 〕 5 号": "国发 [2020] 5号", "[ 2020a ]": "[ 2020a ]", "GB  50016 - 2014": "GB 50016 - 2014", "ＡＢＣ　１２３！": "ABC 123!", "（甲）": "(甲)", "  \n a \t b ": "a b", "": "", None: "", "STRASSE ß": "STRASSE ß", "a\xa0b": "a b",
}


def test_forms(spark):
    rows = spark.createDataFrame(list(FORMS.items()), "q string, expected string")
    assert [tuple(r) for r in rows.select("q", tx.query_form(F.col("q")).alias("form"), "expected").where("form <> expected").collect()] == []


def test_plan(spark):
    queries = spark.createDataFrame([(1, "第 5 条 tax"), (2, "plain"), (3, None), (4, "《tax》 law and tax")], "query_id long, query string")
    synonyms = spark.createDataFrame([("tax", "levy", 0), ("tax", "duty", 1), ("", "x", 2), ("law", None, 3), ("law", "act", 4)], "term string, synonym string, ordinal int")
    got = {(r["query_id"], r["ordinal"]): (r["phrasing"], r["source"]) for r in query_plan(queries, synonyms).collect()}
    assert got == {
        (1, 1): ("第 5 条 tax", "original"), (1, 2): ("第5条 tax", "normalised"), (1, 3): ("第5条 levy", "synonym"), (1, 4): ("第5条 duty", "synonym"), (2, 1): ("plain", "original"),
        (4, 1): ("《tax》 law and tax", "original"), (4, 2): ("tax law and tax", "normalised"), (4, 3): ("levy law and levy", "synonym"), (4, 4): ("duty law and duty", "synonym"),
    }
