"""The base tables and the views derived from them: documents and their chunks, a property graph, mentions, job events."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 500
#: About so many lines are joined and made distinct in one task.
LINES = 1 << 19

#: The derived views in SQL, for the queries' twins.
VIEWS_SQL = {
    "docs_v": "SELECT *, sha256(text) AS content_hash, 'ext-' || (doc_id % 700) AS external_id, left(text, 60) AS title, source AS library_id FROM documents",
    "chunks_v": f"SELECT doc_id, seq, doc_id * 1000000 + seq AS chunk_id, source, substr(text, 1 + {CHUNK} * seq, {CHUNK}) AS text, {CHUNK} * seq AS source_start, least({CHUNK} * seq + {CHUNK}, length(text)) AS source_end "
    f"FROM (SELECT *, unnest(range(0, (length(text) + {CHUNK - 1}) // {CHUNK})) AS seq FROM documents)",
    "jobs_v": "SELECT event_id, user_id, ts, value, props, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision, "
    "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'superseded' END AS status FROM events",
    "nodes_v": "SELECT 'R' || r_regionkey AS node_id, 'region' AS type_key, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, 'nation', n_name FROM nation "
    "UNION ALL SELECT 'S' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'C' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'P' || p_partkey, 'part', p_name FROM part",
    "edges_v": "SELECT 'belongs_to' AS relation, 'N' || n_nationkey AS src, 'R' || n_regionkey AS tgt FROM nation UNION ALL SELECT 'belongs_to', 'S' || s_suppkey, 'N' || s_nationkey FROM supplier "
    "UNION ALL SELECT 'belongs_to', 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT DISTINCT 'supplies', 'S' || l_suppkey, 'P' || l_partkey FROM lineitem "
    "UNION ALL SELECT DISTINCT 'owns', 'C' || o_custkey, 'P' || l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "evidence_v": "SELECT l_orderkey || '-' || l_linenumber AS evidence_id, 'S' || l_suppkey AS src, 'P' || l_partkey AS tgt, l_discount AS score, l_returnflag AS flag, l_shipdate AS seen FROM lineitem",
    "mentions_v": "SELECT c_custkey AS mention_id, 'C' || c_custkey AS gold, 'customer' AS type_key, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) WHEN 2 THEN '  ' || replace(c_name, '#', ' # ') WHEN 3 THEN substr(c_name, 1, length(c_name) - 1) ELSE lower(c_name) END AS text FROM customer",
}


def keyed(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def node_key(kind: str, key: str) -> Column:
    """The id of a node of a type by its key."""
    return keyed(kind[0].upper(), key)


def row_place() -> Column:
    """Where a row of a table that was read from files stands in it: of rows that are equal in an order, the first in the table comes first."""
    return F.struct("_metadata.file_path", "_metadata.row_index").alias("place")


def nulls_last(*columns: str) -> list[Column]:
    """Columns as parts of a struct in whose order a null comes after all values."""
    return [x for c in columns for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))]


def dealt(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """df by hash of keys in tasks of about LINES rows, of n_rows in all; in shuffle partitions at least. What a task holds does not grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-n_rows // LINES)), *keys)


class Tables:
    """Tables by name as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs_v(self) -> DataFrame:
        return self.documents.select("*", F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("ext-"), (F.col("doc_id") % 700).cast("string")).alias("external_id"), F.left("text", F.lit(60)).alias("title"), F.col("source").alias("library_id"))

    @cached_property
    def chunks_v(self) -> DataFrame:
        return self.chunks_of(self.documents)

    def chunks_of(self, docs: DataFrame, *more: str) -> DataFrame:
        """The chunks of documents, with more of their columns."""
        n = F.expr(f"(length(text) + {CHUNK - 1}) div {CHUNK}")
        seqs = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
        rows = docs.withColumn("seq", F.explode(seqs))
        return rows.select(
            "doc_id", "seq", (F.col("doc_id") * 1000000 + F.col("seq")).alias("chunk_id"), "source",
            F.expr(f"substring(text, cast(1 + {CHUNK} * seq as int), {CHUNK})").alias("text"), (F.col("seq") * CHUNK).alias("source_start"), F.least(F.col("seq") * CHUNK + CHUNK, F.length("text").cast("long")).alias("source_end"), *more,
        )

    @cached_property
    def jobs_v(self) -> DataFrame:
        from pyspark.sql import Window

        kinds = {"signup": "pending", "view": "processing", "purchase": "done", "error": "failed"}
        status = F.lit("superseded")
        for kind, value in kinds.items():
            status = F.when(F.col("event_type") == kind, value).otherwise(status)
        revision = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
        return self.events.select("event_id", "user_id", "ts", "value", "props", "event_type", revision.alias("revision"), status.alias("status"))

    @cached_property
    def nodes_v(self) -> DataFrame:
        parts = (("region", "R", "r_regionkey", "r_name"), ("nation", "N", "n_nationkey", "n_name"), ("supplier", "S", "s_suppkey", "s_name"), ("customer", "C", "c_custkey", "c_name"), ("part", "P", "p_partkey", "p_name"))
        nodes = [getattr(self, t).select(keyed(p, k).alias("node_id"), F.lit(t).alias("type_key"), F.col(n).alias("name")) for t, p, k, n in parts]
        return nodes[0].unionByName(nodes[1]).unionByName(nodes[2]).unionByName(nodes[3]).unionByName(nodes[4])

    def edge_ends(self) -> list[tuple[str, str, str, DataFrame, int]]:
        """Of each kind of relation its name, the types of its source and target, their keys, and about how many rows these are: of lines' relations one for each line."""
        n = self.lineitem.count()  # from the files' footers
        owned = dealt(self.lineitem.select("l_orderkey", "l_partkey"), n, "l_orderkey").join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        kinds = (
            ("belongs_to", "nation", "region", self.nation, "n_nationkey", "n_regionkey", 0), ("belongs_to", "supplier", "nation", self.supplier, "s_suppkey", "s_nationkey", 0),
            ("belongs_to", "customer", "nation", self.customer, "c_custkey", "c_nationkey", 0), ("supplies", "supplier", "part", self.lineitem, "l_suppkey", "l_partkey", n), ("owns", "customer", "part", owned, "o_custkey", "l_partkey", n),
        )
        return [(relation, a, b, df.select(F.col(source).alias("source"), F.col(target).alias("target")), rows) for relation, a, b, df, source, target, rows in kinds]

    @cached_property
    def edges_v(self) -> DataFrame:
        out = None
        for relation, a, b, ends, n in self.edge_ends():
            if relation != "belongs_to":
                ends = dealt(ends, n, "source", "target").distinct()
            part = ends.select(F.lit(relation).alias("relation"), node_key(a, "source").alias("src"), node_key(b, "target").alias("tgt"))
            out = part if out is None else out.unionByName(part)
        return out

    @cached_property
    def evidence_v(self) -> DataFrame:
        return self.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), keyed("S", "l_suppkey").alias("src"), keyed("P", "l_partkey").alias("tgt"), F.col("l_discount").alias("score"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("seen"))

    @cached_property
    def mentions_v(self) -> DataFrame:
        k, n = F.col("c_custkey") % 5, F.col("c_name")
        text = F.when(k == 0, n).when(k == 1, F.upper(n)).when(k == 2, F.concat(F.lit("  "), F.replace(n, F.lit("#"), F.lit(" # ")))).when(k == 3, F.expr("substring(c_name, 1, length(c_name) - 1)")).otherwise(F.lower(n))
        return self.customer.select(F.col("c_custkey").alias("mention_id"), keyed("C", "c_custkey").alias("gold"), F.lit("customer").alias("type_key"), text.alias("text"))
