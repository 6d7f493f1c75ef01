"""Batch retrieval: exact search of embeddings, keyword recall, fusion, filters, visibility, enrichment and reranking."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

RRF_K = 60
#: So many scores of queries and points are held at once.
_TILE = 1 << 20


def in_blocks(queries: DataFrame, key: str, block: int) -> list[DataFrame]:
    """The queries in parts of about `block` rows, by the hash of their key; a null key goes with the first."""
    n = max(1, -(-queries.count() // block))
    part = F.coalesce(F.pmod(F.xxhash64(key), F.lit(n)), F.lit(0))
    return [queries] if n == 1 else [queries.where(part == i) for i in range(n)]


def exact_topk(points: DataFrame, queries: DataFrame, k: int, *, id_column: str = "vec_id", point_column: str = "embedding", query_id: str = "vec_id", query_column: str = "embedding", min_score: float | None = None, block: int = 4096) -> DataFrame:
    """query_id, id, score (cosine, 9 digits) and rank of the k points most similar to each query.

    Queries go to the points in blocks of about `block`, and are scored against a few hundred points at once. Each task keeps
    its own k best for a query, so k rows a task and query are shuffled. Ties go to the smaller id. Points and queries that are null, empty, zero or hold a null take no
    part, nor do null ids; a query meets the points of its own length.
    """
    usable = lambda df, key, column, name: df.select(F.col(key).cast("long").alias(name), F.col(column).cast("array<double>").alias("v")).where(F.expr(f"{name} IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL) AND exists(v, x -> x <> 0)"))
    rows, best = usable(points, id_column, point_column, "id"), None
    for part in in_blocks(usable(queries, query_id, query_column, "q"), "q", block):
        found = rows.mapInArrow(_local_best(part.toArrow(), k, min_score), "query_id long, id long, score double")
        best = found if best is None else best.unionByName(found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")
    return best.withColumn("rank", place).where(F.col("rank") <= k)


def _by_length(table: pa.Table | pa.RecordBatch, key: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the rows of each length of the column v."""
    v = table["v"].combine_chunks() if isinstance(table, pa.Table) else table["v"]
    ids, flat, ends = table[key].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[key].to_numpy(), v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
    sizes, begins = np.diff(ends), ends[:-1] - (ends[0] if len(ends) else 0)
    return {int(n): (ids[sizes == n], flat[begins[sizes == n][:, None] + np.arange(n)]) for n in np.unique(sizes)}


class _Best:
    """The k best points of each query so far; ties go to the smaller id. Hits are held, those that k better ones leave behind are dropped at once, and so the memory hangs on k and the number of queries alone."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.held, self.n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        self.floor = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each query, a column for each of ids; those that are -inf do not count."""
        if scores.shape[1] > self.k and np.isneginf(self.floor).any():
            self.floor = np.maximum(self.floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        row, at = np.nonzero((scores >= self.floor[:, None]) & (scores > -np.inf))
        if len(row):
            self.held.append((row, ids[at], scores[row, at]))
            self.n += len(row)
        if self.n > max(_TILE // 4, len(self.ids) * self.k):
            self._cut()

    def _cut(self) -> None:
        row, points, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((points, -scores, row))
        row, points, scores = row[order], points[order], scores[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last, kept = place == self.k - 1, place < self.k
        self.floor[row[last]] = scores[last]
        self.held, self.n = [(row[kept], points[kept], scores[kept])], 0

    def rows(self) -> pa.RecordBatch:
        self._cut()
        row, points, scores = self.held[0]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(points), pa.array(scores)], names=["query_id", "id", "score"])


def _local_best(asked: pa.Table, k: int, min_score: float | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _by_length(asked, "q")
        best = {n: _Best(ids, k) for n, (ids, _) in queries.items()}
        for b in batches:
            for n, (ids, x) in _by_length(b, "id").items() if b.num_rows else ():
                y = queries[n][1] if n in queries else x[:0]
                step = max(1, _TILE // max(1, len(y)))
                for at in range(0, len(x) if len(y) else 0, step):
                    part = x[at : at + step]
                    s = np.round(y @ part.T / (np.sqrt((y**2).sum(axis=1))[:, None] * np.sqrt((part**2).sum(axis=1))), 9)
                    best[n].add(ids[at : at + step], np.where(np.isfinite(s) & (True if min_score is None else s >= min_score), s, -np.inf))
        yield from (found.rows() for found in best.values())

    return run


def keyword_recall(docs: DataFrame, queries: DataFrame, k: int, *, title_boost: float = 1.5, id_boost: float = 2.0, block: int = 4096) -> DataFrame:
    """query_id, id, score and rank of the k documents with the best token score for each query.

    queries: query_id, query; docs: id, text, title, external_id. Queries go to the documents in blocks of about `block`.
    All words of a block are sought at once in one pass over each document, and each task keeps its own k best.
    """
    low = docs.select(F.col("id").cast("long").alias("id"), *[F.coalesce(F.lower(c), F.lit("")).alias(c) for c in ("text", "title", "external_id")]).where("id IS NOT NULL")
    words, best = queries.select(F.col("query_id").cast("long").alias("q"), tx.tokens(F.col("query")).alias("words")).where("q IS NOT NULL AND size(words) > 0"), None
    for part in in_blocks(words, "q", block):
        found = low.mapInArrow(_local_hits(part.toArrow(), k, (1.0, title_boost, id_boost)), "query_id long, id long, score double")
        best = found if best is None else best.unionByName(found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")
    return best.withColumn("rank", place).where(F.col("rank") <= k)


def _local_hits(asked: pa.Table, k: int, boosts: tuple[float, ...]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        users: dict[str, list[int]] = {}
        for i, found in enumerate(asked["words"].to_pylist()):
            for w in found:
                users.setdefault(w, []).append(i)
        machine = ahocorasick.Automaton()
        for w, who in users.items():
            machine.add_word(w, (w, np.array(who)))
        if users:
            machine.make_automaton()
        best = _Best(asked["q"].to_numpy(), k)
        for b in batches:
            for at in range(0, b.num_rows if users else 0, 256):
                part = b.slice(at, 256)
                scores = np.zeros((part.num_rows, asked.num_rows))
                for column, boost in zip(("text", "title", "external_id"), boosts, strict=True):
                    for n, text in enumerate(part.column(column).to_pylist()):
                        for who in dict(x for _, x in machine.iter(text)).values():
                            scores[n, who] += boost
                some = scores.any(axis=1)
                best.add(part.column("id").to_numpy()[some], np.where(scores[some] > 0, scores[some], -np.inf).T)
        yield best.rows()

    return run


def documents_holding(docs: DataFrame, passages: DataFrame, *, block: int = 4096) -> DataFrame:
    """item_id, norm and the number of documents (doc) that hold each passage (item_id, norm). Passages go in blocks of about `block`, all of which are sought in one pass over each document."""
    counts = None
    for part in in_blocks(passages.where("norm IS NOT NULL"), "item_id", block):
        found = docs.select("doc").where("doc IS NOT NULL").mapInArrow(_holders(part.select("item_id", "norm").toArrow()), f"item_id {passages.schema['item_id'].dataType.simpleString()}, n long")
        counts = found if counts is None else counts.unionByName(found)
    total = counts.groupBy("item_id").agg(F.sum("n").alias("n"))
    return passages.join(total, "item_id", "left").select("item_id", "norm", F.coalesce("n", F.lit(0)).alias("documents"))


def _holders(asked: pa.Table):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        places: dict[str, list[int]] = {}
        for i, norm in enumerate(asked["norm"].to_pylist()):
            places.setdefault(norm, []).append(i)
        everywhere = places.pop("", [])
        machine = ahocorasick.Automaton()
        for norm, rows in places.items():
            machine.add_word(norm, rows)
        if places:
            machine.make_automaton()
        n = np.zeros(asked.num_rows, np.int64)
        for b in batches:
            n[everywhere] += b.num_rows
            for text in b.column("doc").to_pylist() if places else ():
                for i in {i for _, rows in machine.iter(text) for i in rows}:
                    n[i] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([asked["item_id"].combine_chunks().take(pa.array(at)), pa.array(n[at])], names=["item_id", "n"])

    return run


def reciprocal_rank_fusion(dense: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, id, score, dense_rank, keyword_rank, dense_score of hits of either list, best first by rank."""
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    w = keyword.select("query_id", "id", F.col("rank").alias("keyword_rank"))
    score = F.coalesce(1.0 / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("keyword_rank")), F.lit(0.0))
    fused = d.join(w, ["query_id", "id"], "full_outer").withColumn("score", F.round(score, 12))
    order = [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("keyword_rank"), "id"]
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def combined_sum(hits: DataFrame) -> DataFrame:
    """Per hit of several phrasings of a query: sum and maximum of scores, and the phrasings in order. hits: query_id, variant, id, score."""
    ordered = F.array_sort(F.collect_list(F.struct("variant")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum("score"), 9).alias("score"), F.max("score").alias("best"), F.transform(ordered, lambda x: x["variant"]).alias("variants"), F.min(F.struct("variant", "rank")).alias("first_seen"))


@dataclass(frozen=True)
class Condition:
    names: tuple[str, ...]
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Where:
    conditions: tuple[Condition, ...] = field(default_factory=tuple)
    logical_operator: str = "and"


_EQUAL, _UNEQUAL, _EMPTY, _FILLED = {"=", "eq", "is"}, {"!=", "ne", "is not"}, {"is null", "empty"}, {"is not null", "not empty"}


def _one(column: Column, operator: str, value: Any) -> Column:
    if operator in _EQUAL:
        return F.coalesce(column == value, F.lit(False))
    if operator in _UNEQUAL:
        return ~column.eqNullSafe(F.lit(value))
    if operator in ("contains", "not contains"):
        if not isinstance(value, str):
            raise TypeError(f"{operator} needs a string, not {value!r}")
        found = F.coalesce(F.contains(column.cast("string"), F.lit(value)), F.lit(False))
        return found if operator == "contains" else ~found
    if operator in ("in", "not in"):
        if not isinstance(value, (list, tuple)):
            raise TypeError(f"{operator} needs a list, not {value!r}")
        found = F.coalesce(column.isin(*value), F.lit(False))
        return found if operator == "in" else ~found
    if operator in _EMPTY:
        return column.isNull() | (column.cast("string") == "")
    if operator in _FILLED:
        return column.isNotNull() & (column.cast("string") != "")
    raise ValueError(f"unknown comparison operator {operator!r}")


def predicate(where: Where) -> Column:
    """The condition as a column; an unknown operator is an error. Several names of a condition are alternatives."""
    clauses = [functools.reduce(Column.__or__, [_one(F.col(n), c.operator, c.value) for n in c.names]) for c in where.conditions]
    if not clauses:
        return F.lit(True)
    return functools.reduce(Column.__and__ if where.logical_operator == "and" else Column.__or__, clauses)


def visible(hits: DataFrame, docs: DataFrame, *, internal: Column | None = None) -> DataFrame:
    """hits with a column `visible`. docs: document_id, library_id, revision, deleted; hits: document_id, library_id, revision."""
    own = docs.select("document_id", F.col("library_id").alias("_library"), F.col("revision").alias("_revision"), F.col("deleted").alias("_deleted"))
    joined = hits.join(own, "document_id", "left")
    ok = F.col("_library").isNotNull() & ~F.col("_deleted") & (F.col("_library") == F.col("library_id")) & (F.col("_revision") == F.col("revision"))
    ok = F.coalesce(ok, F.lit(False))
    return joined.withColumn("visible", ok if internal is None else ~internal | ok).drop("_library", "_revision", "_deleted")


def enriched(hits: DataFrame, source: DataFrame, key: str, column: str, fallback: str) -> DataFrame:
    """hits with `column` of source where its key, read as a number, is known; else the hit's own fallback, else empty."""
    found = source.select(F.col(key).cast("long").alias("_key"), F.col(column).alias("_found"))
    joined = hits.withColumn("_key", F.col(key).try_cast("long")).join(found, "_key", "left")
    return joined.withColumn(column, F.coalesce("_found", F.col(fallback), F.lit(""))).drop("_key", "_found")


def reranked(hits: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """hits (query_id, pos from 0) in the order of results (query_id, index, relevance): the best relevance of each index first, then the hits without one in their own order; k of each query."""
    best = results.where(F.col("index").isNotNull()).groupBy("query_id", F.col("index").alias("pos")).agg(F.max("relevance").alias("relevance"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("relevance"), "pos")
    return hits.join(best, ["query_id", "pos"], "left").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def plan_queries(rules: Iterable[tuple[str, DataFrame]], most: int = 4) -> DataFrame:
    """query_id, ordinal, phrasing: distinct phrasings of several sources in the order of these, `most` of each query."""
    every = None
    for k, (source, df) in enumerate(rules):
        part = df.select("query_id", "phrasing", F.lit(k).alias("_source"), F.lit(source).alias("source"), F.col("ordinal").alias("_ordinal"))
        every = part if every is None else every.unionByName(part)
    first = every.where(F.trim("phrasing") != "").groupBy("query_id", "phrasing").agg(F.min(F.struct("_source", "_ordinal", "source")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at._source", "at._ordinal", "phrasing")).cast("long")
    return first.select("query_id", place.alias("ordinal"), "phrasing", F.col("at.source").alias("source")).where(F.col("ordinal") <= most)


def query_plan(queries: DataFrame, synonyms: DataFrame, most: int = 4) -> DataFrame:
    """query_id, ordinal, phrasing, source: the query as it came, its surface form if that differs, and this form with each synonym in the place of a term that it holds, in the dictionary's order; distinct, `most` at most.

    queries: query_id, query; synonyms: term, synonym, ordinal, a dictionary that people write. A null query is empty; empty phrasings and terms count for nothing.
    """
    q = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"), tx.query_form(F.col("query")).alias("form"))
    pivot = q.select("query_id", F.when(F.col("form") == "", F.col("query")).otherwise(F.col("form")).alias("form"))
    known = synonyms.where("term <> '' AND synonym IS NOT NULL").select("term", "synonym", "ordinal")
    replaced = pivot.join(known, F.contains("form", "term")).select("query_id", "ordinal", F.replace("form", "term", "synonym").alias("phrasing"))
    same = lambda column: q.select("query_id", F.lit(0).alias("ordinal"), F.col(column).alias("phrasing"))
    return plan_queries([("original", same("query")), ("normalised", same("form")), ("synonym", replaced)], most)
