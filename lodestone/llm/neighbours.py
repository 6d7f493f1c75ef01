"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample (`sample` rows): a node splits at the median along the difference of two of its
rows, the most spread of a few such directions, until `leaf` of them are left. Every row of the table is then put into
one leaf of each tree. A query walks all trees through one priority queue, nearest splits first, until the leaves it has
visited hold `budget` of the rows of all trees; their members are ranked exactly, on the original components. The sample
serves to fit the trees and the budget only: all that is returned was found in a leaf.

The budget is measured, not assumed: queries from the sample are held against brute force over the sample, and the
smallest budget with the wanted recall there is taken. Over more rows the neighbours are closer, so recall is no lower.
A walk does not end before it has met k other ids of the sample, so with fewer rows than that it meets all. On data
without structure a large share of the rows must be ranked, as by any such index (`ranked_share` measures it).

Leaves are dealt out by cells, subtrees of some hundred rows of the sample, in blocks of `block` rows, and queries in
blocks too: one point that a third of all rows share fills many tasks, not one. Every row is indexed, no leaf is cut.

Rows whose components are null, zero, hold nulls or non-finite numbers, or have not the most common length (the shortest,
if lengths tie) take no part, nor do null ids. Rows that repeat an id count as one at the smaller distance: equal rows
are dropped first, others are reduced before any cut to `k`. An empty table, or one without queries, gives an empty
result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of lists of equal length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


class Forest:
    """Trees as arrays of nodes. Leaves are numbered; a cell is a subtree with at most `cell` points of the sample."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, *, trees: int, leaf: int, cell: int, tries: int, recall: float, k: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.k = k
        self.trees = [self._grow(points, rng, leaf, cell, tries) for _ in range(trees)]
        own = [self.leaves(points, t) for t in range(trees)]
        self.shares = [np.bincount(own[t], minlength=len(self.trees[t][0])) / max(1, len(points)) / max(1, trees) for t in range(trees)]
        self.known = [{int(at): np.unique(ids[own[t] == at]) for at in np.unique(own[t])} for t in range(trees)]
        self.budget = self._measure(ids, points, own, rng, recall)

    @staticmethod
    def _grow(points: np.ndarray, rng: np.random.Generator, leaf: int, cell: int, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each node: direction, border, left child (the right one follows; 0: a leaf), cell."""
        ways, borders, lefts, cells = [np.zeros(points.shape[1])], [0.0], [0], [-1]
        todo = [(0, np.arange(len(points)), -1)]
        while todo:
            at, rows, inside = todo.pop()
            if inside < 0 and len(rows) <= max(cell, leaf):
                inside = at
            cells[at] = inside
            best = None
            for _ in range(tries if len(rows) > leaf else 0):
                a, b = rng.choice(rows, 2, replace=False)
                w = points[a] - points[b]
                length = np.linalg.norm(w)
                if length:
                    p = points[rows] @ (w / length)
                    if best is None or p.var() > best[0]:
                        best = p.var(), w / length, p
            if best is not None:
                border = float(np.median(best[2]))
                left = best[2] <= border
                if left.all():  # over half of the points lie on the border
                    left = best[2] < border
                    border = float(np.nextafter(border, -np.inf))
            if best is None or left.all() or not left.any():
                cells[at] = at if inside < 0 else inside
                continue
            ways[at], borders[at], lefts[at] = best[1], border, len(lefts)
            todo += [(len(lefts), rows[left], inside), (len(lefts) + 1, rows[~left], inside)]
            for column, blank in ((ways, ways[0] * 0), (borders, 0.0), (lefts, 0), (cells, -1)):
                column += [blank, blank]
        return np.array(ways), np.array(borders), np.array(lefts), np.array(cells)

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each row."""
        ways, borders, lefts, _ = self.trees[tree]
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not lefts[at]:
                out[rows] = at
            elif len(rows):
                low = x[rows] @ ways[at] <= borders[at]
                todo += [(lefts[at], rows[low]), (lefts[at] + 1, rows[~low])]
        return out

    def visit(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf), those with the nearest splits first. Each entry of the queue is a subtree with the squared distance to its region, summed over splits."""
        offs = [(ways @ x - borders).tolist() for ways, borders, _, _ in self.trees]
        lefts = [t[2].tolist() for t in self.trees]
        queue = [(0.0, t, 0) for t in range(len(self.trees))]
        while queue:
            far, t, at = heapq.heappop(queue)
            while left := lefts[t][at]:
                off = offs[t][at]
                near, other = (left, left + 1) if off <= 0 else (left + 1, left)
                heapq.heappush(queue, (far + off * off, t, other))
                at = near
            yield t, at

    def _measure(self, ids: np.ndarray, points: np.ndarray, own: list[np.ndarray], rng: np.random.Generator, recall: float) -> float:
        n = len(points)
        needed = [np.zeros(0)]
        for q in rng.choice(n, min(200, n), replace=False):
            d = ((points - points[q]) ** 2).sum(axis=1)
            d[ids == ids[q]] = np.inf
            nearest = first_of_each(ids, np.argsort(d, kind="stable"))[: self.k]
            nearest = nearest[np.isfinite(d[nearest])]
            found, seen = np.full(len(nearest), 1.0), 0.0
            for t, at in self.visit(points[q]):
                seen += self.shares[t][at]
                found = np.where(own[t][nearest] == at, np.minimum(found, seen), found)
                if found.max(initial=0.0) < seen:
                    break
            needed.append(found)
        needed = np.concatenate(needed)
        return float(np.quantile(needed, recall)) if len(needed) else 1.0

    def search(self, query: int, x: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """The leaves to visit, by tree and cell. They hold `budget` of all rows of all trees, and k other ids of the sample if there are as many."""
        found: dict[tuple[int, int], list[int]] = {}
        seen, others = 0.0, {query}
        for t, at in self.visit(x):
            found.setdefault((t, int(self.trees[t][3][at])), []).append(at)
            seen += self.shares[t][at]
            if len(others) <= self.k:
                others.update(self.known[t].get(at, ()))
            if seen >= self.budget - 1e-12 and len(others) > self.k:
                break
        return found


def first_of_each(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of the rows in this order, the first one of each id."""
    return order[np.sort(np.unique(ids[order], return_index=True)[1])]


def usable(points: DataFrame, id_column: str, point_column: str) -> DataFrame:
    """id and v (array<double>) of the rows that take part."""
    v = F.col(point_column).cast("array<double>")
    ok = F.col(id_column).isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(x.between(-1.7e308, 1.7e308) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return points.where(ok).select(F.col(id_column).cast("long").alias("id"), v.alias("v"))


def nearest(points: DataFrame, is_query: Column, *, id_column: str = "vec_id", point_column: str = "embedding", k: int = 10, trees: int = 8, leaf: int = 32, cell: int = 1024, tries: int = 4, sample: int = 20000, recall: float = 0.94, block: int = 4096, query_block: int = 2048, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: of each row for which is_query (over the column id) holds, the k nearest found among the others."""
    spark = points.sparkSession
    all_rows = usable(points, id_column, point_column)
    lengths = all_rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = all_rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0)).distinct()
    chosen = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).toArrow()  # `sample` rows at most
    forest = spark.sparkContext.broadcast(Forest(chosen["id"].to_numpy(), matrix(chosen["v"]), trees=trees, leaf=leaf, cell=cell, tries=tries, recall=recall, k=k, seed=seed))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"))
            for t in range(len(forest.value.trees) if len(x) else 0):
                at = forest.value.leaves(x, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(forest.value.trees[t][3][at], pa.int32()), pa.array(at, pa.int32()), b.column("id"), b.column("v")], names=["tree", "cell", "leaf", "id", "v"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (q, x) in enumerate(zip(b.column("id").to_pylist(), matrix(b.column("v")), strict=True)):
                found = forest.value.search(q, x)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([q] * n, pa.int64()), *[pa.array([key[c] for key in found], pa.int32()) for c in (0, 1)], pa.array(found.values(), pa.list_(pa.int32())), b.column("v").take(pa.array([i] * n, pa.int32()))], names=["query", "tree", "cell", "leaves", "v"])

    def rank(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if members.num_rows and queries.num_rows:
            members = members.sort_by("leaf")
            x, ids, leaf = matrix(members["v"]), members["id"].to_numpy(), members["leaf"].to_numpy()
            repeated = len(np.unique(ids)) < len(ids)
            for q, y, visited in zip(queries["query"].to_numpy(), matrix(queries["v"]), queries["leaves"].to_pylist(), strict=True):
                at = np.flatnonzero(np.isin(leaf, visited) & (ids != q))
                d = np.sqrt(((x[at] - y) ** 2).sum(axis=1))
                if len(at) > 4 * k and not repeated:  # the k nearest and all that tie with the last
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                    at, d = at[near], d[near]
                best = np.lexsort((ids[at], d))
                best = (first_of_each(ids[at], best) if repeated else best)[:k]
                out[0].append(np.full(len(best), q))
                out[1].append(ids[at][best])
                out[2].append(d[best])
        return pa.table({"query": np.concatenate(out[0]), "id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    members = common.saved(rows.mapInArrow(index, "tree int, cell int, leaf int, id long, v array<double>"), "forest")
    visits = common.saved(rows.where(is_query).mapInArrow(walk, "query long, tree int, cell int, leaves array<int>, v array<double>"), "walks")
    member_blocks = members.groupBy("tree", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("mb"))
    query_blocks = visits.groupBy("tree", "cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("qb"))
    blocks = F.broadcast(member_blocks.join(query_blocks, ["tree", "cell"]))  # a row for each cell: 2 * sample / leaf * trees at most
    dealt = members.join(blocks, ["tree", "cell"]).select("tree", "cell", F.pmod(F.xxhash64("id", "v"), F.col("mb")).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "leaf", "id", "v")
    asked = visits.join(blocks, ["tree", "cell"]).select("tree", "cell", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.pmod(F.xxhash64("query"), F.col("qb")).cast("int").alias("q"), "query", "leaves", "v")
    key = ["tree", "cell", "m", "q"]
    ranked = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(rank, "query long, id long, score double")
    once = ranked.groupBy("query", "id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def ranked_share(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, forest: Forest) -> float:
    """The mean share of all rows that the leaves visited for some queries (row numbers) hold, each row once."""
    own = [forest.leaves(points, t) for t in range(len(forest.trees))]
    shares = []
    for q in queries:
        seen = np.zeros(len(points), bool)
        for (t, _), at in forest.search(int(ids[q]), points[q]).items():
            seen |= np.isin(own[t], at)
        shares.append(seen.mean())
    return float(np.mean(shares))
