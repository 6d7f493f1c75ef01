"""Trimming of neighbours and blocks of queries against plain versions."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.graph import bounded_bfs, expand, link_decisions, within_budget
from lodestone.operators.retrieval import _local_best, documents_holding, exact_topk, in_blocks


def trimmed(neighbours: list, size: int, budget: int) -> list:
    """Step by step: the farthest goes, of two as far the one that follows."""
    left = sorted(neighbours)
    while left and size + sum(x[3] for x in left) > budget:
        left.pop()
    return left


def test_neighbours_within_budget(spark):
    rng = random.Random(5)
    rows = [(0, 90, [(2, 1, 12, 5), (2, 0, 8, 5), (1, 0, 9, 0), (None, 1, None, None)], 95), (1, 200, [(1, 1, 3, 1)], 100), (2, 5, [], 100)]
    for k in range(3, 80):
        around = [(d, side, 10 * d + side, rng.randrange(4) * 20) for d in (1, 2, 5) for side in (0, 1) if rng.random() < 0.8]
        rng.shuffle(around)
        rows.append((k, rng.randrange(60), around, 100))
    df = spark.createDataFrame(rows, "k int, size int, near array<struct<distance: int, side: int, id: int, size: int>>, budget int")
    got = {r.k: [tuple(x) for x in r.kept] for b in (95, 100) for r in df.where(F.col("budget") == b).select("k", within_budget(F.col("near"), F.col("size"), b).alias("kept")).collect()}
    assert got == {k: trimmed([x for x in near if x[0] is not None], size, budget) for k, size, near, budget in rows}


def test_blocks_of_queries_hold_each_query_once(spark):
    queries = spark.createDataFrame([(i if i else None, f"w{i} ") for i in range(50)], "item_id long, norm string")
    parts = in_blocks(queries, "item_id", 7)
    assert len(parts) > 1
    assert sorted(r.norm for p in parts for r in p.collect()) == sorted(r.norm for r in queries.collect())
    docs = spark.createDataFrame([("w1 w2 ",), ("w2 ",), (None,), ("",)], "doc string")
    found = {r.norm: r.documents for r in documents_holding(docs, queries.where("item_id IS NOT NULL"), block=7).collect()}
    assert (found["w1 "], found["w2 "], found["w3 "], len(found)) == (1, 2, 0, 49)


def test_best_points_of_a_full_block_take_little_memory():
    """A block of 4,096 queries meets batches of 10,000 points, among them equal ones; as much is held after one batch as after three."""
    rng, k = np.random.default_rng(4), 20
    points = rng.integers(-9, 9, (30_000, 4)).astype(float) + 0.5
    ids = rng.permutation(len(points))
    queries = rng.normal(size=(4096, 4))
    lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 4).cast(pa.list_(pa.float64()))
    batches = [pa.record_batch({"id": pa.array(ids[i : i + 10_000]), "v": lists(points[i : i + 10_000])}) for i in range(0, 30_000, 10_000)]
    tracemalloc.start()
    out = pa.Table.from_batches(_local_best(pa.table({"q": pa.array(range(4096)), "v": lists(queries)}), k, None)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    got: dict = {}
    for q, i in zip(out["query_id"].to_pylist(), out["id"].to_pylist(), strict=True):
        got.setdefault(q, []).append(i)
    for q in range(0, 4096, 64):
        s = np.round(points @ queries[q] / np.sqrt((queries[q] ** 2).sum()) / np.sqrt((points**2).sum(axis=1)), 9)
        assert got[q] == list(ids[np.lexsort((ids, -s))[:k]])


def test_best_points_same_as_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(2 + (i % 5 == 0))]) for i in range(400)] + [(900, None), (901, [None, 1.0]), (902, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for least in (None, 0.3):
        got: dict = {}
        for r in exact_topk(df, df.where("vec_id % 20 = 0"), 7, min_score=least, block=9).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.score))
        want: dict = {}
        usable = [(i, np.array(v)) for i, v in rows if v and None not in v and any(v)]
        for q, y in usable:
            if q % 20 == 0:
                s = [(-round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 9), i) for i, x in usable if len(x) == len(y)]
                if found := [(i, -c) for c, i in sorted(s) if least is None or -c >= least][:7]:
                    want[q] = found
        assert got == want


def test_links_same_as_all_pairs(spark):
    rng = random.Random(8)
    names = [f"Customer#{k:09d}" for k in range(60)] + ["".join(rng.choice("ab é") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["red fox den", "fox", "x", "日本", "日本語", "aaaa", ""]
    entities = [(f"N{k % 100}", "cd"[k % 7 == 0], n) for k, n in enumerate(names)]  # some ids have two names
    texts = [n[:-1] for n in names[:60]] + [n.replace("#", " # ") for n in names[:60:7]] + [n[1:] for n in names[60:]] + ["den fox", "x y", "aaa", "nothing like it", None]
    mentions = [(k, ["c", "d", None][k % 5 - 2 if k % 5 > 2 else k % 5 == 0], t) for k, t in enumerate(texts)]
    m, e = spark.createDataFrame(mentions, "mention_id long, type_key string, text string"), spark.createDataFrame(entities, "node_id string, type_key string, name string")
    a, b = m.select("mention_id", "type_key", tx.graph_name(F.col("text")).alias("m")), e.select("node_id", "type_key", tx.graph_name(F.col("name")).alias("e"))
    scored: dict = {}
    for r in a.join(b.withColumnRenamed("type_key", "etype"), F.col("type_key").isNull() | (F.col("type_key") == F.col("etype"))).where("m <> '' AND e <> ''").select("mention_id", "node_id", "e", (F.col("m") == F.col("e")).alias("same"), tx.pair_score(F.col("m"), F.col("e")).alias("score")).collect():
        scored.setdefault(r.mention_id, []).append(r)
    want = {}
    for k, *_ in mentions:
        rows = scored.get(k, [])
        best: dict = {}
        for r in rows:
            score = 1_000_000 if r.same else 0 if any(x.same for x in rows) else r.score
            if score >= 500_000:
                best[r.node_id] = min((-score, r.e), best.get(r.node_id, (0, "")))
        top = [(s, n) for (s, _), n in sorted((x, n) for n, x in best.items())[:10]]
        if not top:
            want[k] = ("not_found", None, None, None, 0)
            continue
        score, gap = -top[0][0], -top[0][0] + (top[1][0] if len(top) > 1 else 0)
        linked = score >= 800_000 and gap >= 50_000
        want[k] = ("linked" if linked else "ambiguous", top[0][1] if linked else None, score, gap, len(top))
    assert len({w[0] for w in want.values()}) == 3
    for block in (16, 1024):
        got = {r.mention_id: (r.status, r.selected, r.score, r.margin, r.n_candidates) for r in link_decisions(m, e, **({"block": block} if block < 1024 else {})).collect()}
        assert got == want


def test_hub_is_cut_before_its_edges_are_dealt_by_query(spark):
    """A hub of 100,000 edges: the first in canonical order stay, and the plan limits them in each task."""
    from pyspark.sql import functions as F

    from lodestone.operators.graph import bounded_bfs

    edges = spark.range(100_000).select(F.lit("r").alias("relation"), F.lit("hub").alias("src"), F.format_string("n%06d", "id").alias("tgt"))
    found = bounded_bfs(edges, spark.createDataFrame([(1, "hub"), (2, "n000007")], "query int, node string"), hops=2, max_nodes=50, max_relations=60)
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
    rows = found.collect()
    one, two = (sorted(r["tgt"] for r in rows if r["query"] == q) for q in (1, 2))
    assert one == [f"n{k:06d}" for k in range(49)] and all(r["truncated"] for r in rows)
    assert two == [f"n{k:06d}" for k in range(49)]


def test_lexical_scores_are_dealt_out_however_small_the_file(spark):
    """The part table is one small file; the work on its rows is no single task."""
    from lodestone import plans

    df = plans.QUERIES["text_lexical_scores"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_edges_of_a_hub_meet_its_queries_cut(spark):
    """Of a hub's edges no more come to each query than can stay; what stays is what a walk over all of them keeps."""
    hub = [("r", f"a{i:03d}", "hub") for i in range(300)] + [("q", "hub", f"b{i:03d}") for i in range(300)] + [("r", "a000", "hub")]
    edges = spark.createDataFrame(hub + [("o", "a001", "b001"), ("p", "hub", "hub")], "relation string, src string, tgt string")
    seeds = spark.createDataFrame([(i, f"a{i:03d}") for i in range(20)], "query int, node string")
    cap = 7
    hop = expand(edges, seeds.select("query").withColumn("node", F.lit("hub")), most=2 * cap + 1)
    assert hop.count() <= 20 * 2 * (2 * cap + 2)
    got: dict = {}
    for r in bounded_bfs(edges, seeds, hops=2, max_nodes=1000, max_relations=cap).collect():
        got.setdefault(r.query, set()).add((r.hop, r.relation, r.src, r.tgt, r.truncated))
    all_edges = sorted({*hub, ("o", "a001", "b001"), ("p", "hub", "hub")})
    for q in range(20):
        seed = f"a{q:03d}"
        first = [e for e in all_edges if seed in e[1:]]
        known = {seed, *(x for e in first for x in e[1:])}
        second = [e for e in all_edges if known.difference([seed]).intersection(e[1:]) and e not in first][: cap - len(first)]
        assert got[q] == {(1, *e, True) for e in first} | {(2, *e, True) for e in second}
