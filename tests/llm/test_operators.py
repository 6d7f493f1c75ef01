"""WARC, BPE, packing, nearest neighbours and images: round trips, brute force, odd rows."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SMALL
from lodestone.llm import bpe, common, images, neighbours, packing, queries, warc
from tests.llm.conftest import CLASHING, ODD

# WARC


def test_warc_same_as_sql(spark, same_as_sql):
    same_as_sql(queries.op2_warc(spark, SMALL), queries.ORACLE_SQL["op2_warc"])


def archive(spark, rows, tmp_path, name, **options):
    pages = spark.createDataFrame(rows, "key long, url string, payload string").repartition(options.pop("partitions", 3))
    folder = f"file://{tmp_path}/{name}"
    return folder, warc.write(pages, folder, **options)


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 200
    rows = [(k, f"http://x/{k}", long if k % 4 == 0 else f"<p>{k}</p>" * k) for k in range(40)]
    rows += [(100, None, None), (101, "", ""), (102, "line\nbreak\t", "\r\nWARC/1.1\r\n\r\n" * 30), (None, "no key", long), (7, "again", long), (0, "again", long)]
    folder, manifest = archive(spark, rows, tmp_path, "a", shards=3, roll_bytes=600)
    assert manifest.count() > 3
    back = warc.read(spark, folder).collect()
    assert sorted((str(r["key"]), r["url"] or "", r["payload_digest"], r["payload_bytes"]) for r in back) == sorted((str(k), u or "", hashlib.sha256((p or "").encode()).hexdigest(), len((p or "").encode())) for k, u, p in rows)
    group = [r for r in back if r["payload_digest"] == hashlib.sha256(long.encode()).hexdigest()]
    assert [r["key"] for r in group if r["record_type"] == "response"] == [0]
    assert all(r["refers_to"] == 0 and r["payload"] == "" for r in group if r["record_type"] == "revisit")
    assert all(r["record_type"] == "response" for r in back if r["payload_bytes"] < 100)


def test_warc_same_bytes_however_the_rows_lie(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"page {k % 30} " * 20) for k in range(200)]
    a, b = (archive(spark, rows, tmp_path, f"p{n}", shards=4, roll_bytes=2000, partitions=n)[1].orderBy("file").collect() for n in (1, 7))
    assert a == b
    assert not list((tmp_path / "p1" / "data").glob(".*.tmp"))


def test_warc_with_one_key_over_and_over(spark, tmp_path):
    """Over half of the rows have one key, others none; long payloads; further columns. Every record has a name of its own, and no shard all rows."""
    rows = [(5, "u", f"text {k} " * 40) for k in range(120)] + [(5, "u", "same " * 40)] * 3 + [(None, None, f"none {k}" * 30) for k in range(40)] + [(k, "v", "long " * 2_000 if k == 7 else f"{k}") for k in range(6, 40)]
    pages = spark.createDataFrame(rows, "key long, url string, payload string").repartition(5)
    for name in CLASHING:
        if name not in pages.columns and name != "payload":
            pages = pages.withColumn(name, F.lit("clash"))
    folder = f"file://{tmp_path}/hot"
    manifest = warc.write(pages.select("key", "url", "payload", *[c for c in pages.columns if c not in ("key", "url", "payload")]), folder, shards=8, roll_bytes=1 << 20).collect()
    assert len({r["shard"] for r in manifest}) >= 4
    back = warc.read(spark, folder).collect()
    assert sorted((str(r["key"]), r["payload_digest"]) for r in back) == sorted((str(k), hashlib.sha256(p.encode()).hexdigest()) for k, _, p in rows)
    assert sum(r["record_type"] == "revisit" for r in back) == 2
    names = []
    for r in manifest:
        with gzip.open(tmp_path / "hot" / r["file"]) as f:
            names += [x["warc-record-id"] for x in warc.parse(io.BufferedReader(f))]
    assert len(names) == len(set(names)) == len(rows)


def test_warc_notices_damage(spark, tmp_path):
    folder, manifest = archive(spark, [(1, "u", "payload")], tmp_path, "d", shards=1)
    path = tmp_path / "d" / manifest.first()["file"]
    content = bytearray(path.read_bytes())
    content[len(content) // 2] ^= 1
    path.write_bytes(content)
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read(spark, folder).collect()


def test_warc_of_nothing(spark):
    assert warc.digest_table(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_bpe_same_as_the_library(spark, library):
    docs = common.table(spark, SMALL, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in queries.op4_bpe(spark, SMALL).collect():
        ids, decoded = expected(library, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_on_odd_rows(spark, odd, empty, library):
    path = queries.vocabulary("word_bpe_49k.json")
    texts = sorted(ODD, key=str)
    got = sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in bpe.tokens(odd, path).collect()), key=str)
    assert got == sorted(((i, *expected(library, t)) for i, t in texts), key=str)
    assert bpe.digests(empty, path).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeothnsi AEIT'’.,<>|0123\n\t\xa0　ß"), st.characters(codec="utf-8")), max_size=60))
def test_bpe_of_any_text(text):
    words = bpe.worker(queries.vocabulary("word_bpe_49k.json"))
    ids, decoded = bpe.encode(text, words)
    want = expected(words.bpe.library, text)
    assert (list(struct.unpack(f"<{len(ids) // 4}I", ids)), decoded) == want


# Packing


def padding(lengths, counts, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts, strict=True))


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_bucket_ends_are_the_best(histogram, buckets):
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths])
    best = min(padding(lengths, counts, [*inner, lengths[-1]]) for n in range(min(buckets, len(lengths))) for inner in itertools.combinations(lengths[:-1], n))
    assert padding(lengths, counts, packing.bucket_ends(lengths, counts, buckets)) == best


def check_packing(rows, budget, ids):
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, ids))
    batches = {}
    for r in rows:
        if r["n_tokens"] == 0:
            assert (r["bucket"], r["batch"], r["place"]) == (-1, -1, -1)
            continue
        assert r["n_tokens"] <= r["padded_to"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for members in batches.values():
        assert len(members) == 1 or len(members) * members[0]["padded_to"] <= budget
        assert sorted(r["place"] for r in members) == list(range(len(members)))
    for bucket in {b for b, _ in batches}:
        own = sorted(k for b, k in batches if b == bucket)
        assert own == list(range(len(own)))
        assert len({len(batches[bucket, k]) for k in own[:-1]}) <= 1  # all but the last are full


def test_packing(spark, odd, empty):
    docs = common.table(spark, SMALL, "documents")
    check_packing(packing.pack(docs, budget=4096, salts=7).collect(), 4096, [r[0] for r in docs.select("doc_id").collect()])
    check_packing(packing.pack(odd, budget=64).collect(), 64, [i for i, _ in ODD])
    assert packing.pack(empty).count() == 0


def test_long_texts_are_padded_to_a_length_among_them(spark):
    rows = packing.pack(spark.createDataFrame([(k, n) for k, n in enumerate([5461, 5460, 5461, 3000, 10])], "doc_id long, n long"), length=F.col("n"), buckets=3).collect()
    assert {r["n_tokens"]: r["padded_to"] for r in rows} == {5461: 5461, 5460: 5461, 3000: 3000, 10: 10}
    assert len({(r["bucket"], r["batch"]) for r in rows if r["n_tokens"] > 5000}) == 1


# Nearest neighbours


def brute_nearest(ids, x, queries_, k):
    out = {}
    for q in queries_:
        d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(axis=1))
        out[q] = sorted((float(s), int(i)) for s, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


def test_nearest_finds_nine_in_ten(spark):
    rows = common.table(spark, "/root/testdata/sf0.01", "embeddings").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    rng = np.random.default_rng(4)
    more = np.concatenate([x + rng.normal(0, s, x.shape) for s in (0, 0.02, 0.05, 0.1, 0.1, 0.2)]).astype(np.float32).astype(float)
    numbers = np.arange(len(more))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(numbers, more, strict=True)], "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, F.col("id") % 100 == 0, sample=1000).collect()
    best = brute_nearest(numbers, more, numbers[::100], 10)
    got = {q: [(r["score"], r["vec_id"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] for q in best}
    assert all(v == sorted(v) and len(v) == 10 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in best[q]}) for q in best)
    assert hits >= 0.9 * 10 * len(best)
    exact = {(q, r["vec_id"]): r["score"] for q in best for r in found if r["query_id"] == q}
    assert all(s == pytest.approx(np.linalg.norm(more[q] - more[i]), rel=1e-12, abs=1e-12) for (q, i), s in exact.items())


def recall_of(spark, x, **options):
    """Recall of the ten nearest of every hundredth row, and the share of rows that the forest ranks for one."""
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, F.col("id") % 100 == 0, **options).collect()
    best = brute_nearest(ids, x, ids[::100].tolist(), 10)
    got: dict = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(got[q]) == 10 for q in best)
    sample = np.sort(np.random.default_rng(1).choice(len(x), options["sample"], replace=False))
    forest = neighbours.Forest(ids[sample], x[sample], trees=8, leaf=32, cell=1024, tries=4, recall=0.94, k=10)
    return sum(len(got[q] & {i for _, i in best[q]}) for q in best) / (10 * len(best)), neighbours.ranked_share(x, ids, ids[::100], forest)


def test_forest_alone_on_points_with_structure(spark):
    """Twenty times as many rows as the sample has: nothing is found but in leaves, and these hold a small share of the rows."""
    rng = np.random.default_rng(20)
    x = (rng.normal(size=(200, 8))[rng.integers(0, 200, 20_000)] + 0.3 * rng.normal(size=(20_000, 8))) @ rng.normal(size=(8, 32)) + 0.05 * rng.normal(size=(20_000, 32))
    recall, share = recall_of(spark, x, sample=1000)
    assert recall >= 0.9 and share < 0.25


def test_forest_alone_on_points_without_structure(spark):
    table = common.table(spark, "/root/testdata/sf0.1", "embeddings").orderBy("vec_id").collect()
    recall, share = recall_of(spark, np.array([r["embedding"] for r in table], float), sample=1000)
    assert recall >= 0.9 and share < 0.8


def test_nearest_returns_all_of_few_candidates(spark):
    rng = np.random.default_rng(21)
    df = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(0, 90, 10)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, F.col("id") >= 0, leaf=2, cell=2).groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).collect()
    assert len(found) == 9 and all(r["n"] == 8 for r in found)


def test_nearest_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (None, [1.0, 1.0]), (10, [0.5, 0.5]), (10, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, tree string, score int")
    found = neighbours.nearest(df, F.col("id") % 5 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(0, 1), (0, 2), (0, 10), (10, 2), (10, 0), (10, 1)]
    assert neighbours.nearest(df.limit(0), F.col("id") % 5 == 0).count() == 0
    assert neighbours.nearest(df, F.col("id") == 77).count() == 0


def test_nearest_with_repeated_ids(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 4))
    rows = [(k, v.tolist()) for k, v in enumerate(x) for _ in range(2)]
    rows += [(7, (x[0] + rng.normal(0, 0.01, 4)).tolist()) for _ in range(100)]  # 100 rows of one id, nearer to id 0 than all others
    # one leaf holds all rows, so the answer is exact
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, leaf=1000, block=100).collect()
    for q in range(0, 400, 50):
        best: dict = {}
        for i, v in rows:
            if i != q:
                best[i] = min(best.get(i, np.inf), float(np.linalg.norm(np.array(v) - x[q])))
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        want = sorted((s, i) for i, s in best.items())[:10]
        assert [i for _, i, _ in got] == [i for _, i in want]
        assert [s for *_, s in got] == pytest.approx([s for s, _ in want], rel=1e-9)


def test_nearest_with_one_point_over_and_over(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 == 0 else rng.normal(size=3).astype(np.float32).tolist()) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, F.col("id") % 300 == 0, block=64).where("query_id = 300").orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]
    assert all(r["score"] == 0 for r in found)


# Images


def picture(rng, rows=40, columns=16):
    return np.kron(rng.integers(0, 256, (rows, columns)).astype(np.uint8), np.ones((4, 4), np.uint8))


def test_cropped_and_edited_copies(spark):
    rng = np.random.default_rng(7)
    originals = [picture(rng) for _ in range(6)]
    rows = []
    for k, p in enumerate(originals):
        noisy = np.clip(p.astype(int) + rng.integers(-3, 4, p.shape), 0, 255).astype(np.uint8)
        brighter = np.clip(p.astype(int) * 0.9 + 15, 0, 255).astype(np.uint8)
        for j, x in enumerate((p, p, p[20:, :], p[:100, 7:], noisy, brighter, p[::-1, ::-1], np.rot90(p))):
            rows.append((10 * k + j, images.png(np.ascontiguousarray(x))))
    rows += [(200, None), (201, b""), (202, b"no picture"), (None, rows[0][1]), (203, images.png(np.zeros((40, 64), np.uint8))), (203, rows[0][1]), (204, images.png(np.zeros((40, 64), np.uint8)))]
    df = spark.createDataFrame(rows, "id long, image binary")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    got = images.copies(df).collect()
    assert len(got) == len(rows)
    found = {r["id"]: r for r in got}
    for k in range(6):
        assert [found[10 * k + j]["component_id"] for j in range(8)] == [10 * k] * 8
        assert found[10 * k + 1]["class_id"] == 10 * k
    assert all(found[i]["component_id"] == i for i in (200, 201, 202))
    assert {r["component_id"] for r in got if r["id"] in (203, 204)} <= {0, 203}  # the two images of one id join one group
    assert found[204]["class_id"] == 203 and found[None]["component_id"] is None


def test_an_edited_copy_of_a_short_page(spark):
    words = [f"word{k}" for k in range(60)]
    edited = [*words[:50], *(f"other{k}" for k in range(10))]
    pages = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(f"apart{k}" for k in range(60)))], "page_id long, html string")
    assert {r["id"]: r["component_id"] for r in images.copies(images.render(pages)).collect()} == {1: 1, 2: 1, 3: 3}


def test_very_tall_images_and_repeated_patterns(spark):
    """A page of 400,000 words, part of it again, and one row of words over and over: bands leave no seam."""
    rng = np.random.default_rng(11)
    long = [f"w{k}" for k in rng.integers(0, 10**9, 400_000)]
    pages = [(1, " ".join(long)), (2, " ".join(long[160_000:320_000])), (3, "many words in a row " * 40_000), (4, "many words in a row " * 30_000)]
    df = spark.createDataFrame(pages, "page_id long, html string").repartition(2)
    assert {r["id"]: r["component_id"] for r in images.copies(images.render(df)).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_key_points_in_bands_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(12)
    p = [picture(rng, rows, 16) for rows in (150, 3, 90)]
    whole = images.key_points(p)
    monkeypatch.setattr(images, "RUN_PIXELS", 4000)
    for (x, a), (y, b) in zip(whole, images.key_points(p), strict=True):
        assert (x == y).all() and (a == b).all() and len(a)
    assert (images.unpacked_places(images.packed_places(whole[0][0])) == whole[0][0]).all()


def all_pairs_of_images(rows):
    """Component of each id by comparing all pairs. rows: id, node, places, codes."""
    points = [(images.unpacked_places(np.array(r["places"], np.int64).reshape(-1)), np.array(r["codes"], np.int64).view(np.uint64)) for r in rows]
    root = {r["id"]: r["id"] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k in range(len(rows)):
        same = images.copies_of([points[k]] * k, points[:k])
        for m in range(k):
            if same[m] or rows[k]["node"] is not None and rows[k]["node"] == rows[m]["node"]:
                x, y = sorted((find(rows[k]["id"]), find(rows[m]["id"])))
                root[y] = x
    return {i: find(i) for i in root}


def test_images_same_as_all_pairs(spark):
    table = images.described(images.render(common.table(spark, SMALL, "pages"))).collect()
    found = {r["id"]: r["component_id"] for r in queries.op10_image_copies(spark, SMALL).collect()}
    assert found == all_pairs_of_images(table)


def test_images_that_share_passages_same_as_all_pairs(spark, monkeypatch):
    """Shared regions of all sizes around the least that makes a link, chains of crops, and lists split into blocks."""
    monkeypatch.setattr(images, "BLOCK", 4)
    rng = np.random.default_rng(13)
    common_part, rows = picture(rng, 12), []
    for k in range(60):
        own = picture(rng, int(rng.integers(4, 40)))
        x = [np.concatenate([own, common_part[: 4 * int(rng.integers(1, 13))]]), np.concatenate([common_part[4 * int(rng.integers(0, 8)) :], own]), own][k % 3]
        rows.append((k, images.png(np.ascontiguousarray(x))))
    tall = picture(rng, 200)
    rows += [(100 + k, images.png(np.ascontiguousarray(tall[80 * k : 80 * k + 160]))) for k in range(9)]
    df = spark.createDataFrame(rows, "id long, image binary")
    want = all_pairs_of_images(images.described(df).collect())
    assert {r["id"]: r["component_id"] for r in images.copies(df).collect()} == want
    assert len(set(want.values())) > 10 and want[108] == 100 and sum(i != c for i, c in want.items()) > 20


def test_images_of_nothing(spark):
    assert images.copies(spark.createDataFrame([], "id long, image binary")).count() == 0


def test_png_round_trip():
    p = picture(np.random.default_rng(8), 5, 7)
    assert (images.pixels_of(images.png(p)) == p).all()
    assert images.pixels_of(b"") is None and images.pixels_of(None) is None and images.pixels_of(images.png(p)[:40]) is None
