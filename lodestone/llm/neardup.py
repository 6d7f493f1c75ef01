"""Near-duplicates by an inverted join over MinHash signature coordinates, confirmed on full shingle sets.

1. Each text becomes the set of its distinct `size`-word shingles (64-bit hashes) and a signature of `COORDINATES`
   minima. Texts with equal sets form a class; only its smallest id goes on.
2. A pair of similarity s agrees in about s * COORDINATES places. Pairs that agree in fewer than `matches(s)` are not
   looked at: of pairs right at the threshold about one in 10 ** 12, and far fewer above it.
3. Prefix: with every class's coordinate-value pairs in one global order, rarest first, two classes that agree in m
   places share one among their first COORDINATES - m + 1. Only those are posted, so the long lists of common
   passages are skipped unless most of a text is made of them; a value of one class alone is not posted either.
4. Each list ties its members to its most central one (whose values are the most common), not to each other. Matching
   coordinates are counted on both whole signatures, then the link is confirmed on both whole sets; confirmed links
   give groups.
5. What step 4 has left apart is compared in full: in every list whose members lie in several groups, members outside
   the central one's group meet all members of other groups. A group of n copies so costs about n comparisons, and no
   pair that could join two groups stays untested. Members of lists of over `LONG` instead meet by whole shingles, again
   by their prefixes, rarest first: a pair goes on if a shared shingle stands so early in both that enough can follow.

Texts are joined by id only after a filter that keeps the documents of a bitmap of hashed ids, of bounded size.

Groups are the components of the links, found by joins that pass the smallest id on.

Null and empty texts, or texts of blanks only, have an empty set: they are linked with nothing and stand for themselves. Rows
that repeat a doc_id are versions of one document: their links join one group. Null ids are left out of the links; component_id is then null and
kept is true.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common, words

COORDINATES = 48
TOGETHER, LONG, BLOCK = 64, 32, 512
_FACTORS = np.random.default_rng(48).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def matches(percent: int) -> int:
    """The greatest number of coordinates in which a pair right at the threshold agrees but for one case in 10 ** 12."""
    s, below = percent / 100, 0.0
    for m in range(COORDINATES + 1):
        below += math.comb(COORDINATES, m) * s**m * (1 - s) ** (COORDINATES - m)
        if below > 1e-12:
            return max(1, m)
    return COORDINATES


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes. A text of fewer words has one, of all its words."""
    for first, end, data, offsets in common.slices(column):
        h, bounds = words.hash_words(data, offsets)
        n = len(h) - size + 1
        if n > 0:
            rolled = np.zeros(n, np.uint64)
            for k in range(size):
                rolled = words.mix(rolled * _A + h[k : k + n] * _B + _C)
        for i in range(end - first):
            a, z = int(bounds[i]), int(bounds[i + 1])
            if z - a >= size:
                s = np.sort(rolled[a : z - size + 1])
                yield s[np.flatnonzero(np.diff(s, prepend=s[0] ^ np.uint64(1)))]
            elif z > a:
                one = np.full(1, z - a, np.uint64)
                for k in range(a, z):
                    one = words.mix(one * _A + h[k : k + 1] * _C + _B)
                yield one
            else:
                yield h[:0]


def signature(s: np.ndarray) -> np.ndarray:
    """The upper halves of the least product of the set's members with each factor."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        np.minimum(low, (s[None, k : k + 2048] * _FACTORS[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sets_table(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (size of the set), h1 and h2 (what tells one set from another), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(s), int(words.mix(s).sum().view(np.int64)), int(words.mix(s ^ _A).sum().view(np.int64)), signature(s)) for s in shingle_sets(b.column("text"), size)]
            n, h1, h2, sig = zip(*rows, strict=True) if rows else ((), (), (), ())
            flat = pa.array(np.concatenate(sig) if sig else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * COORDINATES, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists], names=["doc_id", "n", "h1", "h2", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, signature array<int>")


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes that agree in enough coordinates and whose sizes allow the similarity."""
    least = matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES) for k in ("x", "y"))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("signature").alias("x"))
    two = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("y"))
    both = pairs.join(one, "a").join(two, "b").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets have 100 * intersection >= percent * union.

    The texts are joined once, to a's and b's together; a's text then stands before those of `TOGETHER` or so partners, and
    a with more of them is dealt out several times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, []
        for batch in batches:
            found = []
            group = zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), batch.column("role").to_pylist(), batch.column("doc").to_pylist(), strict=True)
            for (a, part, role, doc), s in zip(group, shingle_sets(batch.column("text"), size), strict=True):
                if (a, part) != last:
                    last, known = (a, part), []
                if role == 0:
                    known.append(s)
                    continue
                for x in known:
                    same = len(np.intersect1d(x, s, assume_unique=True))
                    if 100 * same >= percent * (len(x) + len(s) - same):
                        found.append((a, doc))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    partners = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("doc"))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("doc"))
    need = partners.unionByName(heads)
    dealt = need.join(common.among(texts, "doc_id", need.select("doc")), F.col("doc") == F.col("doc_id")).select("a", "part", "role", "doc", "text")
    return dealt.repartition("a", "part").sortWithinPartitions("a", "part", "role", "doc").mapInArrow(run, "a long, b long")


def _crowd_pairs(crowd: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members (rep, component, n) in different groups whose sets can be similar enough.

    Of the sets in one order, rarest shingle first, a linked pair's first common shingle stands at places x and y (from
    0) with at most min(n_a - x, n_b - y) common ones from there on; that must reach the least intersection of a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = list(shingle_sets(part.column("text"), size))
                ids = np.repeat(part.column("rep").to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(sets).view(np.int64), pa.int64())], names=["rep", "shingle"])

    reps = crowd.select("rep")
    every = reps.join(common.among(texts, "doc_id", reps), F.col("rep") == F.col("doc_id")).select("rep", "text").mapInArrow(run, "rep long, shingle long")
    several = every.groupBy("shingle").agg(F.count("*").alias("uses")).where("uses > 1")
    ordered = every.join(several, "shingle").groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("uses", "shingle"))).alias("of")).join(crowd, "rep")
    alone = F.col("n") - F.size("of")  # shingles of this member only come first
    room = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - alone
    posted = ordered.withColumn("room", room.cast("int")).where("room > 0").select("rep", "component", "n", alone.alias("alone"), F.posexplode(F.slice("of", F.lit(1), F.col("room"))).alias("nth", "x"))
    posted = posted.select(F.col("x.shingle").alias("shingle"), "rep", "component", "n", (F.col("n") - F.col("alone") - F.col("nth")).alias("left"))
    posted = common.saved(posted.where((100 + percent) * F.col("left") >= percent * (F.col("n") + F.ceil(percent * F.col("n") / 100))), "crowd")  # no partner can be smaller
    heads = posted.groupBy("shingle").agg(F.max_by("component", F.struct("left", "rep")).alias("head"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low < high").select("shingle", "head", "blocks", "members")
    lists = common.join_spread(posted, heads, "shingle", "members").where("head IS NOT NULL")
    # a long list is dealt into blocks, each of which meets the whole list
    one = lists.where("component <> head").select("shingle", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.col("rep").alias("p"), F.col("component").alias("cp"), F.col("n").alias("np"), F.col("left").alias("lp"))
    two = lists.select("shingle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("rep").alias("q"), F.col("component").alias("cq"), F.col("n").alias("nq"), F.col("left").alias("lq"), (F.col("component") == F.col("head")).alias("of_head"))
    possible = (100 + percent) * F.least("lp", "lq") >= percent * (F.col("np") + F.col("nq"))
    return one.join(two, ["shingle", "block"]).where(F.expr("cp <> cq AND (of_head OR p < q)") & possible).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of the links (a, b) reaches. links should be a saved table.

    Each round gives every node the least label among its neighbours' and then the label of that label; rounds end when
    nothing changes, after about the logarithm of the longest chain.
    """
    edges = links.select(F.col("a").alias("s"), F.col("b").alias("t"))
    edges = common.saved(edges.unionByName(edges.select(F.col("t").alias("s"), F.col("s").alias("t"))), "edges")
    labels = edges.groupBy("s").agg(F.min("t").alias("t")).select(F.col("s").alias("node"), F.least("s", "t").alias("component"))
    labels = common.saved(labels, "labels")
    while True:
        heard = edges.join(labels, edges.t == labels.node).groupBy("s").agg(F.min("component").alias("heard"))
        least = labels.join(heard, labels.node == heard.s, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("heard", "component")).alias("next"))
        # a node that hears of a smaller label passes it to the one it had before
        told = least.where("next < old").groupBy(F.col("old").alias("node")).agg(F.min("next").alias("told"))
        least = least.join(told, "node", "left").select("node", "old", F.least("next", F.coalesce("told", "next")).alias("next"))
        jump = least.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = common.saved(least.join(jump, "next", "left").select("node", "old", F.coalesce("far", "next").alias("component")), "labels")
        changed = after.where("component < old").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; further columns of docs are ignored."""
    sets = common.saved(sets_table(docs, size), "sets")
    full = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by("signature", "doc_id").alias("signature"), F.count("*").alias("copies"))
    classes = common.saved(classes, "classes")
    posted = common.saved(_postings(classes, matches(percent)), "postings")
    leaders = posted.groupBy("key").agg(F.max_by("rep", F.struct("central", -F.col("rep"))).alias("a"))
    star = posted.join(leaders, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    star = common.saved(_agreeing(star, classes, percent), "star")
    links = common.saved(_confirmed(star, texts, size, percent), "links")
    groups = components(links)
    # what lies in one list but not in one group
    at = posted.join(groups, posted.rep == groups.node, "left").select("key", "rep", "central", F.coalesce("component", "rep").alias("component"))
    heads = at.groupBy("key").agg(F.max_by("component", F.struct("central", -F.col("rep"))).alias("head"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
    mixed = at.join(heads.where("low < high").select("key", "head", "members"), "key").drop("central")
    mixed = common.saved(mixed.join(classes.select("rep", "n"), "rep"), "mixed")
    crowd = common.saved(mixed.where(F.col("members") > LONG).select("rep", "component", "n").distinct(), "crowd-members")
    few = mixed.where(F.col("members") <= LONG)
    one = few.where("component <> head").select("key", F.col("rep").alias("p"), F.col("component").alias("cp"), F.col("n").alias("np"))
    two = few.select("key", F.col("rep").alias("q"), F.col("component").alias("cq"), F.col("n").alias("nq"), (F.col("component") == F.col("head")).alias("of_head"))
    possible = 100 * F.least("np", "nq") >= percent * F.greatest("np", "nq")
    near = one.join(two, "key").where(F.expr("cp <> cq AND (of_head OR p < q)") & possible).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    rest = near.unionByName(_crowd_pairs(crowd, texts, size, percent)).distinct()
    rest = common.saved(_agreeing(rest, classes, percent), "rest").join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = common.saved(_confirmed(rest, texts, size, percent), "more")
    if more.limit(1).count():
        groups = components(common.saved(links.unionByName(more), "all-links"))
    reps = classes.join(groups, classes.rep == groups.node, "left").select(F.struct("n", "h1", "h2").alias("set"), F.coalesce("component", "rep").alias("component"), "copies")
    out = sets.select("doc_id", F.struct("n", "h1", "h2").alias("set"))
    linked = F.expr("set.n > 0 AND doc_id IS NOT NULL")
    found = common.join_spread(out.where(linked), common.saved(reps, "set-groups"), "set", "copies").select("doc_id", "set", "component")
    found = found.unionByName(out.where(~linked).withColumn("component", F.col("doc_id")))
    return found.select("doc_id", F.col("set.n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def _postings(classes: DataFrame, least: int) -> DataFrame:
    """key (coordinate and value in one number), rep, central (how common all of its values are): the rarest COORDINATES - least + 1 of each class, unless of it alone."""
    key = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    every = classes.select("rep", F.posexplode("signature").alias("pos", "value")).select("rep", key.alias("key"))
    common_keys = every.groupBy("key").agg(F.count("*").alias("uses")).where("uses > 1")
    # keys of one class alone come first in its order: what stays of its prefix is so many fewer of the shared ones
    shared = every.join(common_keys, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("uses", "key"))).alias("of"))
    room = F.size("of") - F.lit(least - 1)
    central = F.aggregate("of", F.lit(0).cast("long"), lambda total, x: total + x["uses"])
    return shared.where(room > 0).select("rep", central.alias("central"), F.explode(F.slice("of", F.lit(1), room)).alias("x")).select("x.key", "rep", "central")
