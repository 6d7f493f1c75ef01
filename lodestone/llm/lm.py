"""Masked pseudo-likelihood of texts by a bidirectional window network.

Each token is predicted from the `REACH` tokens on both of its sides, itself hidden: the context's embeddings, one table
for each place, are summed and squashed, a softmax gives the token's class, and a tree of yes-or-no decisions over the
class's tokens gives the token; all of these see the context, and the probabilities of all tokens sum to one. A
document's score is the sum of its tokens' conditional log-probabilities.

Counts are of all words of all documents. Words that occur at least `least` times are tokens of their own, `vocabulary` of
them at most, as each has rows in the network; all others fall into `OTHER` tokens by hash. Within one of these a word has
its share of the token's count; counts of rare words are held by hash in `BUCKETS` places, where words of one place share
their mean. Classes cut the tokens, most common first, into parts of about equal mass, and so do the trees.

Training goes over all documents in numpy on the executors. Every `every`-th token of a text, from a place that the text's
hash gives, is a target, and all tokens are context. Documents are dealt by hash into shards of about `shard_tokens`, sorted, so the model does not depend on how the input lies. A quarter of the
documents trains copies of the first weights, one for each shard; these are averaged by their number of targets, and the
other documents train copies of the mean, averaged again. Weights are averaged in blocks and in two steps, so that no
task or driver meets all copies. Scoring takes every token.

Null and empty texts have 0 tokens, log-likelihood 0 and no mean. Without any words there is nothing to train, and all
texts are of that kind. Null ids are scored as all others, rows that repeat an id each by their own text; very long texts
are worked on in runs. An empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common, words

REACH, WIDTH, CLASSES, OTHER, BLOCK, BUCKETS = 2, 8, 64, 256, 1 << 16, 1 << 22
_BATCH = 4096


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: over all documents. Tasks send on what they have counted in some megabytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for _, _, data, offsets in common.slices(b.column("text"), 1 << 20):
                held.append(words.hash_words(data, offsets)[0])
                if sum(map(len, held)) > 4_000_000:
                    yield counted(held)
                    held = []
        yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Token numbers of words, each token's class and its path in the class's tree, and the share of a rare word in its token."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rare: np.ndarray, other_counts: np.ndarray) -> None:
        """hashes, counts: the words that are tokens; rare: mean count of the other words of each of BUCKETS places; other_counts: of the OTHER tokens."""
        order = np.argsort(hashes)
        self.hashes, self.token = hashes[order], order
        self.rare, self.other_counts = rare, np.maximum(1.0, other_counts)
        n = np.concatenate([counts, other_counts]).astype(float) + 1
        self.size = len(n)
        rank = np.argsort(-n, kind="stable")
        mass = np.cumsum(n[rank]) / n.sum()
        self.of = np.zeros(self.size, np.int64)
        self.of[rank] = np.unique(np.ceil(mass * CLASSES).astype(int), return_inverse=True)[1]  # no class is empty
        self.n_classes = int(self.of.max()) + 1
        paths: list[list[int]] = [[] for _ in range(self.size)]  # node, doubled, and one more for the second half
        self.n_nodes = 0
        todo = [rank[self.of[rank] == c] for c in range(self.n_classes)]
        while todo:
            part = todo.pop()
            if len(part) < 2:
                continue
            sums = np.cumsum(n[part])
            cut = min(max(1, int(np.searchsorted(sums, sums[-1] / 2)) + 1), len(part) - 1)
            for side, half in enumerate((part[:cut], part[cut:])):
                for t in half:
                    paths[t].append(2 * self.n_nodes + side)
                todo.append(half)
            self.n_nodes += 1
        self.depths = np.array([len(p) for p in paths])
        self.begins = np.cumsum(self.depths) - self.depths
        flat = np.array([x for p in paths for x in p], np.int64)
        self.nodes, self.signs = flat >> 1, np.where(flat & 1, -1, 1).astype(np.float32)

    def tokens(self, found: np.ndarray) -> np.ndarray:
        out = len(self.hashes) + (found % np.uint64(OTHER)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            hit = self.hashes[at] == found
            out[hit] = self.token[at[hit]]
        return out

    def within(self, found: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Logarithm of each word's share in its token."""
        out = np.zeros(len(found))
        at = np.flatnonzero(tokens >= len(self.hashes))
        mean = np.maximum(self.rare[(found[at] % np.uint64(BUCKETS)).astype(np.int64)], 1e-3)
        out[at] = np.log(np.minimum(1.0, mean / self.other_counts[tokens[at] - len(self.hashes)]))
        return out

    def steps(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whose step it is, the node and the sign of all steps of these tokens' paths."""
        n = self.depths[tokens]
        who = np.repeat(np.arange(len(tokens)), n)
        at = np.arange(len(who)) + np.repeat(self.begins[tokens] - np.cumsum(n) + n, n)
        return who, self.nodes[at], self.signs[at]


class Network:
    """embed: (2 * REACH, tokens + 1, WIDTH), the last row for places outside the text; out: (WIDTH + 1, classes); nodes: (nodes, WIDTH + 1)."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None) -> None:
        self.vocabulary = vocabulary
        shapes = (2 * REACH, vocabulary.size + 1, WIDTH), (WIDTH + 1, vocabulary.n_classes), (vocabulary.n_nodes, WIDTH + 1)
        if flat is None:
            rng = np.random.default_rng(9)
            self.embed = rng.normal(0, 0.1, shapes[0]).astype(np.float32)
            self.out, self.nodes = np.zeros(shapes[1], np.float32), np.zeros(shapes[2], np.float32)
        else:
            cuts = np.cumsum([int(np.prod(x)) for x in shapes[:2]])
            self.embed, self.out, self.nodes = (x.reshape(shape).copy() for x, shape in zip(np.split(flat, cuts), shapes, strict=True))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embed.ravel(), self.out.ravel(), self.nodes.ravel()])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.embed[0][context[0]]
        for j in range(1, 2 * REACH):
            h += self.embed[j][context[j]]
        return np.tanh(h)

    def log_probabilities(self, context: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        h = self.hidden(context)
        z = h @ self.out[:-1] + self.out[-1]
        top = z.max(axis=1)
        of_class = z[np.arange(len(z)), self.vocabulary.of[tokens]] - top - np.log(np.exp(z - top[:, None]).sum(axis=1))
        who, nodes, signs = self.vocabulary.steps(tokens)
        w = self.nodes[nodes]
        s = signs * (np.einsum("ij,ij->i", h[who], w[:, :-1]) + w[:, -1])
        return of_class - np.bincount(who, np.logaddexp(0, -s), minlength=len(tokens))

    def train(self, context: np.ndarray, tokens: np.ndarray, squares: list[np.ndarray], rate: float = 0.1) -> None:
        """One AdaGrad step on the negative log-probability."""
        h = self.hidden(context)
        z = h @ self.out[:-1] + self.out[-1]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z, out=z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), self.vocabulary.of[tokens]] -= 1
        back = p @ self.out[:-1].T
        who, nodes, signs = self.vocabulary.steps(tokens)
        if len(who):
            own, w = h[who], self.nodes[nodes]
            s = signs * (np.einsum("ij,ij->i", own, w[:, :-1]) + w[:, -1])
            g = (-signs / (1 + np.exp(s)))[:, None]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            back[who[first]] += np.add.reduceat(g * w[:, :-1], first, axis=0)
            _descend(self.nodes, squares[2], nodes, np.concatenate([g * own, g], axis=1), rate)
        g = np.concatenate([h.T @ p, p.sum(axis=0, keepdims=True)])
        squares[1] += g * g
        self.out -= rate * g / np.sqrt(squares[1])
        back *= 1 - h * h
        for j in range(2 * REACH):
            _descend(self.embed[j], squares[0][j], context[j], back, rate)


def _descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    """An AdaGrad step of these rows; a row that occurs several times takes the sum of its parts."""
    order = np.argsort(rows.astype(np.uint16) if len(weights) <= 1 << 16 else rows, kind="stable")  # short numbers are sorted by their digits
    rows = rows[order]
    at = np.flatnonzero(np.diff(rows, prepend=-1))
    rows, total = rows[at], np.add.reduceat(g[order], at, axis=0)
    seen = squares[rows] + total * total
    squares[rows] = seen
    weights[rows] -= rate * total / np.sqrt(seen)


def contexts(tokens: np.ndarray, bounds: np.ndarray, at: np.ndarray, outside: int) -> np.ndarray:
    """(2 * REACH, len(at)): the tokens around each place, `outside` where the text ends."""
    owner = np.searchsorted(bounds, at, "right") - 1
    begin, end = bounds[owner], bounds[owner + 1]
    out = np.empty((2 * REACH, len(at)), np.int64)
    for j, d in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        place = at + d
        out[j] = np.where((place >= begin) & (place < end), tokens[np.clip(place, 0, len(tokens) - 1)], outside)
    return out


def vocabulary_of(docs: DataFrame, size: int, least: int = 3) -> tuple[Vocabulary, int]:
    """The vocabulary, and how many words there are in all."""
    counts = common.saved(word_counts(docs), "word-counts")
    top = common.saved(counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size), "vocabulary")
    rows = top.toArrow()  # `size` rows
    others = counts.join(F.broadcast(top.select("word")), "word", "left_anti").select(F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket"), "n")
    by_bucket = others.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("words"))

    def joined(part: pa.Table) -> pa.Table:
        at = part["bucket"].to_numpy() % 4096
        out = np.zeros((2, 4096), np.float32)
        out[0, at], out[1, at] = part["n"].to_numpy() / part["words"].to_numpy(), part["n"].to_numpy()
        sums = out[1].astype(float).reshape(-1, OTHER).sum(axis=0)
        return pa.table({"part": [int(part["bucket"][0].as_py()) // 4096], "mean": [out[0].tobytes()], "sums": [sums.tobytes()]})

    rare, other_counts = np.zeros(BUCKETS, np.float32), np.zeros(OTHER)
    for part, mean, sums in sorted(by_bucket.groupBy(F.expr("bucket div 4096")).applyInArrow(joined, "part long, mean binary, sums binary").collect()):  # 4 * BUCKETS bytes
        rare[part * 4096 : (part + 1) * 4096] = np.frombuffer(bytes(mean), np.float32)
        other_counts += np.frombuffer(bytes(sums))
    total = counts.agg(F.sum("n")).first()[0] or 0
    common.drop(counts, top)
    return Vocabulary(rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(float), rare, other_counts), total


def train(docs: DataFrame, vocabulary: Vocabulary, n_words: int, *, every: int = 1, shard_tokens: int = 4_000_000) -> Network:
    """A network that has met every `every`-th word of every document as a target once."""
    spark = docs.sparkSession
    place = F.xxhash64(F.col("doc_id").cast("long"), "text")
    rows = docs.where("text IS NOT NULL").select("text", place.alias("place"), (F.pmod(F.shiftright(place, 32), F.lit(4)) == 0).alias("first"))
    weights = Network(vocabulary).flat()
    for first, share in ((True, 0.25), (False, 0.75)):
        shards = max(1, -(-int(n_words * share) // shard_tokens))
        start = spark.sparkContext.broadcast((vocabulary, weights))

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            net = held = None
            now = used = n = 0
            for b in batches:
                shard = b.column("shard").to_numpy()
                bounds = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
                for at, end in zip(bounds[:-1], bounds[1:], strict=True):
                    if at == end:
                        continue
                    if net is None or shard[at] != now:
                        if net is not None:
                            yield from _blocks(net, now, used + steps(net, squares, held, 1))
                        net, now, held, n, used = Network(*start.value), int(shard[at]), [], 0, 0
                        squares = [np.ones_like(x) for x in (net.embed, net.out, net.nodes)]
                    place = b.column("place").to_numpy()[at:end]
                    for low, high, data, offsets in common.slices(b.column("text").slice(at, end - at), 1 << 18):
                        found, ends = words.hash_words(data, offsets)
                        nth = np.arange(len(found)) + np.repeat((place[low:high] >> 20) % every - ends[:-1], np.diff(ends))
                        target = np.flatnonzero(nth % every == 0)
                        if len(target):
                            tokens = net.vocabulary.tokens(found)
                            held.append((contexts(tokens, ends, target, net.vocabulary.size), tokens[target]))
                            n += len(target)
                        if n >= 32 * _BATCH:
                            used += steps(net, squares, held, 32 * _BATCH)
                            n = sum(len(y) for _, y in held)
            if net is not None:
                yield from _blocks(net, now, used + steps(net, squares, held, 1))

        part = rows.where("first" if first else "NOT first").select("text", "place", F.pmod("place", F.lit(shards)).alias("shard"))
        trained = part.repartition(shards, "shard").sortWithinPartitions("shard", "place", "text").mapInArrow(run, "block int, part int, shard long, n double, weights binary").where("n > 0")
        for key in (["block", "part"], ["block"]):
            trained = trained.groupBy(*key).applyInArrow(_mean, "block int, part int, shard long, n double, weights binary")
        parts = sorted(trained.select("block", "weights").collect())  # the network, whose size is bounded
        if parts:
            weights = np.concatenate([np.frombuffer(bytes(r[1]), np.float32) for r in parts])
    return Network(vocabulary, weights)


def _blocks(net: Network, shard: int, used: int) -> Iterator[pa.RecordBatch]:
    flat = net.flat()
    for k in range(0, len(flat), BLOCK):
        yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([shard % 64], pa.int32()), pa.array([shard], pa.int64()), pa.array([float(used)]), pa.array([flat[k : k + BLOCK].tobytes()], pa.binary())], names=["block", "part", "shard", "n", "weights"])


def steps(net: Network, squares: list[np.ndarray], held: list[tuple[np.ndarray, np.ndarray]], least: int) -> int:
    """Trains on runs of 32 * _BATCH targets, however they were handed in; fewer than `least` stay in held."""
    if not held:
        return 0
    context, tokens = np.concatenate([x for x, _ in held], axis=1), np.concatenate([y for _, y in held])
    held.clear()
    done = 0
    while len(tokens) - done >= least:
        at = done + np.random.default_rng(9).permutation(min(32 * _BATCH, len(tokens) - done))
        for k in range(0, len(at), _BATCH):
            net.train(context[:, at[k : k + _BATCH]], tokens[at[k : k + _BATCH]], squares)
        done += len(at)
    if done < len(tokens):
        held.append((context[:, done:], tokens[done:]))
    return done


def _mean(table: pa.Table) -> pa.Table:
    table = table.sort_by("shard")
    n = table["n"].to_numpy()
    total = np.zeros(len(table["weights"][0].as_py()) // 4)
    for k, w in enumerate(table["weights"]):
        total += n[k] * np.frombuffer(w.as_py(), np.float32)
    first = table.slice(0, 1)
    return pa.table({"block": first["block"], "part": first["part"], "shard": first["shard"], "n": pa.array([float(n.sum())]), "weights": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def score(docs: DataFrame, vocabulary: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_likelihood of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, net.flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        net = Network(vocabulary, flat)
        for b in batches:
            n, total = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, offsets in common.slices(b.column("text")):
                found, bounds = words.hash_words(data, offsets)
                tokens = vocabulary.tokens(found)
                log_p = np.zeros(len(tokens) + 1)
                for k in range(0, len(tokens), 16384):
                    at = np.arange(k, min(len(tokens), k + 16384))
                    log_p[at + 1] = net.log_probabilities(contexts(tokens, bounds, at, vocabulary.size), tokens[at])
                log_p[1:] += vocabulary.within(found, tokens)
                sums = np.cumsum(log_p)
                n.append(np.diff(bounds))
                total.append(sums[bounds[1:]] - sums[bounds[:-1]])
            n, total = np.concatenate(n), np.concatenate(total)
            mean = pa.array(total / np.maximum(1, n), mask=n == 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.where(n > 0, total, 0.0)), mean], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def pseudo_likelihood(docs: DataFrame, *, vocabulary: int = 16384, every: int = 1, shard_tokens: int = 4_000_000) -> DataFrame:
    known, n_words = vocabulary_of(docs, vocabulary)
    return score(docs, known, train(docs, known, n_words, every=every, shard_tokens=shard_tokens))
