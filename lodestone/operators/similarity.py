"""Word similarity by trigrams: how well the trigrams of a query are met by the best continuous extent of a text.

Words are runs of letters and digits in lower case, with two blanks before and one behind, and the trigrams of a text are
those of its words in order. The similarity of an extent, a run of them, is the number of different trigrams that it shares
with the query over the number that either has, in single precision. The best extent is sought as the well-known database
extension does: at each shared trigram an extent ends; it begins where the last one began or further on, at the first place
that makes it most similar; and later ones do not begin before that place.

Queries go to the texts in large blocks, as an inverted index: each trigram with the queries that have it. No text moves,
and no pair is scored that shares too few trigrams to reach the threshold.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import in_blocks

BLANK = 32
#: Place of the next of its kind, where a trigram is the last one.
AFTER = np.iinfo(np.int64).max
#: What single precision may add to a similarity.
SLACK = 1e-6
#: Texts of at most so many runs are scored together, so many at once.
RUNS, TOGETHER = 128, 64


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all texts in order, each as one number made of three code points, and where each text's begin (one place more for the end)."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(" ".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, kind = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalnum() for c in kinds], bool)[kind]
    opens = letter & ~np.concatenate((np.zeros(1, bool), letter))[:-1]
    at, word = np.flatnonzero(letter), (np.cumsum(opens) - 1)[letter]
    sizes = np.bincount(word, minlength=int(opens.sum()))
    padded = np.full(len(at) + 3 * len(sizes), BLANK, np.int64)
    padded[np.arange(len(at)) + 3 * word + 2] = points[at]
    starts = np.ones(len(padded), bool)
    ends = np.cumsum(sizes + 3)
    starts[ends - 1] = starts[ends - 2] = False
    i = np.flatnonzero(starts)
    codes = padded[i] << 42 | padded[np.minimum(i + 1, len(padded) - 1)] << 21 | padded[np.minimum(i + 2, len(padded) - 1)]
    text_of = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), np.flatnonzero(opens), "right")
    per_text = np.bincount(text_of, weights=sizes + 1, minlength=len(texts)).astype(np.int64)
    return codes, np.concatenate((np.zeros(1, np.int64), np.cumsum(per_text)))


def neighbours(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each trigram: whether it is its text's first of its kind, and the places in the text of the next (after all others, if there is none) and the last of its kind (-1, if there is none)."""
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((codes, text_of))
    same = (codes[order[1:]] == codes[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
    following, previous = np.full(len(codes), AFTER), np.full(len(codes), -1)
    one, two = order[:-1][same], order[1:][same]
    begin = at[text_of[two]]
    following[one], previous[two] = two - begin, one - begin
    return previous < 0, following, previous


def best_extent(hit: np.ndarray, following: np.ndarray, n: int, group: int = 128) -> float:
    """The similarity of the best extent. hit: which of a text's trigrams the query has; following: of `neighbours`; n: number of different trigrams of the query.

    Within a run of hits every further one makes each extent more similar, and none more so than one that begins later; so
    extents need only be seen that end with a run and begin with one. Ends are looked at in groups, against the places that
    an extent may hold: of those before the group only the last of each trigram counts, so the work does not grow with the
    square of a long text that repeats itself.
    """
    edge = np.diff(np.concatenate((np.zeros(1, np.int8), hit, np.zeros(1, np.int8))))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    places, upto, run, best = np.zeros(0, np.int64), -1, 0, np.float32(0)
    top = np.float32(np.count_nonzero(hit & (following == AFTER)) / max(1, n))  # no extent has more than all that is shared and nothing else
    for g in range(0, len(ends), group):
        end = ends[g : g + group]
        places = np.concatenate((places, np.arange(max(starts[run], upto + 1), end[-1] + 1)))
        at, own = np.searchsorted(places, starts[run : g + group]), hit[places]
        last = (following[places] > end[:, None]) & (places <= end[:, None])  # it stands for its kind in the extents that end there
        shared, other = (np.concatenate((np.zeros((len(end), 1), np.int32), np.cumsum(last & kind, axis=1, dtype=np.int32)), axis=1) for kind in (own, ~own))
        shared, other = (x[:, -1:] - x[:, at] for x in (shared, other))
        found = (shared / (n + other)).astype(np.float32)
        begin = 0
        for row, k in enumerate(found.argmax(axis=1).tolist()):
            begin = k if k >= begin else begin + int(found[row, begin:].argmax())
            best = max(best, found[row, begin])
        if best >= top:
            break
        run, upto = run + begin, end[-1]
        places = places[(places >= starts[run]) & (following[places] > upto)]
    return float(best)


def run_of(hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many runs of hits have begun in its text up to each place, and how many each text has."""
    begins = hit.copy()
    begins[1:] &= ~hit[:-1]
    opening = at[:-1][np.diff(at) > 0]
    begins[opening] = hit[opening]
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(begins)))
    return upto[1:] - np.repeat(upto[at[:-1]], np.diff(at)), upto[at[1:]] - upto[at[:-1]]


def summed(x: np.ndarray) -> np.ndarray:
    """x with the sums up to each place over its first two axes, in place."""
    for k in range(1, len(x)):
        x[k] += x[k - 1]
    for k in range(1, x.shape[1]):
        x[:, k] += x[:, k - 1]
    return x


def run_behind(upto: np.ndarray, previous: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first run that begins behind the last of each trigram's kind."""
    return np.where(previous >= 0, upto[np.repeat(at[:-1], np.diff(at)) + np.maximum(previous, 0)], 0)


def some_extent(hit: np.ndarray, last: np.ndarray, previous: np.ndarray, at: np.ndarray, n: int, least: float) -> np.ndarray:
    """Whether any extent of each text comes to least, be it one that the search passes by. Each text shares least for each trigram of the query at least; last: which trigrams are the last of their kind.

    Such an extent shares least for each trigram of the query and each other one of its own. So it does not end before a
    text has shared so many from its beginning on, nor begin where it shares fewer up to its end; only those between are counted.
    """
    own, c = np.repeat(np.arange(len(at) - 1), np.diff(at)), max(1, math.ceil(least * n))
    upto, runs = run_of(hit, at)
    ending = upto - hit
    opens, closes = np.flatnonzero(hit & (previous < 0)), np.flatnonzero(hit & last)
    ends = ending[opens[np.searchsorted(opens, at[:-1]) + c - 1]]  # the first run to end with
    width, height = int(ending[closes[np.searchsorted(closes, at[1:]) - c]].max()) + 1, int((runs - ends).max())
    row = np.maximum(ending - ends[own], 0)
    behind, stop = run_behind(upto, previous, at), upto  # it counts for begins from behind on and before stop
    gain = np.where(hit, 1.0, -least)
    plus, minus = ((row < height) & (x < width) & (behind < stop) for x in (behind, stop))
    texts, cell = len(at) - 1, row * width
    cells = np.concatenate((((cell + behind) * texts + own)[plus], ((cell + stop) * texts + own)[minus]))  # end, begin, text
    total = np.bincount(cells, weights=np.concatenate((gain[plus], -gain[minus])), minlength=height * width * texts)
    return summed(total.reshape(height, width, texts)).max(axis=(0, 1)) >= least * n - SLACK


def best_extents(hit: np.ndarray, previous: np.ndarray, at: np.ndarray, n: int, least: float = 0.0) -> np.ndarray:
    """As best_extent, of some texts with few runs each, one after another (at: where each begins); 0 where no extent comes to least.

    A place adds to the extents that hold it and begin behind the last of its kind. Counted by its own run (of other
    trigrams: the run that follows) and the first run behind the last of its kind, the places thus give the counts of all
    extents as sums over both.
    """
    texts, own = len(at) - 1, np.repeat(np.arange(len(at) - 1), np.diff(at))
    upto, runs = run_of(hit, at)
    r = max(1, int(runs.max(initial=0)))
    behind, ending = run_behind(upto, previous, at), upto - hit
    inside = (behind < r) & (ending < r)
    cell = (ending * r + behind) * texts + own  # end, begin, text
    shared, other = (summed(np.bincount(cell[inside & kind], minlength=r * r * texts).reshape(r, r, texts)) for kind in (hit, ~hit))
    shared[:, 1:] -= np.diagonal(shared, 1).T.copy()
    other -= np.diagonal(other).T.copy()
    found = shared.astype(np.float32) / (n + np.maximum(other, 0)).astype(np.float32)  # 0 at most where an extent begins behind its end
    out = np.zeros(texts, np.float32)
    able = np.flatnonzero(found.max(axis=(0, 1)) >= max(least, np.finfo(np.float32).tiny))
    found, runs = found[:, :, able], runs[able]
    begin, best, nth = np.zeros(len(able), np.int64), np.zeros(len(able), np.float32), np.arange(len(able))
    for end in range(int(runs.max(initial=0))):
        scores = np.where(np.arange(end + 1)[:, None] >= begin, found[end, : end + 1], -1)
        k = scores.argmax(axis=0)
        begin = np.where(end < runs, k, begin)
        best = np.where(end < runs, np.maximum(best, scores[k, nth]), best)
    out[able] = best
    return out


def word_similarity(query: str, text: str) -> float:
    """The similarity of one query and one text; 0 if either has no word."""
    wanted = np.unique(trigrams([query])[0])
    codes, at = trigrams([text])
    return best_extent(np.isin(codes, wanted), neighbours(codes, at)[1], len(wanted))


class _Index:
    """Trigrams of a block of queries, and the queries that have each.

    A query is met by a text only if they share `need` trigrams. Half of these may be the query's most common ones, which
    are not posted: of the others the rest of them must be shared.
    """

    def __init__(self, queries: list[str], threshold: float) -> None:
        codes, at = trigrams(queries)
        self.codes, where = np.unique(codes, return_inverse=True)
        self.own = [np.unique(where[a:b]) for a, b in zip(at, at[1:], strict=False)]
        self.threshold = threshold
        self.need = np.array([max(1, next(c for c in range(math.floor(threshold * len(x)), len(x) + 2) if c > len(x) or np.float32(c / max(1, len(x))) >= threshold)) for x in self.own], np.int64)
        self.mark = np.zeros(len(self.codes) + 1, bool)

    def post(self, ids: np.ndarray) -> None:
        """Posts the queries; ids: of trigrams of some texts, whose counts tell which are common. Whatever they are, no match is lost."""
        often = np.bincount(ids[ids >= 0], minlength=len(self.codes))
        kept = [x[np.argsort(often[x], kind="stable")][: len(x) - need // 2] for x, need in zip(self.own, self.need, strict=True)]
        trigram = np.concatenate([np.zeros(0, np.int64), *kept])
        order = np.argsort(trigram, kind="stable")
        self.queries = np.repeat(np.arange(len(kept)), [len(x) for x in kept])[order]
        self.places = np.concatenate(([0], np.cumsum(np.bincount(trigram, minlength=len(self.codes)))))

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """Number of each trigram, -1 if no query has it."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1)

    def candidates(self, ids: np.ndarray, text_of: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts and queries of the pairs that share enough posted trigrams. ids: different ones of each of n texts, none -1."""
        q = len(self.own)
        step = max(1, (1 << 22) // max(1, q))
        for first in range(0, n, step):
            a, b = np.searchsorted(text_of, (first, first + step))
            sizes = self.places[ids[a:b] + 1] - self.places[ids[a:b]]
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.places[ids[a:b]], sizes)
            key = np.repeat(text_of[a:b] - first, sizes) * q + self.queries[at]
            rows = min(step, n - first)
            found = np.bincount(key, minlength=rows * q).reshape(rows, q)
            k, i = np.nonzero(found >= self.need - self.need // 2)
            yield first + k, i


class _Field:
    """One column of a batch of rows against an index."""

    def __init__(self, texts: list[str], index: _Index) -> None:
        codes, self.at = trigrams(texts)
        self.index, self.ids = index, index.ids(codes)
        self.first, self.following, self.previous = neighbours(codes, self.at)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and queries of the pairs that may reach the index's threshold, and some others."""
        once = np.flatnonzero(self.first & (self.ids >= 0))
        text_of = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))[once]
        return self.index.candidates(self.ids[once], text_of, len(self.at) - 1)

    def may_reach(self, row: int, q: int, hit: np.ndarray, t: float) -> bool:
        """False only if the similarity is below t: an extent that reaches it shares t for each trigram of the query and each other trigram of its own, of which those that no place before holds are its own for certain."""
        t, n, first = t - SLACK, len(self.index.own[q]), self.first[self.at[row] : self.at[row + 1]]
        if np.count_nonzero(hit & first) < t * n:
            return False
        gain = np.cumsum(np.where(hit, 1.0, np.where(first, -t, 0.0)))
        return bool(len(gain)) and bool((gain - np.minimum(np.minimum.accumulate(np.concatenate(([0.0], gain[:-1]))), gain)).max() >= t * n - SLACK)

    def scores(self, rows: np.ndarray, q: int, least: float, only_whether: bool = False) -> np.ndarray:
        """The similarity of each row and one query; 0 if it is surely below least. only_whether: 1 in place of those that may come to it."""
        n, mark, least, out = len(self.index.own[q]), self.index.mark, least - SLACK, np.zeros(len(rows))

        def places(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sizes = self.at[of + 1] - self.at[of]
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
            return np.repeat(self.at[of] - ends[:-1], sizes) + np.arange(ends[-1]), ends

        where, ends = places(rows)
        mark[self.index.own[q]] = True
        hit = mark[self.ids[where]]
        own = np.repeat(np.arange(len(rows)), np.diff(ends))
        shared, (_, runs) = np.bincount(own[hit & self.first[where]], minlength=len(rows)), run_of(hit, ends)
        able = np.flatnonzero(shared >= max(1, least * n))
        for k in able[runs[able] > RUNS]:
            row, one = int(rows[k]), hit[ends[k] : ends[k + 1]]
            if self.may_reach(row, q, one, least):
                out[k] = 1 if only_whether else best_extent(one, self.following[self.at[row] : self.at[row + 1]], n)
        able = able[runs[able] <= RUNS]
        able = able[np.argsort(shared[able], kind="stable")]  # those that are alike together
        for k in range(0, len(able), TOGETHER):
            some = able[k : k + TOGETHER]
            where, ends = places(rows[some])
            fine = some_extent(mark[self.ids[where]], self.following[where] == AFTER, self.previous[where], ends, n, least)
            out[some[fine]] = 1
            if fine.any() and not only_whether:
                where, ends = places(rows[some[fine]])
                out[some[fine]] = best_extents(mark[self.ids[where]], self.previous[where], ends, n, least)
        mark[self.index.own[q]] = False
        return out


def _scores(fields: list[tuple[_Field, float]], rows: np.ndarray, q: int, threshold: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of which a column reaches the threshold, and the greatest similarity times boost of their columns; none that are below least."""
    able = [f.scores(rows, q, least / boost if least > 0 else threshold, only_whether=True) > 0 for f, boost in fields]
    rows = rows[np.logical_or.reduce(able)]
    if not len(rows):
        return rows, np.zeros(0)
    found = np.stack([f.scores(rows, q, min(threshold, least / boost)) for f, boost in fields])
    top = (found * np.array([boost for _, boost in fields])[:, None]).max(axis=0)
    kept = (found.max(axis=0) >= threshold) & (top >= least)
    return rows[kept], top[kept]


def _local(asked: pa.Table, boosts: dict[str, float], threshold: float, k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, own = _Index(asked["query"].to_pylist(), threshold), asked["q"].to_pylist()
        best: list[list[tuple[float, int]]] = [[] for _ in own]  # heaps of score and -id
        posted = False
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                fields = [(_Field(part.column(c).to_pylist(), index), boost) for c, boost in boosts.items()]
                if not posted:
                    index.post(np.concatenate([f.ids for f, _ in fields]))
                    posted = True
                ids = part.column("id").to_pylist()
                pairs = [q * part.num_rows + row for f, _ in fields for row, q in f.candidates()]
                asker, row = np.divmod(np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64), part.num_rows)
                for at in np.split(np.arange(len(row)), np.flatnonzero(np.diff(asker)) + 1) if len(row) else ():
                    q = int(asker[at[0]])
                    while len(at):
                        full = len(best[q]) >= k
                        some, at = (at, at[:0]) if full else (at[:TOGETHER], at[TOGETHER:])
                        for r, score in zip(*(x.tolist() for x in _scores(fields, row[some], q, threshold, best[q][0][0] if full else 0.0)), strict=True):
                            (heapq.heappushpop if len(best[q]) >= k else heapq.heappush)(best[q], (score, -ids[r]))
        found = [(own[q], -minus, score) for q, heap in enumerate(best) for score, minus in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], kind) for n, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    return run


def similar_words(docs: DataFrame, queries: DataFrame, k: int, *, threshold: float = 0.3, title_boost: float = 1.5, id_boost: float = 2.0, block: int = 16_384) -> DataFrame:
    """query_id, id, score and rank of the k documents that are most similar to each query, by words.

    docs: id, text, title, external_id; queries: query_id, query. A document counts if its text, title or external id has a
    word similarity of `threshold` or more to the query; its score is the greatest of the three, the title's times
    title_boost and the id's times id_boost, and ties go to the smaller id. Each task keeps its own k best of a query.
    Documents and queries without an id take no part, nor do queries without a word; a null column is an empty one. Rows that
    repeat an id are ranked each for itself. Queries go to the documents in blocks of about `block`.
    """
    low = docs.select(F.col("id").cast("long").alias("id"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "title", "external_id")]).where("id IS NOT NULL")
    asked = queries.select(F.col("query_id").cast("long").alias("q"), "query").where("q IS NOT NULL AND query IS NOT NULL")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if low.rdd.getNumPartitions() < cores:  # rows of a few files
        low = low.repartition(cores)
    boosts, best = {"text": 1.0, "title": title_boost, "external_id": id_boost}, None
    for part in in_blocks(asked, "q", block):
        found = low.mapInArrow(_local(part.toArrow(), boosts, threshold, k), "query_id long, id long, score double")
        best = found if best is None else best.unionByName(found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")
    return best.withColumn("rank", place).where(F.col("rank") <= k)
