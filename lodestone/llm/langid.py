"""Language of each word by a linear-chain conditional random field, and of each text by its words.

Features of a word are its bytes in twos, threes and fours, its first two and three, its last two, three and four, and the
word itself if it is in the lexicon of the training sample; together with learned transitions between the languages of
neighbouring words they give, by forward-backward, the probability of each language for each word. The score of a
language for a text is the mean over all of its words, and the text's language is the one with the greatest score.

Every language that occurs is learned. Training takes at most `per_language` documents of each, fewer if all together
would be over `most_documents`, and `segments` pieces of RUN words of each: a bounded, documented sample of labelled
rows. Documents of fewer words make pieces together with others of their language. Training sequences join several
pieces, so that there are switches to learn the transitions from. The numbers of features times languages is bounded by
`WEIGHTS`. Texts are then labelled in whole, each as one chain: blocks of words are first multiplied into matrices, which
carry the messages across, and then run side by side.

A text that is null or has no letter gets `und` and score 0. Null languages, null ids and held-out rows are never learned
from. With one language known, or no word to learn from, all texts with letters get one language, with score 1; with
none, `und`. Of languages with equal scores the first by name is taken. Rows that repeat an id are labelled each by their
own text; an empty table gives an empty result; further columns, whatever their names, are ignored. Very long texts are
labelled in whole, in memory that grows with the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common, words

RUN, BLOCK, BITS, WEIGHTS, MANY = 8, 32, 17, 1 << 23, 16
_LETTERS = words.LETTERS.copy()
_LETTERS[48:58] = False


def word_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, begin and end of each word, and the bounds of each text's words."""
    b = words.LOWER[data]
    if not len(b):
        none = np.zeros(0, np.int64)
        return b, none, none, np.zeros(len(offsets), np.int64)
    word = _LETTERS[b]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(b))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return b, at, to, np.searchsorted(at, offsets)


def features(b: np.ndarray, at: np.ndarray, to: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, below 2 ** bits, and the bounds of each word's."""
    n = to - at
    padded = np.concatenate([b.astype(np.uint64), np.zeros(4, np.uint64)])
    grams = {1: padded[: len(b)]}
    for k in (2, 3, 4):
        grams[k] = grams[k - 1] << np.uint64(8) | padded[k - 1 : k - 1 + len(b)]
    found, owner = [], []

    def add(values: np.ndarray, kind: int, who: np.ndarray) -> None:
        found.append(words.mix(values + np.uint64(kind << 40)) >> np.uint64(64 - bits))
        owner.append(who)

    every = np.arange(len(at))
    for k in (2, 3, 4):
        many = np.maximum(n - k + 1, 0)
        who = np.repeat(every, many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + at[who]
        add(grams[k][place], k, who)
    for k, kind in ((2, 5), (3, 6)):
        who = every[n >= k]
        add(grams[k][at[who]], kind, who)
    for k, kind in ((2, 7), (3, 8), (4, 9)):
        who = every[n >= k]
        add(grams[k][to[who] - k], kind, who)
    who = every[n < 2]
    add(grams[1][at[who]], 10, who)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(at) + 1))


class LanguageModel:
    """weights: a row for each feature and for each word of the lexicon, a column for each language; transitions: their logarithms."""

    def __init__(self, languages: list[str], lexicon: np.ndarray, weights: np.ndarray, transitions: np.ndarray) -> None:
        self.languages, self.lexicon, self.weights, self.transitions = languages, lexicon, weights, transitions
        self.bits = max(0, (len(weights) - len(lexicon)).bit_length() - 1)

    def emissions(self, b: np.ndarray, at: np.ndarray, to: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A score of each language for each word; equal words are worked out once."""
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        numbers, bounds = features(b, at[first], to[first], self.bits)
        scores = np.add.reduceat(self.weights[numbers], bounds[:-1], axis=0) if len(numbers) else np.zeros((len(first), len(self.languages)))
        if len(self.lexicon):
            place = np.minimum(np.searchsorted(self.lexicon, hashes[first]), len(self.lexicon) - 1)
            scores = scores + np.where((self.lexicon[place] == hashes[first])[:, None], self.weights[(1 << self.bits) + place], 0)
        return scores[back]

    def posteriors(self, emissions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of each language for each word; text i has the words bounds[i] to bounds[i + 1]."""
        k = emissions.shape[1]
        if k > MANY:
            return self.word_by_word(emissions, bounds)
        local = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        step = np.exp(self.transitions - self.transitions.max())
        n = np.diff(bounds)
        blocks = -(-n // BLOCK)
        starts = np.concatenate([[0], np.cumsum(blocks)])
        owner = np.repeat(np.arange(len(n)), blocks)
        nth = np.arange(len(owner)) - starts[owner]
        begin = bounds[owner] + nth * BLOCK
        size = np.minimum(BLOCK, bounds[owner + 1] - begin)
        # words past a block's end change nothing: their factor is one and their step the identity
        place = begin[:, None] + np.arange(BLOCK)
        inside = np.arange(BLOCK) < size[:, None]
        e = np.where(inside[..., None], local[np.minimum(place, len(local) - 1)], 1.0)
        product = np.broadcast_to(np.eye(k), (len(owner), k, k)).copy()
        begins = nth == 0  # no step leads to a text's first word
        for t in range(BLOCK):
            moved = product @ step * e[:, t, None, :]
            if t == 0:
                moved = np.where(begins[:, None, None], product * e[:, 0, None, :], moved)
            moved /= moved.max(axis=(1, 2), keepdims=True)
            product = np.where(inside[:, t, None, None], moved, product)
        # messages at the blocks' borders, block by block over all texts at once
        into, after = np.full((len(owner), k), 1.0 / k), np.full((len(owner), k), 1.0)
        most = int(blocks.max(initial=0))
        for j in range(1, most):
            at = starts[:-1][blocks > j] + j
            m = np.einsum("bi,bij->bj", into[at - 1], product[at - 1])
            into[at] = m / m.sum(axis=1, keepdims=True)
        for j in range(most - 2, -1, -1):
            at = starts[:-1][blocks > j + 1] + j
            m = np.einsum("bij,bj->bi", product[at + 1], after[at + 1])
            after[at] = m / m.sum(axis=1, keepdims=True)
        forward, alpha = np.empty_like(e), into
        for t in range(BLOCK):
            moved = alpha @ step * e[:, t]
            if t == 0:
                moved = np.where(begins[:, None], alpha * e[:, 0], moved)
            moved /= moved.sum(axis=1, keepdims=True)
            alpha = np.where(inside[:, t, None], moved, alpha)
            forward[:, t] = alpha
        beta = after
        for t in range(BLOCK - 1, -1, -1):
            forward[:, t] *= beta
            moved = (beta * e[:, t]) @ step.T
            moved /= moved.sum(axis=1, keepdims=True)
            beta = np.where(inside[:, t, None], moved, beta)
        p = forward[inside]
        return p / p.sum(axis=1, keepdims=True)

    def word_by_word(self, emissions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The same without matrices of the blocks, for which many languages would need much room: nth words of all texts together."""
        local = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        step = np.exp(self.transitions - self.transitions.max())
        n = np.diff(bounds)
        order = np.argsort(-n, kind="stable")
        starts, n = bounds[:-1][order], n[order]
        out = np.empty_like(local)
        message = None
        for t in range(int(n.max(initial=0))):
            at = starts[: np.searchsorted(-n, -t, "left")] + t  # the texts with more than t words come first
            message = local[at] if message is None else message[: len(at)] @ step * local[at]
            message = message / message.sum(axis=1, keepdims=True)
            out[at] = message
        message = np.zeros((0, local.shape[1]))
        for t in range(int(n.max(initial=0)) - 1, -1, -1):
            at = starts[: np.searchsorted(-n, -t, "left")] + t
            message = np.concatenate([message, np.ones((len(at) - len(message), local.shape[1]))])
            out[at] *= message
            message = (message * local[at]) @ step.T
            message = message / message.sum(axis=1, keepdims=True)
        return out / out.sum(axis=1, keepdims=True)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        labels, scores = ["und"] * len(column), np.zeros(len(column))
        if not self.languages:
            return labels, scores
        for first, end, data, offsets in common.slices(column, max(1 << 14, (1 << 22) // max(4, len(self.languages)))):
            b, at, to, bounds = word_parts(data, offsets)
            if not len(at):
                continue
            hashes, _ = words.hash_words(data, offsets, _LETTERS)
            p = self.posteriors(self.emissions(b, at, to, hashes), bounds)
            total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
            plain = np.concatenate([[0], np.cumsum((b >= 97) & (b <= 122))])
            for i in np.flatnonzero(np.diff(bounds)):
                if plain[offsets[i]] == plain[offsets[i + 1]] and not any(c.isalpha() for c in column[first + int(i)].as_py()):
                    continue
                mean = (total[bounds[i + 1]] - total[bounds[i]]) / (bounds[i + 1] - bounds[i])
                best = int(mean.argmax())
                labels[first + i], scores[first + i] = self.languages[best], min(1.0, max(0.0, float(mean[best])))
        return labels, scores


def crf_fit(emission_rows: list[np.ndarray], sequences: np.ndarray, truth: np.ndarray, n_rows: int, k: int, *, steps: int = 300, batch: int = 128, rate: float = 0.3, decay: float = 1e-5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the likelihood of truth, by AdaGrad.

    emission_rows[w] are the feature rows of word w, sequences (n, length) are words, truth the languages of these.
    """
    rng = np.random.default_rng(seed)
    widest = max(map(len, emission_rows))
    rows = np.full((len(emission_rows), widest), n_rows, np.int64)  # one row more, always 0, fills up
    for w, r in enumerate(emission_rows):
        rows[w, : len(r)] = r
    weights, squares = np.zeros((n_rows + 1, k)), np.full((n_rows + 1, k), 1e-2)
    steps_log, step_squares = np.zeros((k, k)), np.full((k, k), 1e-2)
    length = sequences.shape[1]
    for _ in range(steps):
        chosen = rng.integers(0, len(sequences), batch)
        s, y = sequences[chosen], truth[chosen]
        e = weights[rows[s]].sum(axis=2)
        local, step = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(steps_log - steps_log.max())
        alpha, beta = np.empty_like(local), np.ones_like(local)
        alpha[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, length):
            a = alpha[:, t - 1] @ step * local[:, t]
            alpha[:, t] = a / a.sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            b = (beta[:, t + 1] * local[:, t + 1]) @ step.T
            beta[:, t] = b / b.sum(axis=1, keepdims=True)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        # the expected moves, summed: for each place the outer product of what comes before and after, over its total
        before, behind = alpha[:, :-1].reshape(-1, k), (local[:, 1:] * beta[:, 1:]).reshape(-1, k)
        expected = step * ((before / ((before @ step) * behind).sum(axis=1, keepdims=True)).T @ behind)
        g = -p
        np.put_along_axis(g, y[..., None], np.take_along_axis(g, y[..., None], 2) + 1, 2)
        seen, back = np.unique(rows[s], return_inverse=True)
        total = np.zeros((len(seen), k))
        np.add.at(total, back.reshape(-1), np.repeat(g.reshape(-1, k), widest, axis=0))
        total = total / batch - decay * weights[seen]
        squares[seen] += total * total
        weights[seen] += rate * total / np.sqrt(squares[seen])
        weights[n_rows] = 0
        moves = np.zeros((k, k))
        np.add.at(moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        moves = (moves - expected) / batch
        step_squares += moves * moves
        steps_log += rate * moves / np.sqrt(step_squares)
    return weights[:n_rows], steps_log


def fit(docs: DataFrame, *, per_language: int = 300, most_documents: int = 20_000, segments: int = 40, max_lexicon: int = 4096, folds: int = 4, held_out: int = 2) -> LanguageModel:
    usable = docs.where(F.col("lang").isNotNull() & F.coalesce(common.fold(F.col("doc_id"), folds) != held_out, F.lit(False))).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    counts = usable.groupBy("lang").count()
    languages = [r[0] for r in counts.orderBy(F.desc("count"), "lang").collect()]  # the distinct languages, which the model has a column for each of
    if not languages:
        return LanguageModel([], np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros((0, 0)))
    per_language = max(1, min(per_language, most_documents // len(languages)))
    # a language's documents with the least hashes: those of twice as many by expectation first, then these in order
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    few = usable.select("doc_id", "lang", place.alias("place")).join(F.broadcast(counts), "lang").where(F.col("place") < F.lit(float(1 << 40) * (2 * per_language + 20)) / F.col("count"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    chosen = few.withColumn("nth", nth).where(F.col("nth") <= per_language).select("doc_id", "lang").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                b, at, to, _ = word_parts(*common.utf8(pa.array([text or ""])))
                starts = np.arange(0, max(1, len(at) - RUN + 1), RUN)
                if len(starts) > segments:
                    starts = np.random.default_rng(doc & 0xFFFFFFFF).choice(starts, segments, replace=False)
                out += [(lang, b" ".join(b[at[i] : to[i]].tobytes() for i in range(s, min(s + RUN, len(at))))) for s in np.sort(starts) if len(at)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["lang", "words"])

    # about most_documents ids; the sample is as many * segments * RUN words at most
    rows = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).mapInArrow(cut, "lang string, words binary").collect()
    sample: list[tuple[str, list[bytes]]] = []
    held: dict[str, list[bytes]] = {}
    for lang, words_ in sorted((r[0], bytes(r[1])) for r in rows):
        found = words_.split(b" ")
        if len(found) < RUN:  # short documents of one language make pieces together
            found = held.get(lang, []) + found
            held[lang] = found[RUN:]
            if len(found) < RUN:
                held[lang] = found
                continue
        sample.append((lang, found[:RUN]))
    sample += [(lang, (found * RUN)[:RUN]) for lang, found in held.items() if found]
    languages.sort()
    k = len(languages)
    bits = min(BITS, (max(1, WEIGHTS // k)).bit_length() - 1)
    if k == 1 or not sample:
        return LanguageModel(languages[:1], np.zeros(0, np.uint64), np.zeros((1 << bits, 1)), np.zeros((1, 1)))
    number = {x: i for i, x in enumerate(languages)}
    vocabulary: dict[bytes, int] = {}
    pieces = np.array([[vocabulary.setdefault(w, len(vocabulary)) for w in found] for _, found in sample])
    of = np.array([number[r[0]] for r in sample])
    data, offsets = common.utf8(pa.array(list(vocabulary), pa.binary()))
    b, at, to, bounds = word_parts(data, offsets)
    hashes, _ = words.hash_words(data, offsets, _LETTERS)
    numbers, ends = features(b, at, to, bits)
    uses = np.bincount(pieces.ravel(), minlength=len(vocabulary))
    often = [int(w) for w in np.argsort(-uses, kind="stable")[: min(max_lexicon, 1 << bits)] if uses[w] >= 5]
    lexicon = np.sort(hashes[often])
    slot = {w: (1 << bits) + int(np.searchsorted(lexicon, hashes[w])) for w in often}
    emission_rows = [np.append(numbers[ends[w] : ends[w + 1]], [slot[w]] if w in slot else []).astype(np.int64) for w in range(len(vocabulary))]
    rng = np.random.default_rng(8)
    by = [np.flatnonzero(of == i) for i in range(k)]
    n, joined = 6000, 3
    kinds = [i for i in range(k) if len(by[i])]
    same = rng.random(n) < 0.7
    which = rng.choice(kinds, (n, joined))
    which[same] = which[same][:, :1]  # most texts keep to one language
    picks = np.array([[rng.choice(by[c]) for c in row] for row in which])
    weights, transitions = crf_fit(emission_rows, pieces[picks].reshape(n, -1), np.repeat(which, RUN, axis=1), (1 << bits) + len(lexicon), k, steps=max(300, 15 * k))
    return LanguageModel(languages, lexicon, weights, transitions)


def languages_of(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(docs, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * WEIGHTS numbers at most, unless there are more languages than that

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, scores = shared.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    held = common.fold(F.col("doc_id"), options.get("folds", 4)) == options.get("held_out", 2)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
