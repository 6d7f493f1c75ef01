"""Toxicity, quality and language: held-out accuracy, odd rows, empty tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from lodestone.llm import common, langid, lm, quality, queries, toxicity
from tests.llm.conftest import ODD, documents

MEDIUM = "/root/testdata/sf0.01"


def held_out_accuracy(spark, found, label):
    labels = common.table(spark, MEDIUM, "labels").select("doc_id", F.col(label).alias("truth")).where("truth IS NOT NULL")
    rows = found.where("held_out").join(labels, "doc_id").select("truth", "predicted").collect()
    assert len(rows) > 40
    return np.mean([r[0] == r[1] for r in rows])


def test_toxicity_of_held_out_documents(spark):
    assert held_out_accuracy(spark, queries.op1_toxicity(spark, MEDIUM), "toxic") >= 0.9


def test_quality_of_held_out_documents(spark):
    assert held_out_accuracy(spark, queries.op5_quality(spark, MEDIUM), "quality") >= 0.85


def test_language_of_held_out_documents(spark):
    docs = common.table(spark, MEDIUM, "documents").select("doc_id", "lang")
    rows = queries.op8_language_id(spark, MEDIUM).where("held_out").join(docs, "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95


@pytest.mark.parametrize(("run", "columns"), [(toxicity.toxicity, ["doc_id", "held_out", "score", "predicted"]), (quality.quality, ["doc_id", "held_out", "score", "predicted"])])
def test_classifiers_on_odd_rows(spark, odd, empty, run, columns):
    labels = common.table(spark, SMALL, "labels")
    for known in (labels, labels.limit(0), spark.createDataFrame([(4, None, None), (None, 1, 1), (5, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")):
        out = run(spark, odd, known)
        assert out.columns == columns
        rows = out.collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(x[0]) for x in ODD)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and isinstance(r["held_out"], bool) for r in rows)
        assert run(spark, empty, known).count() == 0


def test_scores_ignore_everything_but_the_text(spark):
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    for module in (toxicity, quality):
        model = module.fit(spark, docs, labels)
        plain = module.with_score(docs.select("text"), model).select("text", "score").distinct().count()
        assert plain == docs.select("text").distinct().count()


def test_risk_is_kept_from_going_negative():
    rng = np.random.default_rng(1)
    x = (rng.random((400, 6)) < 0.2).astype(np.uint8)
    x[:100, 0] = 1
    unlabelled = (rng.random((1000, 6)) < 0.2).astype(np.uint8)
    unlabelled[:, 0] = 0
    unlabelled[:200, 0] = 1
    w, b = toxicity.positive_unlabelled_fit(x[:100], unlabelled, 0.2)
    assert w[0] + b > 0 > b
    assert abs(w[0]) > 3 * np.abs(w[1:]).max()


def test_compression_measures_are_those_of_plain_compression():
    import zstandard

    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(200)]
    good = zstandard.train_dictionary(1024, [t.encode() for t in texts]).as_bytes()
    bad = zstandard.train_dictionary(1024, [t[::-1].encode() for t in texts]).as_bytes()
    model = quality.QualityModel(good, bad, None, 0.5)
    found = model.measures(pa.array([texts[0] * 20, None, ""]))
    parts = [(texts[0] * 20).encode()[k : k + quality.WINDOW] for k in range(0, len(texts[0]) * 20, quality.WINDOW)]
    size = [sum(len(zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(p)) - 6 for p in parts) for d in (good, bad)]
    assert found[0] == pytest.approx([(size[1] - size[0]) / (size[0] + size[1]), size[0] / sum(map(len, parts))])
    assert not found[1:].any()


def test_languages_on_odd_rows(spark, odd, empty):
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.languages_of(odd).collect()}
    of = {i: p for i, p, _ in rows}
    assert of[1] == of[2] == of[3] == of[10] == "und"
    assert of[4] == of[5] == of[9] == "en"
    assert langid.languages_of(empty).count() == 0


def test_forward_backward_is_that_of_one_chain():
    rng = np.random.default_rng(3)
    k, n = 3, 101
    e, t = rng.normal(size=(n, k)), rng.normal(size=(k, k))
    model = langid.LanguageModel(["a", "b", "c"], np.zeros(0, np.uint64), np.zeros((0, k)), t)
    bounds = np.array([0, 1, 1, 70, n])
    found = model.posteriors(e, bounds)
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        if a == z:
            continue
        alpha, beta = np.zeros((z - a, k)), np.zeros((z - a, k))
        alpha[0] = e[a]
        for i in range(1, z - a):
            alpha[i] = np.logaddexp.reduce(alpha[i - 1][:, None] + t, axis=0) + e[a + i]
        for i in range(z - a - 2, -1, -1):
            beta[i] = np.logaddexp.reduce(t + e[a + i + 1] + beta[i + 1], axis=1)
        p = alpha + beta
        p = np.exp(p - np.logaddexp.reduce(p, axis=1, keepdims=True))
        assert found[a:z] == pytest.approx(p, abs=1e-9)


def test_many_languages_take_the_same_messages():
    rng = np.random.default_rng(31)
    model = langid.LanguageModel(list("abcde"), np.zeros(0, np.uint64), np.zeros((1, 5)), rng.normal(size=(5, 5)))
    bounds = np.cumsum([0, 3, 0, 70, 1, 33, 0, 200])
    e = rng.normal(0, 3, (bounds[-1], 5))
    assert model.posteriors(e, bounds) == pytest.approx(model.word_by_word(e, bounds), abs=1e-9)


def test_short_documents_are_learned_from(spark):
    """Forty texts of four words, half in each of two languages."""
    rng = np.random.default_rng(32)
    own = {"de": "der die und nicht auch eine haus zeit wird über".split(), "fr": "le la et pas aussi une maison temps sera sur".split()}
    rows = [(i, " ".join(rng.choice(own[x], 4)), x) for i in range(40) for x in [("de", "fr")[i % 2]]]
    found = {r["doc_id"]: r for r in langid.languages_of(documents(spark, rows)).collect()}
    assert all(found[i]["lang_pred"] == x for i, _, x in rows)


def test_any_number_of_languages(spark):
    """Eighty made languages of six words each: none is left out."""
    rng = np.random.default_rng(33)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    own = [["".join(rng.choice(letters, 6)) for _ in range(6)] for _ in range(80)]
    rows = [(i, " ".join(rng.choice(own[i % 80], 12)), f"x{i % 80:02d}") for i in range(1600)]
    found = langid.languages_of(documents(spark, rows)).collect()
    right = [r["lang_pred"] == f"x{r['doc_id'] % 80:02d}" for r in found if r["held_out"]]
    assert len(right) > 300 and np.mean(right) > 0.95
    assert len({r["lang_pred"] for r in found}) == 80


def test_code_switched_words(spark):
    docs = common.table(spark, SMALL, "documents")
    model = langid.fit(docs)
    long = docs.where("n_chars > 600")
    texts = {lang: long.where(F.col("lang") == lang).orderBy("doc_id").first()["text"][:300] for lang in ("en", "de")}
    mixed = texts["en"] + " " + texts["de"]
    data, offsets = common.utf8(pa.array([mixed]))
    b, at, to, bounds = langid.word_parts(data, offsets)
    hashes, _ = langid.words.hash_words(data, offsets, langid._LETTERS)
    labels = model.posteriors(model.emissions(b, at, to, hashes), bounds).argmax(axis=1)
    n = len(langid.word_parts(*common.utf8(pa.array([texts["en"]])))[1])
    assert np.mean(labels[:n] == model.languages.index("en")) > 0.8
    assert np.mean(labels[n:] == model.languages.index("de")) > 0.8


def test_pseudo_likelihood(spark, odd, empty):
    docs = common.table(spark, SMALL, "documents")
    vocabulary, n_words = lm.vocabulary_of(docs, 512)
    net = lm.train(docs, vocabulary, n_words)
    # whatever the context, the probabilities of all tokens sum to one
    context = np.array([5, 3, vocabulary.size, 8])
    every = np.arange(vocabulary.size)
    assert np.exp(net.log_probabilities(np.repeat(context[:, None], len(every), axis=1), every)).sum() == pytest.approx(1, abs=1e-3)
    rows = lm.score(docs, vocabulary, net).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    plain = {i: [w for w in (t or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w] for i, t in texts.items()}
    assert all(r["n_tokens"] == len(plain[r["doc_id"]]) for r in rows) and sum(map(len, plain.values())) == n_words
    trained = sum(r["log_likelihood"] for r in rows)
    untrained = sum(r["log_likelihood"] for r in lm.score(docs, vocabulary, lm.Network(vocabulary)).collect())
    assert trained > untrained
    one = max((r for r in rows if 10 < r["n_tokens"] < 60), key=lambda r: r["n_tokens"])
    found, _ = lm.words.hash_words(*common.utf8(pa.array([texts[one["doc_id"]]])))
    tokens = vocabulary.tokens(found)
    total = 0.0
    for i in range(len(tokens)):
        around = [tokens[i + d] if 0 <= i + d < len(tokens) else vocabulary.size for d in (-2, -1, 1, 2)]
        h = np.tanh(sum(net.embed[j][around[j]] for j in range(4)))
        z = h @ net.out[:-1] + net.out[-1]
        total += z[vocabulary.of[tokens[i]]] - np.log(np.exp(z).sum())
        for k in range(vocabulary.begins[tokens[i]], vocabulary.begins[tokens[i]] + vocabulary.depths[tokens[i]]):
            total -= np.log1p(np.exp(-vocabulary.signs[k] * (net.nodes[vocabulary.nodes[k]] @ np.append(h, 1))))
    total += vocabulary.within(found, tokens).sum()
    assert one["log_likelihood"] == pytest.approx(total, rel=1e-4)
    odd_rows = {r["doc_id"]: r for r in lm.pseudo_likelihood(odd).collect()}
    assert odd_rows[1]["n_tokens"] == 0 and odd_rows[2]["log_likelihood"] == 0 and odd_rows[3]["mean_log_likelihood"] is None
    assert odd_rows[5]["n_tokens"] == 40000 and np.isfinite(odd_rows[5]["log_likelihood"])
    assert lm.pseudo_likelihood(empty).count() == 0


def test_a_step_of_training_goes_down_the_slope():
    """The network's own gradients against differences of the negative log-probability."""
    rng = np.random.default_rng(41)
    vocabulary = lm.Vocabulary(np.arange(300, dtype=np.uint64) * np.uint64(7919), rng.integers(1, 500, 300).astype(float), np.ones(lm.BUCKETS, np.float32), np.ones(lm.OTHER))
    net = lm.Network(vocabulary)
    start = [rng.normal(0, 0.3, x.shape) for x in (net.embed, net.out, net.nodes)]
    context, tokens = rng.integers(0, vocabulary.size + 1, (4, 20)), rng.integers(0, vocabulary.size, 20)

    def loss() -> float:
        return -net.log_probabilities(context, tokens).sum()

    net.embed, net.out, net.nodes = (x.copy() for x in start)
    huge = 1e12  # squares this large make steps of rate / 1e6 times the gradient
    net.train(context, tokens, [np.full(x.shape, huge) for x in start], rate=1.0)
    moved = [(a - b) * 1e6 for a, b in zip(start, (net.embed, net.out, net.nodes), strict=True)]
    for k, name in enumerate(("embed", "out", "nodes")):
        for place in [tuple(int(rng.choice(np.flatnonzero(np.any(moved[k] != 0, axis=tuple(j for j in range(moved[k].ndim) if j != axis)))) ) for axis in range(moved[k].ndim)) for _ in range(12)]:
            values = []
            for step in (1e-4, -1e-4):
                net.embed, net.out, net.nodes = (x.copy() for x in start)
                getattr(net, name)[place] += step
                values.append(loss())
            assert moved[k][place] == pytest.approx((values[0] - values[1]) / 2e-4, rel=1e-3, abs=1e-5)


def test_the_model_does_not_depend_on_how_rows_lie(spark):
    docs = common.table(spark, SMALL, "documents")
    vocabulary, n_words = lm.vocabulary_of(docs, 256)
    one, two = (lm.train(d, vocabulary, n_words, shard_tokens=10_000).flat() for d in (docs.coalesce(1), docs.repartition(7, "lang", "source")))
    assert (one == two).all()


def test_every_word_is_a_target_of_the_training(spark):
    docs = common.table(spark, SMALL, "documents").limit(60)
    vocabulary, n_words = lm.vocabulary_of(docs, 256)
    default, all_, half = (lm.train(docs, vocabulary, n_words, **more).flat() for more in ({}, {"every": 1}, {"every": 2}))
    assert (default == all_).all() and (default != half).any()


def test_words_that_occur_more_often_are_likelier(spark):
    """Words too rare to be tokens keep their counts: a text of words that occur twice scores above one of words that occur once."""
    rng = np.random.default_rng(42)
    made = lambda k: " ".join(f"rare{k}x{i}" for i in range(50))
    rows = [(k, " ".join(rng.choice(["the", "of", "and", "to"], 200))) for k in range(100)] + [(200, made(0)), (201, made(0)), (202, made(1))]
    found = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.pseudo_likelihood(documents(spark, rows)).collect()}
    assert found[200] == found[201] > found[202]


