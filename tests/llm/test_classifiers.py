import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality as Q
from millrace.llm import toxicity as X
from millrace.llm.training import calibrated, labelled_sample

from .helpers import ODD_TEXTS, documents, write_tables

INSULTS = ["blorgish", "blorgant", "snarf"]


def corpus(n, seed, toxic_share=0.3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "re", "in", "on", "st", "er"]) for _ in range(rng.randint(1, 3)))
    texts, toxic, quality = [], [], []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        bad, junk = rng.random() < toxic_share, rng.random() < 0.4
        if bad:
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        texts.append(" ".join(w.upper() + "!!" for w in words) if junk else " ".join(words))
        toxic.append(int(bad))
        quality.append(int(not junk))
    return texts, np.array(toxic), np.array(quality)


def test_toxicity_gradients():
    p = {k: v.astype(np.float64) for k, v in X.new_parameters(np.random.default_rng(0)).items()}
    bucket, chars, lengths = X.word_inputs(["abc", "defgh", "x", "réeux"])
    args = (bucket, chars, lengths, np.array([[0, 1], [2, 3], [3, -1]]), np.array([1.0, 0.0]), np.ones(4))
    _, g = X.loss_and_gradient(p, *args)
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), p[k].shape)
        old, e = p[k][at], 1e-4
        p[k][at] = old + e
        up = X.loss_and_gradient(p, *args)[0]
        p[k][at] = old - e
        down = X.loss_and_gradient(p, *args)[0]
        p[k][at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) <= 1e-3 * abs(g[k][at]) + 1e-6, k


@pytest.fixture(scope="module")
def toxic_model():
    texts, toxic, _ = corpus(700, 1)
    return X.train(texts, toxic)


def test_toxicity_held_out(toxic_model):
    texts, toxic, _ = corpus(300, 2)
    predicted = toxic_model.scores(texts, toxic_model.cache()) >= X.THRESHOLD
    assert (predicted == toxic).mean() > 0.95


def forward(p, text):
    """The highest margin of a text's windows, one word and one character at a time."""

    def step(h, x, name):
        n = len(h)
        a, g = x @ p[f"{name}.W"] + p[f"{name}.b"], h @ p[f"{name}.U"]
        z, r = (1 / (1 + np.exp(-(a[i : i + n] + g[i : i + n]))) for i in (0, n))
        return z * h + (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :])

    def run(inputs, name, size):
        states = [np.zeros(size)]
        for x in inputs:
            states.append(step(states[-1], x, name))
        return states[1:]

    found = [w[i : i + X.PIECE] for w in re.findall(r"(?:(?!_)\w)+", text.lower()) for i in range(0, len(w), X.PIECE)]
    inputs = []
    for w in found:
        bucket, _, _ = X.word_inputs([w])
        chars = [p["char"][ord(c) if ord(c) < 128 else 128 + ord(c) % (X.CHAR_BUCKETS - 128)] for c in w]
        inputs.append(np.concatenate([p["word"][bucket[0]], run(chars, "cf", X.CHAR_STATE)[-1], run(chars[::-1], "cb", X.CHAR_STATE)[-1]]))
    margins = []
    for start in range(0, max(1, len(inputs) - X.WINDOW + X.STRIDE), X.STRIDE):
        window = inputs[start : start + X.WINDOW]
        states = [np.concatenate(s) for s in zip(run(window, "wf", X.STATE), run(window[::-1], "wb", X.STATE)[::-1])]
        pool = np.zeros(2 * X.STATE)
        if states:
            e = np.array([np.tanh(s @ p["att.A"]) @ p["att.v"] for s in states])
            e = np.exp(e - e.max())
            pool = (e / e.sum()) @ np.stack(states)
        margins.append(float(pool @ p["out.w"] + p["out.b"][0]))
    return max(margins)


def test_toxicity_scores_against_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    p = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in X.new_parameters(rng).items()}
    model = X.Model(p, 1.3, -0.2)
    texts = [t for t in corpus(12, 9)[0]] + ["", "one", "!!!", "x" * 70 + " réeux ß", "a b " * 40, " ".join(corpus(3, 10)[0])]
    plain = {k: v.astype(np.float64) for k, v in p.items()}
    want = [1 / (1 + np.exp(-(1.3 * forward(plain, t) - 0.2))) for t in texts]
    assert np.allclose(model.scores(texts, model.cache()), want, atol=1e-4)


def test_a_late_window_of_a_long_text_counts(toxic_model):
    cache = toxic_model.cache()
    clean = " ".join(["the", "on", "rest", "inan"] * 1000)
    low, high = toxic_model.scores([clean, clean + " blorgish " + "the on"], cache)
    assert low < X.THRESHOLD <= high


def test_scores_do_not_depend_on_the_batch(toxic_model):
    texts, _, _ = corpus(40, 3)
    alone = [toxic_model.scores([t], toxic_model.cache())[0] for t in texts]
    assert np.allclose(alone, toxic_model.scores(texts, toxic_model.cache()), atol=1e-5)


def test_every_word_is_in_a_window():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        windows, first = X.windows_of(np.arange(n), np.array([n]))
        assert set(windows.ravel().tolist()) - {-1} == set(range(n)) and first.tolist() == [0] and windows.shape[1] == X.WINDOW


def test_quality_held_out():
    texts, _, quality = corpus(500, 4)
    model = Q.train(texts, quality)
    texts, _, quality = corpus(200, 5)
    assert ((model.scores(texts, model.cache()) >= 0.5) == quality).mean() > 0.97


def test_quality_scores_against_plain_features():
    from collections import Counter

    from millrace.llm.textcore import Packed, mix

    def hashed(x):
        return Packed([x]).span_hash(np.array([0]), np.array([len(x)]))

    texts, _, quality = corpus(60, 6)
    model = Q.train(texts, quality, epochs=2)
    texts = texts[:20] + ["", "a", "a a", "a b a b a b", "x " * 30, "é ß 中文 é", "one two three four five six seven eight one"]
    for text, score in zip(texts, model.scores(texts, model.cache())):
        words, found = text.split(), Counter()
        spread = lambda h: Q.LAGS + int(h[0] % np.uint64(Q.BUCKETS - Q.LAGS))
        for w in (f"<{w}>" for w in words):
            found[spread(hashed(w) ^ np.uint64(0x5851F42D4C957F2D))] += 1
            found.update(spread(hashed(w[i : i + n])) for n in Q.GRAMS for i in range(len(w) - n + 1))
        found.update(spread(mix(hashed(a) * Q._PAIR + hashed(b))) for a, b in zip(words, words[1:]))
        found.update(lag - 1 for lag in range(1, Q.LAGS + 1) for a, b in zip(words, words[lag:]) if a == b)
        mean = sum(n * float(model.weight[b]) for b, n in found.items()) / max(1, sum(found.values()))
        assert abs(score - 1 / (1 + np.exp(-(model.a * mean + model.b)))) < 1e-6, text


def test_quality_is_the_mean_of_feature_vectors():
    texts, _, quality = corpus(60, 6)
    model = Q.train(texts, quality, epochs=2)
    for text, score in zip(texts, model.scores(texts, model.cache())):
        (buckets, share), = Q.features([text])
        assert abs(score - 1 / (1 + np.exp(-(model.a * float(share @ model.weight[buckets]) + model.b)))) < 1e-6


def test_one_class_or_no_labels():
    assert set(X.train(["a", "b"], np.array([0, 0])).scores(["a", ""], None)) == {0.0}
    model = Q.train([], np.zeros(0, np.int64))
    assert set(model.scores(["a", ""], model.cache())) == {0.5}


def test_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    a, b = calibrated(x, y)
    assert abs(a - 2) < 0.2 and abs(b + 1) < 0.2


@pytest.mark.parametrize("op,folds,held", [(X.op2, 4, 2), (Q.op6, 3, 1)])
def test_queries(spark, tmp_path, op, folds, held):
    texts, toxic, quality = corpus(120, 7)
    texts += ODD_TEXTS + ["same text"] * 2
    labels = [(i, int(quality[i]), int(toxic[i])) for i in range(120)] + [(3, None, None), (None, 1, 1), (10_000, 1, 1)]
    folder = write_tables(spark, tmp_path / "a", documents=documents(spark, texts, extra=True), labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r for r in op(spark, folder).collect()}
    assert set(got) == set(range(len(texts)))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % folds == held) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= (X.THRESHOLD if op is X.op2 else 0.5))
    assert got[len(texts) - 1].score == pytest.approx(got[len(texts) - 2].score)
    empty = write_tables(spark, tmp_path / "b", documents=documents(spark, []), labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert op(spark, empty).count() == 0


@pytest.mark.parametrize("op,folds,held,column", [(X.op2, 4, 2, 2), (Q.op6, 3, 1, 1)])
def test_labels_of_the_held_out_fold_are_not_read(spark, tmp_path, op, folds, held, column):
    texts, toxic, quality = corpus(90, 8)
    rows = [(i, int(q), int(t)) for i, (q, t) in enumerate(zip(quality, toxic))]
    flip = lambda r: tuple(1 - v if k == column and zlib.crc32(str(r[0]).encode()) % folds == held else v for k, v in enumerate(r))
    out = []
    for name, labels in (("a", rows), ("b", [flip(r) for r in rows])):
        folder = write_tables(spark, tmp_path / name, documents=documents(spark, texts), labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
        out.append({r.doc_id: r.score for r in op(spark, folder).collect()})
    assert out[0] == out[1] and len(set(out[0].values())) > 1


def test_null_ids_are_scored(spark, tmp_path):
    texts, toxic, quality = corpus(60, 11)
    docs = documents(spark, [*texts, "some text", None], ids=[*range(60), None, None])
    labels = spark.createDataFrame([(i, int(quality[i]), int(toxic[i])) for i in range(60)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    folder = write_tables(spark, tmp_path, documents=docs, labels=labels)
    for op, folds, held in ((X.op2, 4, 2), (Q.op6, 3, 1)):
        got = [r for r in op(spark, folder).collect() if r.doc_id is None]
        assert len(got) == 2 and {r.held_out for r in got} == {zlib.crc32(b"") % folds == held} and all(0 <= r.score <= 1 for r in got)


def test_samples_are_bounded_by_characters(spark):
    docs = documents(spark, ["x" * 100] * 50 + [None])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(51)], "doc_id bigint, quality int, toxic int")
    keep = F.lit(True)
    every, _ = labelled_sample(docs, labels, "toxic", keep, 100)
    some, found = labelled_sample(docs, labels, "toxic", keep, 100, 1000)
    assert len(every) == 51 and 10 <= len(some) <= 11 and len(found) == len(some)
    assert len(labelled_sample(docs, labels, "toxic", keep, 7)[0]) == 7
    long = documents(spark, ["y" * 5000] * 3)
    assert len(labelled_sample(long, labels, "toxic", keep, 100, 1000)[0]) == 1
