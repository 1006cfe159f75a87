"""Quality classifier: supervised subword embeddings.

A document's features are its words (between white space, case and punctuation kept), the character n-grams of each
word, and each two neighbouring words, all hashed to buckets; and a word that comes again after 1 to ``LAGS`` words has the bucket
of that distance. Each bucket has a learned vector; a document is the mean of its features' vectors; a softmax gives
the classes. Vectors and output weights are trained by stochastic gradient descent in numpy on a
bounded labelled sample (``TRAIN_MOST``); a logistic fit on the same sample calibrates the score.

Scoring is linear in the vectors up to the softmax, so each bucket's vector is multiplied with the output weights
once, and each distinct word is summed once a task. Whole texts are read; no shuffle: texts stay in their tasks.

Defined cases: a null or empty text has no features and gets the score of the mean vector zero; a null doc_id counts
as the empty id for the folds; repeated rows are scored alike; without labels of both classes every score is 0.5;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, worker_resource
from .textcore import Packed, SpanCache, mix, packed, sums_by_text, text_slices
from .training import calibrated, labelled_sample, remainder, sigmoid

BUCKETS, DIM, GRAMS, LAGS = 1 << 17, 12, (3, 4, 5), 8
TRAIN_MOST, EPOCHS, RATE, SEED = 4000, 6, 0.4, 7
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.5
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
#: White space of any script, as Python has it.
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def word_spans(pack: Packed) -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(0x3002, bool)
    space[_SPACES] = True
    return pack.runs(~space[np.minimum(pack.cps, 0x3001)])


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of features, buckets) of each word: the word itself, then its n-grams with both ends marked."""
    pack = Packed([f"<{w}>" for w in words])
    starts, ends = pack.bounds[:-1], pack.bounds[1:]
    owner, hashes = [np.arange(len(words))], [pack.span_hash(starts, ends) ^ np.uint64(0x5851F42D4C957F2D)]
    of = np.repeat(np.arange(len(words)), ends - starts)
    at = np.arange(len(pack.cps))
    for n in GRAMS:
        first = at[at + n <= ends[of]] if len(at) else at
        owner.append(of[first])
        hashes.append(pack.span_hash(first, first + n))
    owners, buckets = np.concatenate(owner), LAGS + np.concatenate(hashes) % np.uint64(BUCKETS - LAGS)
    order = np.argsort(owners, kind="stable")
    return np.bincount(owners, minlength=len(words)), buckets[order].astype(np.int64)


class Model:
    """``weight``: what one occurrence of a bucket adds to the margin of class 1; a and b calibrate the mean."""

    def __init__(self, weight: np.ndarray, a: float, b: float):
        self.weight, self.a, self.b = weight, a, b

    def compute(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        n, buckets = word_features(words)
        one = np.ones(len(words), np.int64)
        return [(one, sums_by_text(self.weight[buckets].astype(np.float64), n)), (one, n)]

    def scores(self, texts: list[str], cache: SpanCache) -> np.ndarray:
        out = []
        for _, _, pack in packed(texts):
            starts, ends = word_spans(pack)
            if not len(starts):
                out.append(np.zeros(len(pack.texts)))
                continue
            rows = cache.rows(pack, starts, ends)
            counts = pack.counts(starts)
            margin, n = (sums_by_text(cache.parts[k][2][rows], counts) for k in (0, 1))
            buckets, pairs = context_features(cache.hashes[rows], counts)
            margin = margin + sums_by_text(self.weight[buckets].astype(np.float64), pairs)
            out.append(margin / np.maximum(n + pairs, 1))
        return sigmoid(self.a * np.concatenate(out) + self.b) if out else np.zeros(0)

    def cache(self) -> SpanCache:
        return SpanCache(self.compute)


def context_features(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of neighbouring words and of words that come again, text by text; number of each text's), from the
    words' hashes in order."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    inside = of[1:] == of[:-1]
    found = [LAGS + (mix(hashes[:-1] * _PAIR + hashes[1:])[inside] % np.uint64(BUCKETS - LAGS)).astype(np.int64)]
    owner = [of[1:][inside]]
    for lag in range(1, min(LAGS, len(hashes) - 1) + 1):
        again = (hashes[lag:] == hashes[:-lag]) & (of[lag:] == of[:-lag])
        owner.append(of[lag:][again])
        found.append(np.full(len(owner[-1]), lag - 1))
    owners = np.concatenate(owner)
    return np.concatenate(found)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(counts))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their shares) of each text."""
    cache = SpanCache(lambda words: [word_features(words)], limit=1 << 40)
    out = []
    for _, _, pack in packed(texts):
        starts, ends = word_spans(pack)
        if not len(starts):
            out += [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(pack.texts)
            continue
        rows, counts = cache.rows(pack, starts, ends), pack.counts(starts)
        n, buckets = cache.gather(0, rows)
        pair_buckets, pairs = context_features(cache.hashes[rows], counts)
        a = c = 0
        for b, d in zip(np.cumsum(sums_by_text(n, counts)).tolist(), np.cumsum(pairs).tolist()):
            seen, times = np.unique(np.concatenate([buckets[a:b], pair_buckets[c:d]]), return_counts=True)
            out.append((seen, (times / max(1, b - a + d - c)).astype(np.float32)))
            a, c = b, d
        if len(cache.index) > 400_000:
            cache.clear()
    return out


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), 1.0, 0.0)
    docs = features(texts)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output = np.zeros((2, DIM), np.float32)
    total, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            buckets, share = docs[i]
            step = rate * (1 - done / total)
            done += 1
            if not len(buckets):
                continue
            some = vectors[buckets]
            hidden = share @ some
            p = np.exp(output @ hidden - np.max(output @ hidden))
            error = p / p.sum()
            error[labels[i]] -= 1
            back = error @ output
            output -= step * np.outer(error, hidden)
            # Each feature's step is scaled to a share of 1 / number of features, as with one update an occurrence.
            vectors[buckets] = some - (step * len(buckets) * share[:, None] * 0.5) * back
    weight = (vectors @ (output[1] - output[0])).astype(np.float32)
    margin = np.array([float(share @ weight[buckets]) if len(buckets) else 0.0 for buckets, share in docs])
    return Model(weight, *calibrated(margin, labels))


def opened(packed_model: bytes) -> tuple[Model, SpanCache]:
    import pickle

    def make():
        model = pickle.loads(packed_model)
        return model, model.cache()

    return worker_resource(packed_model, make)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """(doc_id, ``column``) for each row of docs (doc_id, text)."""
    import pickle

    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        found, cache = opened(shared.value)
        for batch in batches:
            for at, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(found.scores(texts, cache))], names=["doc_id", column])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, f"doc_id bigint, {column} double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    texts, labels = labelled_sample(docs, read_table(spark, sf_dir, "labels"), "quality", remainder("doc_id", FOLDS) != HELD_OUT, TRAIN_MOST)
    return score(docs, train(texts, labels)).select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
