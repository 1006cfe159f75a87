"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text's words (runs of letters and digits, lower case, in pieces of at most ``PIECE`` characters) are cut into
overlapping windows of ``WINDOW`` words at every ``STRIDE`` words; all windows are scored, and a document has the
score of its highest. A word's input is a learned hashed word vector with the two end states of a bidirectional gated
recurrent network over its characters; a second such network reads the window's words; attention pools its states.

Training, in numpy, on a bounded labelled sample (``TRAIN_MOST`` documents): labels are of documents, so windows are
chosen by turns: a positive document teaches by its highest window, a negative one by its highest and a random one.
The first choice is by the words and word beginnings that the sample's positive documents have more often. A logistic
fit on the sample's highest windows calibrates the score.

Scoring works in tasks on whole texts without a shuffle; each distinct word's characters are read once a task.

Defined cases: a null, empty or wordless text has one window without words, whose score is that of the output's bias;
a null doc_id counts as the empty id for the folds; repeated rows are scored alike; without labels of both classes
every score is 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import LETTER, NUMBER, classes
from .common import map_arrow, read_table, release, worker_resource
from .textcore import Packed, SpanCache, distinct, packed, text_slices
from .training import calibrated, labelled_sample, remainder, sigmoid

WINDOW, STRIDE, PIECE = 32, 16, 24
WORD_BUCKETS, WORD_DIM, CHAR_BUCKETS, CHAR_DIM, CHAR_STATE, STATE, ATTEND = 1 << 16, 8, 192, 8, 8, 12, 12
TRAIN_MOST, EPOCHS, BATCH, RATE, WORD_DROPOUT, SEED = 8000, 6, 64, 4e-3, 0.3, 11
#: A word has a vector of its own if at least so many texts of the sample have it; others are known by their characters.
WORD_TEXTS = 6
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Whether word vectors start from their words' log-odds instead of at random.
START_FROM_ODDS = True
#: Windows scored at a time, and windows whose words are held at a time in training.
CHUNK, GROUP = 2048, 1 << 13


def word_spans(pack: Packed) -> tuple[np.ndarray, np.ndarray]:
    """Words of at most PIECE characters; longer runs are several words."""
    kind = classes()[pack.cps]
    starts, ends = pack.runs((kind == LETTER) | (kind == NUMBER))
    n = (ends - starts + PIECE - 1) // PIECE
    if len(n) and n.max() > 1:
        part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(starts, n) + part * PIECE
        ends = np.minimum(starts + PIECE, np.repeat(ends, n))
    return starts, ends


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, characters' buckets as rows of PIECE, lengths) of each word."""
    pack = Packed(words)
    starts, ends = pack.bounds[:-1], pack.bounds[1:]
    bucket = (pack.span_hash(starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    lengths = ends - starts
    chars = np.zeros((len(words), PIECE), np.uint8)
    cps = pack.cps.astype(np.int64)
    which = np.repeat(np.arange(len(words)), lengths)
    chars[which, np.arange(len(cps)) - np.repeat(starts, lengths)] = np.where(cps < 128, cps, 128 + cps % (CHAR_BUCKETS - 128))
    return bucket, chars, lengths


def new_parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def glorot(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"word": (0.1 * rng.standard_normal((WORD_BUCKETS, WORD_DIM))).astype(np.float32), "char": (0.5 * rng.standard_normal((CHAR_BUCKETS, CHAR_DIM))).astype(np.float32)}
    for name, inputs, state in (("cf", CHAR_DIM, CHAR_STATE), ("cb", CHAR_DIM, CHAR_STATE), ("wf", WORD_DIM + 2 * CHAR_STATE, STATE), ("wb", WORD_DIM + 2 * CHAR_STATE, STATE)):
        p |= {f"{name}.W": glorot(inputs, 3 * state), f"{name}.U": glorot(state, 3 * state), f"{name}.b": np.zeros(3 * state, np.float32)}
    return p | {"att.A": glorot(2 * STATE, ATTEND), "att.v": glorot(ATTEND), "out.w": glorot(2 * STATE), "out.b": np.full(1, -2, np.float32)}


def gru(a: np.ndarray, U: np.ndarray, mask: np.ndarray, back: bool, keep: bool = True):
    """States of a gated recurrent network over inputs a (T, N, 3h); where the mask is 0, a state carries on."""
    T, N, h3 = a.shape
    n = h3 // 3
    h = np.zeros((N, n), a.dtype)
    states = np.empty((T, N, n), a.dtype)
    held = []
    for t in range(T - 1, -1, -1) if back else range(T):
        g = h @ U
        gates = sigmoid(a[t, :, : 2 * n] + g[:, : 2 * n]).astype(a.dtype)
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(a[t, :, 2 * n :] + r * g[:, 2 * n :])
        m = mask[t][:, None]
        if keep:
            held.append((t, h, z, r, new, g[:, 2 * n :], m))
        h = h + m * (1 - z) * (new - h)
        states[t] = h
    return states, h, held


def gru_backward(d_states: np.ndarray | None, d_last: np.ndarray | None, U: np.ndarray, held: list, shape: tuple):
    """(gradient of the inputs, of U) from those of all states and of the last."""
    da = np.zeros(shape, U.dtype)
    dU = np.zeros_like(U)
    n = U.shape[0]
    dh = np.zeros((shape[1], n), U.dtype) if d_last is None else d_last
    for t, before, z, r, new, gn, m in reversed(held):
        if d_states is not None:
            dh = dh + d_states[t]
        d_new = dh * m * (1 - z) * (1 - new * new)
        d_z = -dh * m * (new - before) * z * (1 - z)
        d_r = d_new * gn * r * (1 - r)
        dg = np.concatenate([d_z, d_r, d_new * r], 1)
        da[t, :, : 2 * n] = dg[:, : 2 * n]
        da[t, :, 2 * n :] = d_new
        dU += before.T @ dg
        dh = dh * (1 - m * (1 - z)) + dg @ U.T
    return da, dU


def char_states(p, chars, lengths, keep=True):
    """End states of the character network, forward and backward, of each word."""
    T = max(1, int(lengths.max(initial=1)))
    mask = (np.arange(T)[:, None] < lengths[None, :]).astype(np.float32)
    x = p["char"][chars[:, :T].T]
    out = []
    for name, back in (("cf", False), ("cb", True)):
        a = x @ p[f"{name}.W"] + p[f"{name}.b"]
        out.append((*gru(a, p[f"{name}.U"], mask, back, keep)[1:], a.shape))
    return x, out


def pooled(p, states, mask):
    """Attention weights over the window's states, and the pooled state."""
    hidden = np.tanh(states @ p["att.A"])
    e = hidden @ p["att.v"] - 1e4 * (1 - mask)
    e = np.exp(e - e.max(0))
    weight = e / e.sum(0) * mask.any(0)
    return hidden, weight, np.einsum("tn,tnd->nd", weight, states)


def loss_and_gradient(p, bucket, chars, lengths, windows, labels, drop):
    """Mean cross-entropy of windows (T, N) of word numbers, -1 where none, and its gradient."""
    T, N = windows.shape
    mask = (windows >= 0).astype(np.float32)
    used, local = np.unique(np.where(windows >= 0, windows, windows.max(initial=0)), return_inverse=True)
    local = local.reshape(T, N)
    x, ends = char_states(p, chars[used], lengths[used])
    word = p["word"][bucket[used]] * drop[used][:, None]
    inputs = np.concatenate([word, ends[0][0], ends[1][0]], 1)
    both, helds = [], []
    for name, back in (("wf", False), ("wb", True)):
        a = (inputs @ p[f"{name}.W"] + p[f"{name}.b"])[local]
        states, _, held = gru(a, p[f"{name}.U"], mask, back)
        both.append(states)
        helds.append(held)
    states = np.concatenate(both, 2)
    hidden, weight, pool = pooled(p, states, mask)
    margin = pool @ p["out.w"] + p["out.b"]
    prob = sigmoid(margin)
    loss = float(np.mean(np.logaddexp(0, margin) - labels * margin))

    g = {k: np.zeros_like(v) for k, v in p.items()}
    d = ((prob - labels) / N).astype(np.float32)
    g["out.w"], g["out.b"] = pool.T @ d, d.sum(keepdims=True)
    d_pool = d[:, None] * p["out.w"]
    d_states = weight[:, :, None] * d_pool
    d_weight = np.einsum("tnd,nd->tn", states, d_pool)
    d_e = weight * (d_weight - (weight * d_weight).sum(0))
    g["att.v"] = np.einsum("tna,tn->a", hidden, d_e)
    d_hidden = d_e[:, :, None] * p["att.v"] * (1 - hidden * hidden)
    g["att.A"] = states.reshape(T * N, -1).T @ d_hidden.reshape(T * N, -1)
    d_states = d_states + d_hidden @ p["att.A"].T
    order = np.argsort(local.ravel(), kind="stable")
    firsts = np.searchsorted(local.ravel()[order], np.arange(len(used)))
    d_inputs = np.zeros_like(inputs)
    for k, name in enumerate(("wf", "wb")):
        da, g[f"{name}.U"] = gru_backward(d_states[:, :, k * STATE : (k + 1) * STATE], None, p[f"{name}.U"], helds[k], (T, N, 3 * STATE))
        d_words = np.add.reduceat(da.reshape(T * N, -1)[order], firsts, 0)
        g[f"{name}.W"], g[f"{name}.b"] = inputs.T @ d_words, d_words.sum(0)
        d_inputs += d_words @ p[f"{name}.W"].T
    np.add.at(g["word"], bucket[used], d_inputs[:, :WORD_DIM] * drop[used][:, None])
    dx = np.zeros_like(x)
    for k, name in enumerate(("cf", "cb")):
        _, held, shape = ends[k]
        d_last = d_inputs[:, WORD_DIM + k * CHAR_STATE : WORD_DIM + (k + 1) * CHAR_STATE]
        da, g[f"{name}.U"] = gru_backward(None, d_last, p[f"{name}.U"], held, shape)
        g[f"{name}.W"] = x.reshape(-1, CHAR_DIM).T @ da.reshape(-1, shape[2])
        g[f"{name}.b"] = da.sum((0, 1))
        dx += da @ p[f"{name}.W"].T
    flat = chars[used][:, : x.shape[0]].T.ravel().astype(np.int64)
    g["char"] = np.stack([np.bincount(flat, dx[:, :, j].ravel(), CHAR_BUCKETS) for j in range(CHAR_DIM)], 1).astype(np.float32)
    return loss, g


class Model:
    def __init__(self, p: dict[str, np.ndarray] | None, a: float = 1.0, b: float = 0.0):
        self.p, self.a, self.b = p, a, b

    def compute(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """What each word adds to the gates of both directions."""
        p, parts = self.p, []
        bucket, chars, lengths = word_inputs(words)
        order = np.argsort(lengths, kind="stable")
        for i in range(0, len(words), 8192):
            some = order[i : i + 8192]
            _, ends = char_states(p, chars[some], lengths[some], keep=False)
            x = np.concatenate([p["word"][bucket[some]], ends[0][0], ends[1][0]], 1)
            parts.append(np.concatenate([x @ p["wf.W"] + p["wf.b"], x @ p["wb.W"] + p["wb.b"]], 1))
        out = np.empty((len(words), 6 * STATE), np.float32)
        out[order] = np.concatenate(parts)
        return [(np.full(len(words), 6 * STATE), out.ravel())]

    def cache(self) -> SpanCache:
        return SpanCache(self.compute, limit=100_000)

    def window_margins(self, table: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """The margins of windows (N, T) of rows of ``table``, -1 where there is no word."""
        p, out = self.p, np.empty(len(windows), np.float32)
        n = STATE
        half = np.ones(3 * n, np.float32)
        half[: 2 * n] = 0.5  # a sigmoid is a tanh of half the argument
        sides = [(back, np.ascontiguousarray(table[:, lo : lo + 3 * n]) * half, p[f"{name}.U"] * half, lo // 3) for name, back, lo in (("wf", False, 0), ("wb", True, 3 * n))]
        for i in range(0, len(windows), CHUNK):
            idx = np.ascontiguousarray(windows[i : i + CHUNK].T)
            T, N = idx.shape
            mask = (idx >= 0).astype(np.float32)
            full = bool(mask.all())
            states = np.empty((T, N, 2 * n), np.float32)
            for back, gates_in, U, at in sides:
                h = np.zeros((N, n), np.float32)
                for t in range(T - 1, -1, -1) if back else range(T):
                    a = gates_in[idx[t]]
                    g = h @ U
                    s = np.tanh(a[:, : 2 * n] + g[:, : 2 * n])
                    new = np.tanh(a[:, 2 * n :] + (0.5 * s[:, n:] + 0.5) * g[:, 2 * n :])
                    step = (0.5 - 0.5 * s[:, :n]) * (new - h)
                    h = h + (step if full else step * mask[t][:, None])
                    states[t, :, at : at + n] = h
            _, _, pool = pooled(p, states, mask)
            out[i : i + CHUNK] = pool @ p["out.w"] + p["out.b"]
        return out

    def margins(self, texts: list[str], cache: SpanCache) -> np.ndarray:
        """Each text's highest window."""
        out = []
        for _, _, pack in packed([t.lower() for t in texts]):
            starts, ends = word_spans(pack)
            table = np.zeros((1, 6 * STATE), np.float32)
            rows = np.zeros(0, np.int64)
            if len(starts):
                rows = cache.rows(pack, starts, ends)
                used, rows = np.unique(rows, return_inverse=True)
                table = cache.parts[0][2].reshape(-1, 6 * STATE)[used]
            windows, first = windows_of(rows, pack.counts(starts))
            margin = self.window_margins(table, windows)
            out.append(np.maximum.reduceat(margin, first))
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def scores(self, texts: list[str], cache: SpanCache) -> np.ndarray:
        if self.p is None:
            return np.zeros(len(texts))
        return sigmoid(self.a * self.margins(texts, cache).astype(np.float64) + self.b)


def window_places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end of the text) of every window, and each text's first window."""
    n = np.maximum(0, counts - WINDOW + STRIDE - 1) // STRIDE + 1
    first = np.cumsum(n) - n
    text = np.repeat(np.arange(len(counts)), n)
    begin = np.cumsum(counts) - counts
    return begin[text] + (np.arange(int(n.sum())) - first[text]) * STRIDE, (begin + counts)[text], first


def window_words(rows: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Windows as rows of WINDOW word numbers, -1 past a text's end."""
    out = np.full((len(start), WINDOW), -1, np.int32)
    for k in range(WINDOW if len(rows) else 0):
        inside = start + k < stop
        out[inside, k] = rows[start[inside] + k]
    return out


def windows_of(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all windows, each text's first window)."""
    start, stop, first = window_places(counts)
    return window_words(rows, start, stop), first


def suspicion(words: list[str], text_words: list[np.ndarray], labels: np.ndarray, least: int = 4) -> np.ndarray:
    """For each word, the largest log-odds of positive texts among the word and its beginnings of 3 to 8 characters."""
    pack = Packed(words)
    starts, lengths = pack.bounds[:-1], np.diff(pack.bounds)
    total = np.maximum(1, np.bincount(labels, minlength=2))
    out = np.full(len(words), -9.0)
    for n in (0, *range(3, 9)):  # 0: the whole word; one length at a time keeps the arrays short
        long = np.flatnonzero(lengths >= n)
        _, _, key = distinct(pack.span_hash(starts[long], starts[long] + n if n else pack.bounds[1:]))
        key_of = np.full(len(words), -1, np.int32)
        key_of[long] = key
        have = np.zeros((2, int(key.max(initial=-1)) + 1))
        for found, y in zip(text_words, labels):
            mine = np.unique(key_of[found])
            have[int(y), mine[mine >= 0]] += 1
        odds = np.log((have[1] + 0.5) / total[1]) - np.log((have[0] + 0.5) / total[0])
        odds[have[1] < least] = -9
        out[long] = np.maximum(out[long], odds[key])
    return out


def train(texts: Iterable[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model of some texts and their labels. Texts are read once, in order, and not kept."""
    if not len(labels) or labels.min() == labels.max():
        return Model(None)
    rng = np.random.default_rng(seed)
    # The sample's words are numbered once.
    seen: dict[str, int] = {}
    text_words = []
    source = iter(texts)
    while some := [t.lower() for t in itertools.islice(source, 200)]:
        pack = Packed(some)
        starts, ends = word_spans(pack)
        found = np.array([seen.setdefault(pack.joined[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist())], np.int32)
        text_words += np.split(found, np.cumsum(pack.counts(starts))[:-1])
    words = list(seen)
    del seen
    release()
    bucket, chars, lengths = word_inputs(words)
    spread = np.bincount(np.concatenate([np.unique(x) for x in text_words]), minlength=len(words))
    own = (spread >= WORD_TEXTS).astype(np.float32)
    counts = np.array([len(x) for x in text_words])
    start, stop, first = window_places(counts)
    n = np.diff(np.append(first, len(start)))
    odds = np.append(suspicion(words, text_words, labels), -9.0)
    flat = np.concatenate(text_words)
    del text_words
    release()
    windows = lambda which: window_words(flat, start[which], stop[which])
    highest = np.concatenate([odds[windows(slice(i, i + GROUP))].max(1) for i in range(0, len(start), GROUP)])

    p = new_parameters(rng)
    p["word"][np.setdiff1d(np.arange(WORD_BUCKETS), bucket[own > 0])] = 0
    if START_FROM_ODDS:
        p["word"][bucket[own > 0], 0] = np.clip(odds[:-1][own > 0], -2, 4) / 2  # where training starts; it goes on from there
    model = Model(p)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    steps = 0
    total_steps = None
    for epoch in range(epochs):
        if epoch:
            highest = all_margins(model, words, windows, len(start))
            release()
        best = np.array([f + int(np.argmax(highest[f : f + k])) for f, k in zip(first.tolist(), n.tolist())])
        random = first + rng.integers(0, n)
        negative = np.flatnonzero(labels == 0)
        chosen = np.concatenate([best[labels == 1], best[labels == 1], best[negative], random[negative]])
        y = np.concatenate([np.ones(2 * int((labels == 1).sum())), np.zeros(2 * len(negative))])
        order = rng.permutation(len(chosen))
        total_steps = total_steps or epochs * (len(order) // BATCH + 1)
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            drop = own * (rng.random(len(words)) >= WORD_DROPOUT) / np.float32(1 - WORD_DROPOUT)
            _, g = loss_and_gradient(p, bucket, chars, lengths, windows(chosen[some]).T, y[some], drop.astype(np.float32))
            steps += 1
            rate = RATE * min(1.0, steps / 20) * max(0.05, 1 - steps / total_steps)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v *= min(1.0, 1.0 / (norm + 1e-9))
                m1, m2 = moment[k]
                m1 += 0.1 * (v - m1)
                m2 += 0.01 * (v * v - m2)
                p[k] -= rate * (m1 / (1 - 0.9**steps)) / (np.sqrt(m2 / (1 - 0.99**steps)) + 1e-7)
    margin = np.maximum.reduceat(all_margins(model, words, windows, len(start)), first).astype(np.float64)
    model.a, model.b = calibrated(margin, labels)
    return model


def all_margins(model: Model, words: list[str], windows: Callable[[slice], np.ndarray], n: int) -> np.ndarray:
    """The margins of all n windows of the sample, in groups, so that only a group's words are held at a time."""
    out = []
    for i in range(0, n, GROUP):
        group = windows(slice(i, i + GROUP))
        used, local = np.unique(group, return_inverse=True)
        none = int(used[0] < 0)
        some = [words[w] for w in used[none:].tolist()]
        table = model.compute(some)[0][1].reshape(-1, 6 * STATE) if some else np.zeros((1, 6 * STATE), np.float32)
        out.append(model.window_margins(table, local.reshape(-1, WINDOW) - none))
    return np.concatenate(out)


def opened(packed_model: bytes) -> tuple[Model, SpanCache]:
    def make():
        model = pickle.loads(packed_model)
        return model, model.cache()

    return worker_resource(packed_model, make)


def score(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",), column: str = "toxicity") -> DataFrame:
    """The ``keep`` columns of docs and ``column``, the score of the column ``text``."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(column, T.DoubleType())])

    def run(batches):
        found, cache = opened(shared.value)
        for batch in batches:
            for at, texts in text_slices(batch):
                rows = batch.slice(at, len(texts))
                scores = pa.array(found.scores(texts, cache))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), scores], names=[*keep, column])

    return map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows that score at least ``threshold``."""
    packed_model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        found, cache = opened(packed_model.value)
        for batch in batches:
            for at, texts in text_slices(batch):
                yield batch.slice(at, len(texts)).filter(pa.array(found.scores(texts, cache) < threshold))

    return map_arrow(docs, run, docs.schema)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The production model: trained on labels outside the held-out fold."""
    texts, found = labelled_sample(docs, labels, "toxic", remainder("doc_id", FOLDS) != HELD_OUT, TRAIN_MOST)
    texts.reverse()
    return train((texts.pop() for _ in range(len(texts))), found)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    model = fitted(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"], "score").select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
