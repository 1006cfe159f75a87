"""Personal data: base patterns in linear time, and a skip-chain conditional random field over each document.

Base patterns (email, ip, card, phone) are found over whole arrays of code points: leftmost, non-overlapping within a
kind, checked once (parts at most 255; 13 to 19 digits that pass Luhn; 9 to 15 digits), failing matches dropped.

The field has a variable for each token (run without white space) that has a digit or ``@``; every other token has the
label O for certain, so it cuts the chain and needs no variable. Labels: O and the four kinds. Potentials: what a token
looks like and which base match it is in; neighbouring tokens; and skip edges between a token and the next one in the
document with the same letters and digits, or with the same last seven digits, and between a token and the first one so
alike that is in a base match: the match reaches each mention in one step, however many there are and however far they
lie. Tokens of base matches have their label for certain, so mentions don't outvote a match. Edges grow with the tokens,
however often one recurs. Marginals are by loopy message passing over all of a slice's documents at once, until nothing
changes (in training, ROUNDS rounds). Weights are trained in numpy by gradient ascent on a bounded sample (``TRAIN_MOST``
documents), where base matches are the labels, and so are spellings of them that no pattern matches, put at the ends of
the sample's texts beside random numbers in the same spellings; at times a token's base match is hidden from it.

Runs of neighbouring tokens that have one kind with a marginal of at least ``SURE``, and touch no base match, are
added spans of that kind. Base spans always stay. Texts stay in their tasks; there is no shuffle.

Defined cases: a null text is the empty text, which has no spans; a null doc_id stays null; repeated rows give
repeated rows; an empty table gives no rows; further columns are ignored; offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, worker_resource
from .textcore import Packed, text_slices

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
TRAIN_MOST, STEPS, RATE, PENALTY, SEED = 4000, 300, 0.3, 1e-4, 5
ROUNDS, DAMPING, SETTLED, SURE = 8, 0.3, 1e-4, 0.5
# TRAIN_MOST bounds unlabelled documents: base matches and spellings of them are their labels.
#: What the label of a base match has before other labels: more than any number of mentions weighs.
CERTAIN = 1e9
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def _set(chars: str) -> np.ndarray:
    found = np.zeros(129, bool)
    found[[ord(c) for c in chars]] = True
    return found


_ALNUM = "".join(chr(c) for c in range(128) if chr(c).isalnum())
_DIGITS, _LOCAL, _PHONE = _set("0123456789"), _set(_ALNUM + "._%+-"), _set(" ().-0123456789")
_BLANK = _set(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")
_CUES = {"email": 0, "mail": 0, "ip": 1, "host": 1, "card": 2, "visa": 2, "phone": 3, "tel": 3, "call": 3, "mobile": 3}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def chains(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) numbers of the maximal groups of items in which each is linked to the next."""
    n = len(linked) + 1
    return np.concatenate([[0], np.flatnonzero(~linked) + 1]), np.concatenate([np.flatnonzero(~linked), [n - 1]])


def base_spans(pack: Packed) -> list[list[tuple[int, int, int]]]:
    """For each text, the surviving base matches (kind, start, end), by kind, then start."""
    cps, joined, bounds = pack.cps, pack.joined, pack.bounds
    n, low = len(cps), np.minimum(cps, 128)
    out: list[list[tuple[int, int, int]]] = [[] for _ in pack.texts]
    if not n:
        return out
    digit = _DIGITS[low]
    hits: list[list[tuple[int, int]]] = [[], [], [], []]

    at_signs = np.flatnonzero(cps == 64)
    if len(at_signs):
        text_start = bounds[np.searchsorted(bounds, at_signs, "right") - 1]
        text_end = bounds[np.searchsorted(bounds, at_signs, "right")]
        outside = np.flatnonzero(~_LOCAL[low])
        before = np.searchsorted(outside, at_signs)  # the sign itself is outside
        run = np.where(before > 0, outside[np.maximum(before - 1, 0)] + 1, 0)
        done = 0
        for i, first, end in zip(at_signs.tolist(), np.maximum(run, text_start).tolist(), text_end.tolist()):
            first = max(first, done)
            if first < i and (m := _DOMAIN.match(joined, i + 1, end)):
                hits[0].append((first, m.end()))
                done = m.end()

    starts, ends = pack.runs(digit)
    if len(starts):
        gap = starts[1:] - ends[:-1]
        same = np.searchsorted(bounds, starts[1:], "right") == np.searchsorted(bounds, starts[:-1], "right")
        between = cps[np.minimum(ends[:-1], n - 1)]
        first, last = chains(same & (gap == 1) & (between == 46))
        for a, b in zip(first[last - first >= 3].tolist(), last[last - first >= 3].tolist()):
            for g in range(a, b - 2, 4):
                parts = [joined[starts[k] : ends[k]].lstrip("0") for k in range(g, g + 4)]
                if all(len(p) < 4 and int(p or "0") <= 255 for p in parts):
                    hits[1].append((int(starts[g]), int(ends[g + 3])))
        first, last = chains(same & (gap == 1) & ((between == 32) | (between == 45)))
        total = np.concatenate([[0], np.cumsum(ends - starts)])
        size = total[last + 1] - total[first]
        fits = (size >= 13) & (size <= 19)
        for a, b in zip(first[fits].tolist(), last[fits].tolist()):
            if luhn("".join(joined[starts[k] : ends[k]] for k in range(a, b + 1))):
                hits[2].append((int(starts[a]), int(ends[b])))

    plus = np.flatnonzero(cps == 43)
    if len(plus):
        text_end = bounds[np.searchsorted(bounds, plus, "right")]
        follows = plus + 1 < text_end
        plus, text_end = plus[follows], text_end[follows]
        real = digit[plus + 1]
        plus, text_end = plus[real], text_end[real]
    if len(plus):
        outside = np.append(np.flatnonzero(~_PHONE[low]), n)
        stop = np.minimum(outside[np.searchsorted(outside, plus + 2)], text_end)
        digits = np.flatnonzero(digit)
        final = digits[np.searchsorted(digits, stop) - 1]  # the digit after the sign at least
        size = np.searchsorted(digits, final, "right") - np.searchsorted(digits, plus)
        for p, f, d in zip(plus.tolist(), final.tolist(), size.tolist()):
            if f >= p + 3 and 9 <= d <= 15:
                hits[3].append((p, f + 1))

    for kind, found in enumerate(hits):
        if found:
            text = np.searchsorted(bounds, np.array([a for a, _ in found]), "right") - 1
            for t, (a, b) in zip(text.tolist(), found):
                out[t].append((kind, a - int(bounds[t]), b - int(bounds[t])))
    return out


class Tokens:
    """The field's variables for some texts: places, looks, labels by base matches, and edges."""

    def __init__(self, pack: Packed, base: list[list[tuple[int, int, int]]]):
        low = np.minimum(pack.cps, 128)
        starts, ends = pack.runs(~(_BLANK[low] | (pack.cps == 0xA0)))
        live = np.concatenate([[0], np.cumsum(_DIGITS[low] | (pack.cps == 64))])
        active = np.flatnonzero(live[ends] > live[starts]) if len(starts) else np.zeros(0, np.int64)
        self.text, self.start, self.end, self.base = [], [], [], []
        words, order, cues = [], [], []
        text_of = np.searchsorted(pack.bounds, starts[active], "right") - 1
        for k, t, a, b in zip(active.tolist(), text_of.tolist(), starts[active].tolist(), ends[active].tolist()):
            raw = pack.joined[a:b]
            lead = len(raw) - len(raw.lstrip("\"'`#$%&*,;:!?.<>[]{}|=/\\_~^-"))
            word = raw[lead:].rstrip("\"'`#$%&*,;:!?.<>[]{}|=/\\_~^-+(")
            if not word:
                continue
            self.text.append(t)
            offset = int(pack.bounds[t])
            self.start.append(a + lead - offset)
            self.end.append(a + lead - offset + len(word))
            words.append(word)
            order.append(k)
            cue = pack.joined[starts[k - 1] : ends[k - 1]].lower().strip(":=#.,") if k and starts[k - 1] >= offset and ends[k - 1] - starts[k - 1] < 12 else ""
            cues.append(_CUES.get(cue, -1))
        self.size, self.bounds = len(words), pack.bounds
        self.label = np.zeros(self.size, np.int64)
        self.mark(base)
        self.looks = np.array([looks(w, c) for w, c in zip(words, cues)], np.float32).reshape(self.size, LOOKS)
        near = [i for i in range(1, self.size) if order[i] == order[i - 1] + 1 and self.text[i] == self.text[i - 1]]
        skips, seen, matched, alike = [], {}, {}, []
        for i, w in enumerate(words):
            plain = "".join(c for c in w.lower() if c.isalnum())
            digits = "".join(c for c in plain if c in "0123456789")
            keys = {("a", plain)} if len(plain) >= 4 else set()
            if len(digits) >= 7:
                keys.add(("d", digits[-7:]))
            for key in keys:
                before = seen.get((self.text[i], key))
                if before is not None:
                    skips.append((before, i))
                seen[self.text[i], key] = i
                alike.append((i, (self.text[i], key)))
                if self.label[i]:
                    matched.setdefault((self.text[i], key), i)
        skips += [(min(i, m), max(i, m)) for i, key in alike if not self.label[i] and (m := matched.get(key)) is not None]
        skips = sorted(set(skips))
        self.u = np.array([i - 1 for i in near] + [a for a, _ in skips], np.int64)
        self.v = np.array(near + [b for _, b in skips], np.int64)
        self.kind = np.array([0] * len(near) + [1] * len(skips), np.int64)

    def mark(self, base: list[list[tuple[int, int, int]]]) -> None:
        """The label of the base match that a token touches; of several, that of the one that starts last."""
        offset = self.bounds[np.array(self.text, np.int64)]
        starts, ends = np.array(self.start, np.int64) + offset, np.array(self.end, np.int64) + offset
        begin, stop = np.full(self.size, -1), np.full(self.size, -1)
        for kind in range(len(KINDS)):
            spans = np.array([(a + low, b + low) for low, found in zip(self.bounds.tolist(), base) for k, a, b in found if k == kind], np.int64).reshape(-1, 2)
            if not len(spans):
                continue
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            # A kind's matches don't overlap, so only the last that starts before the token's end can touch it.
            last = np.searchsorted(spans[:, 0], ends) - 1
            a, b = spans[np.maximum(last, 0)].T
            later = (last >= 0) & (b > starts) & ((a > begin) | ((a == begin) & (b >= stop)))
            self.label[later], begin[later], stop[later] = kind + 1, a[later], b[later]


LOOKS = 26


def looks(word: str, cue: int) -> list[float]:
    """What a token looks like, as LOOKS numbers of 0 or 1."""
    digits = [c for c in word if c in "0123456789"]
    n = len(digits)
    letters = sum(c.isalpha() for c in word)
    dots, at = word.count("."), word.count("@")
    four = word.split(".")
    found = [
        1.0, at == 1, at == 1 and "." in word.split("@")[-1], at > 1,
        dots == 3 and len(four) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in four if p.isascii()) and all(four),
        0 < dots != 3, n <= 2, n == 3, n == 4, 5 <= n <= 6, n == 7, 8 <= n <= 9, 10 <= n <= 12, 13 <= n <= 19, n > 19,
        13 <= n <= 19 and letters == 0 and luhn("".join(digits)), word[0] == "+", "(" in word or ")" in word, "-" in word,
        letters > 0, letters > 3 and at == 0, "=" in word or '"' in word,
        *(cue == k for k in range(4)),
    ]
    return [float(x) for x in found]


class Field:
    """Weights: what a token looks like, the base match it is in, and the two kinds of edges."""

    def __init__(self):
        self.look = np.zeros((LOOKS, LABELS))
        self.match = np.zeros((LABELS, LABELS))
        self.edge = np.stack([0.0 * np.eye(LABELS), 1.0 * np.eye(LABELS)])

    def unary(self, tokens: Tokens, shown: np.ndarray) -> np.ndarray:
        known = np.where((tokens.label > 0)[:, None], CERTAIN * np.eye(LABELS)[tokens.label], self.match[tokens.label])
        return tokens.looks @ self.look + np.where(shown[:, None], known, 0.0)

    def marginals(self, tokens: Tokens, shown: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of tokens, of edges) by loopy message passing in the log domain, until nothing changes.

        An edge's messages are made again while messages at its ends change by more than SETTLED; loops that never
        settle stop after ROUNDS and twice as many rounds as their text has tokens. ``rounds`` is a limit below that.
        """
        unary = self.unary(tokens, shown)
        u, v, pair = tokens.u, tokens.v, self.edge[tokens.kind]
        forth, back = np.zeros((len(u), LABELS)), np.zeros((len(u), LABELS))
        belief = unary.copy()
        text = np.array(tokens.text, np.int64)
        limit = ROUNDS + 2 * np.bincount(text)[text[u]] if len(u) else np.zeros(0, np.int64)
        limit = limit if rounds is None else np.minimum(limit, rounds)
        on, done = np.arange(len(u)), 0
        while len(on):
            a, b = u[on], v[on]
            out = log_sum(belief[a][:, :, None] - back[on][:, :, None] + pair[on], 1)
            home = log_sum(belief[b][:, None, :] - forth[on][:, None, :] + pair[on], 2)
            more_forth = (1 - DAMPING) * (out - out.max(1, keepdims=True) - forth[on])
            more_back = (1 - DAMPING) * (home - home.max(1, keepdims=True) - back[on])
            forth[on] += more_forth
            back[on] += more_back
            np.add.at(belief, b, more_forth)
            np.add.at(belief, a, more_back)
            moved = np.zeros(len(unary), bool)
            change = np.maximum(np.abs(more_forth).max(1), np.abs(more_back).max(1)) > SETTLED
            moved[a[change]] = moved[b[change]] = True
            done += 1
            on = np.flatnonzero((moved[u] | moved[v]) & (done < limit))
        joint = belief[u][:, :, None] - back[:, :, None] + belief[v][:, None, :] - forth[:, None, :] + pair
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        single = np.exp(belief - belief.max(1, keepdims=True))
        return single / single.sum(1, keepdims=True), joint / joint.sum((1, 2), keepdims=True)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def altered(kind: int, value: str, rng: np.random.Generator) -> str:
    """Another way to write a base match that no base pattern matches."""
    if kind == 0:
        return value.replace(".", "-")
    if kind == 1:
        return value.replace(".", "-")
    digits = "".join(c for c in value if c in "0123456789")
    if kind == 2:
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}" if rng.random() < 0.5 else f"{digits[-7:-4]}-{digits[-4:]}"


def ordinary(rng: np.random.Generator) -> str:
    """A token with digits that is nobody's: counts, years, times, dates, versions, amounts, ordinals, numbers."""
    a, b, c = (int(x) for x in rng.integers(0, 60, 3))
    forms = (f"{a}", f"{1900 + 2 * a}", f"{a:02d}:{b:02d}", f"{1990 + b % 40}-{1 + a % 12:02d}-{1 + c % 28:02d}", f"v{a}.{b}.{c}", f"{a}.{b:02d}", f"x{a}", f"{a}th", f"{a},{100 + b}", f"{a}%", str(int(rng.integers(10**4, 10**9))))
    return forms[int(rng.integers(len(forms)))]


def lessons(texts: list[str], rng: np.random.Generator) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Texts with further mentions at their ends, and the spans of the mentions that are personal.

    Half of the texts with base matches get another spelling of each match, which is personal; all of them, and as
    many without, get the same spellings of other, random numbers, which are not.
    """
    base = [spans for i in range(0, len(texts), 400) for spans in base_spans(Packed(texts[i : i + 400]))]
    out, marks = [], []
    for text, spans in zip(texts, base):
        found: list[tuple[int, int, int]] = []
        own = text
        for kind, a, b in spans[:4]:
            if rng.random() < 0.5:
                again = altered(kind, own[a:b], rng)
                text += " und "
                found.append((kind, len(text), len(text) + len(again)))
                text += again
            other = "".join(str(rng.integers(10)) if c in "0123456789" else c for c in altered(kind, own[a:b], rng))
            other = other if kind else other.replace("@", str(rng.integers(10)))
            text += f" que {other} the" * int(rng.integers(1, 4))
        text += "".join(f" {ordinary(rng)}{' de' * int(rng.integers(2))}" for _ in range(3))
        out.append(text)
        marks.append(found)
    return out, marks


def train(texts: list[str], steps: int = STEPS, seed: int = SEED) -> Field:
    """A field fitted to the base matches of some texts, and to mentions that repeat them."""
    field = Field()
    rng = np.random.default_rng(seed)
    texts, again = lessons(texts, rng)
    pack = Packed(texts)
    base = base_spans(pack)
    tokens = Tokens(pack, base)
    if not tokens.size:
        return field
    evidence = tokens.label.copy()
    tokens.mark([b + a for b, a in zip(base, again)])
    truth = np.eye(LABELS)[tokens.label]
    tokens.label = evidence
    pairs = truth[tokens.u][:, :, None] * truth[tokens.v][:, None, :]
    moments = [np.zeros_like(w) for w in (field.look, field.match, field.edge)]
    for step in range(steps):
        shown = rng.random(tokens.size) < 0.97
        single, joint = field.marginals(tokens, shown, ROUNDS)
        error = (truth - single) / tokens.size
        edge_error = (pairs - joint) / tokens.size
        gradients = (
            tokens.looks.T @ error,
            np.stack([error[shown & (evidence == y)].sum(0) for y in range(LABELS)]),
            np.stack([edge_error[tokens.kind == k].sum(0) for k in (0, 1)]),
        )
        for w, g, m in zip((field.look, field.match, field.edge), gradients, moments):
            g = g - PENALTY * w / 10
            m += 0.05 * (g * g - m)
            w += RATE * (1 - step / steps) * g / (np.sqrt(m / (1 - 0.95 ** (step + 1))) + 1e-6)
    field.edge[1] = (field.edge[1] + field.edge[1].T) / 2
    return field


def find(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text (base spans, added spans), each (kind, start, end)."""
    pack = Packed(texts)
    base = base_spans(pack)
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    tokens = Tokens(pack, base)
    if tokens.size:
        single, _ = field.marginals(tokens, np.ones(tokens.size, bool))
        label = np.where(single.max(1) >= SURE, single.argmax(1), 0)
        label[tokens.label > 0] = 0  # base matches stay as they are
        joined = set(tokens.v[tokens.kind == 0].tolist())
        last = -2
        for i in np.flatnonzero(label).tolist():
            t, kind = tokens.text[i], int(label[i]) - 1
            if i == last + 1 and i in joined and added[t] and added[t][-1][0] == kind and added[t][-1][2] == tokens.end[last]:
                added[t][-1] = (kind, added[t][-1][1], tokens.end[i])
            else:
                added[t].append((kind, tokens.start[i], tokens.end[i]))
            last = i
    return list(zip(base, added))


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    out, at, i = [], 0, 0
    ordered = sorted(spans, key=lambda s: (s[1], -s[2]))
    while i < len(ordered):
        kind, a, b = ordered[i]
        i += 1
        while i < len(ordered) and ordered[i][1] < b:
            b = max(b, ordered[i][2])
            i += 1
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def fitted(docs: DataFrame, most: int = TRAIN_MOST) -> Field:
    """The field trained on at most ``most`` documents, chosen by hashes of their ids."""
    every = max(1, -(-docs.count() // most))
    some = docs.filter("doc_id is not null and text is not null").filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).filter(F.col("text").rlike("[0-9@]"))
    rows = some.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(most).collect()
    return train([r["text"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs, all columns, with every span of ``text`` masked; ``n_chars``, if there, is the new length."""
    packed_field = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field))
    names = docs.columns

    def run(batches):
        for batch in batches:
            found = opened(packed_field.value)
            for at, texts in text_slices(batch):
                part = batch.slice(at, len(texts))
                column = part.column("text")
                clean = [None if not column[i].is_valid else masked(t, b + a) if b or a else t for i, (t, (b, a)) in enumerate(zip(texts, find(texts, found)))]
                new = {"text": pa.array(clean, column.type)}
                if "n_chars" in names:
                    kind = part.column("n_chars").type
                    new["n_chars"] = pa.array([None if c is None else len(c) for c in clean], kind)
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in names], names=names)

    return map_arrow(docs, run, docs.schema)


def opened(packed_field: bytes) -> Field:
    return worker_resource(packed_field, lambda: pickle.loads(packed_field))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    packed_field = spark.sparkContext.broadcast(pickle.dumps(fitted(docs)))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        for batch in batches:
            field = opened(packed_field.value)
            for at, texts in text_slices(batch):
                rows = []
                for base, added in find(texts, field):
                    counts = np.bincount([k for k, _, _ in base], minlength=len(KINDS)).tolist() if base else [0] * len(KINDS)
                    rows.append((*counts, hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(base + added), len(added)))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return map_arrow(docs, run, "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint")
