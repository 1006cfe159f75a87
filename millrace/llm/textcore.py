"""Whole-array text handling for Python tasks: code points, runs, span hashes, and a bounded cache of distinct spans.

Texts are handled in slices of a few million code points, so memory doesn't follow the batch or partition; one text
longer than that makes a slice of its own. Nothing is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_CHARS = 1 << 20
SLICE_TEXTS = 400
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers modulo 2**64 of the multiplier ("up") or of its inverse ("down")."""
    if len(_powers[kind]) < n:
        base = _MULTIPLIER if kind == "up" else np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        grown = np.full(max(n, SLICE_CHARS + (1 << 14)), base, np.uint64)
        grown[0] = 1
        _powers[kind] = np.multiply.accumulate(grown)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Packed:
    """Some texts as one array of code points; text i is cps[bounds[i]:bounds[i + 1]]."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.joined = "".join(texts)
        self.bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=self.bounds[1:])
        self.cps = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)

    def runs(self, inside: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of True that cross no text's bounds, and no True of ``cut``."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.empty(n, bool)
        first[0] = True
        np.logical_not(inside[:-1], out=first[1:])
        last = np.empty(n, bool)
        last[-1] = True
        np.logical_not(inside[1:], out=last[:-1])
        if cut is not None:
            first |= cut
            last[:-1] |= cut[1:]
        edges = self.bounds[:-1]
        first[edges[edges < n]] = True
        edges = self.bounds[1:]
        last[edges[edges > 0] - 1] = True
        return np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span's code points and length."""
        n = len(self.cps)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.cps.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _power("down", n + 1)[starts]
        return mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(44)))

    def counts(self, starts: np.ndarray) -> np.ndarray:
        """How many of the ascending span starts each text has."""
        return np.diff(np.searchsorted(starts, self.bounds))


def packed(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int, Packed]]:
    """(i, j, texts[i:j] packed) in slices of at most ``limit`` code points or one text."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > limit:
            yield i, j, Packed(texts[i:j])
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts), Packed(texts[i:])


def texts_of(column: pa.Array) -> list[str]:
    """A text column's values; null is the empty string."""
    return [t or "" for t in column.to_pylist()]


def text_slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch in slices of at most SLICE_TEXTS rows and about SLICE_CHARS bytes, or one row.

    A batch can hold tens of megabytes; only a slice of it is ever made into Python strings.
    """
    column = batch.column(name)
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(size, dtype=np.int64), 0
    while at < len(size):
        before = total[at - 1] if at else 0
        stop = min(max(at + 1, int(np.searchsorted(total, before + SLICE_CHARS, "right"))), at + SLICE_TEXTS)
        yield at, texts_of(column.slice(at, stop - at))
        at = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all spans, one span after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    if not len(s):
        return np.zeros(0, np.int64)
    out[0] = s[0]
    at = np.cumsum(n)[:-1]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, position of one of each, number of the value at every position)."""
    codes, values = pd.factorize(hashes)
    where = np.empty(len(values), np.int64)
    where[codes] = np.arange(len(codes))
    return np.asarray(values, np.uint64), where, codes


class SpanCache:
    """Distinct spans and what was computed for them: several ragged arrays, one row a span.

    At most about ``limit`` spans stay: beyond it, the half that most slices had stays, so memory is bounded for any
    vocabulary. What is dropped is computed again when met.
    """

    def __init__(self, compute: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]], limit: int = 250_000):
        self.compute, self.limit = compute, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.hashes, self.hits = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

    def shrink(self) -> None:
        keep = np.sort(np.argsort(-self.hits, kind="stable")[: self.limit // 2])
        got = [self.gather(k, keep) for k in range(len(self.parts or ()))]
        self.hashes, self.hits = self.hashes[keep], self.hits[keep] // 2
        self.index = dict(zip(self.hashes.tolist(), range(len(keep))))
        self.parts = [(np.cumsum(n) - n, n, flat) for n, flat in got]

    def rows(self, pack: Packed, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache's row of each span; rows hold until the next call."""
        values, where, codes = distinct(pack.span_hash(starts, ends))
        if len(self.index) > self.limit:
            self.shrink()
        found = np.fromiter(map(self.index.get, values.tolist(), [-1] * len(values)), np.int64, len(values))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            joined = pack.joined
            at = where[missing]
            new = [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            first = len(self.index)
            found[missing] = np.arange(first, first + len(missing))
            self.index.update(zip(values[missing].tolist(), range(first, first + len(missing))))
            self.hashes = np.concatenate([self.hashes, values[missing]])
            self.hits = np.concatenate([self.hits, np.zeros(len(missing), np.int64)])
            got = self.compute(new)
            if self.parts is None:
                self.parts = [(np.cumsum(n) - n, n, flat) for n, flat in got]
            else:
                self.parts = [
                    (np.concatenate([offs, np.cumsum(n) - n + len(old)]), np.concatenate([lens, n]), np.concatenate([old, flat]))
                    for (offs, lens, old), (n, flat) in zip(self.parts, got)
                ]
        self.hits[found] += 1
        return found[codes]

    def gather(self, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length of each row's array, all those arrays one after the other) of the k-th kind."""
        if self.parts is None:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        offs, lens, flat = self.parts[k]
        n = lens[rows]
        return n, flat[ragged(offs[rows], n)]


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each text's stretch of values, given how many each text has."""
    sums = np.cumsum(values)
    total = np.concatenate([np.zeros(1, sums.dtype), sums])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
