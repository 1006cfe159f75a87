"""Byte-level BPE encoding and decoding of whole texts, with DuckDB's recursive queries in each task.

A text is cut into the matches of the tokenizer's pattern by code-point classes, over whole arrays. A task hands the
distinct matches it hasn't met to DuckDB: rows (word, position, id) join the merge table, each word's leftmost pair
of least rank is contracted, until no word has a pair that merges; an ordered aggregation decodes the ids. Texts
never leave their task: no shuffle. Memory: one slice of text, and a bounded cache of distinct matches.

A step costs as much as its words have ids left, and a word takes as many steps as it has merges. So a match of more
than ``LONG`` bytes is given to the recursion as pieces that overlap by half, each a word of its own, which are put
together where two neighbours begin the same id at the same byte. That is exact: a sequence of ids is what the merges
make of its bytes if, and only if, that holds for each two neighbours in it (a merge over a bound between two ids would
be the next in those two alone as well, since they shrink in the same order there), and each two neighbours stand side
by side in one piece. Pieces that share no such place are made four times as long, up to the whole match.

Defined cases: a null or empty text has no ids, and decodes to nothing; a null doc_id stays null; repeated rows give
repeated rows; an empty table gives none; further columns are ignored by the query and kept by ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, read_table, worker_resource
from .textcore import Packed, SpanCache, packed, sums_by_text, text_slices

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words, and bytes of them, given to DuckDB at a time.
WORDS_AT_ONCE, BYTES_AT_ONCE = 30_000, 1 << 20
#: Longer words are put together from pieces of at first so many bytes.
LONG = 128
# Classes of code points.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

ENCODE = """
with recursive step(w, pos, id, done) as (
  select w, pos, id, false from word_bytes
  union all
  (with cur as (select w, pos, id from step where not done),
   best as (
     select a.w, min(m.rank::bigint * 16777216 + a.pos) as best
     from cur a join cur b on b.w = a.w and b.pos = a.pos + 1 join merges m on m.pair = a.id::bigint * 1048576 + b.id
     group by a.w)
   select c.w, (case when c.pos > best % 16777216 then c.pos - 1 else c.pos end)::int,
     case when c.pos = best % 16777216 then (best // 16777216)::int else c.id end, best is null
   from cur c left join best on best.w = c.w
   where best is null or c.pos <> best % 16777216 + 1)
)
select w, pos, id from step where done order by w, pos
"""
DECODE = "select w, string_agg(hex, '' order by pos) as hex from ids join vocab using (id) group by w order by w"


@lru_cache(maxsize=2)
def load_ranks(name: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a rank file by path, or by name among the public tokenizers' files."""
    import os

    import public_tokenizers

    path = name if os.sep in name else public_tokenizers.path(name)
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    found = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            found[m.start() : m.end()] = kind
    return found


def matches(pack: Packed) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pattern's matches in all texts; they cover every code point.

    The pattern: a contraction ('s 't 're 've 'm 'll 'd); else letters, numbers, or others with a space before; else
    white space, which leaves its last character to what follows.
    """
    cps, n = pack.cps, len(pack.cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cps]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    begins = pack.bounds[:-1]
    begins = begins[begins < n]
    start[begins] = True
    text_first = np.zeros(n + 1, bool)
    text_first[begins] = True
    text_first[n] = True
    # The last character of white space that something follows: a match by itself or with what follows.
    run_end = np.flatnonzero(start[1:] & ~text_first[1:n] & (kind[:-1] == SPACE)) if n > 1 else np.zeros(0, np.int64)
    start[run_end] = True
    plain = run_end[cps[run_end] == 32]
    start[plain + 1] = False
    # Contractions start a match at an apostrophe that stands alone; the rest of the letters is another match.
    quote = np.flatnonzero(cps == 39)
    quote = quote[start[quote] & (quote + 1 < n)]
    quote = quote[~text_first[quote + 1]]
    if len(quote):
        one = cps[quote + 1]
        after = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~text_first[np.minimum(quote + 2, n)], cps[after], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((short, 2), (long & ~short, 3)):
            q = quote[hit]
            start[q + 1] = False
            tail = q + size
            tail = tail[tail < n]
            # What follows the contraction starts a match; white space's own bounds are set already.
            tail = tail[kind[tail] != SPACE]
            start[tail] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


class Coder:
    """Encodes and decodes words by DuckDB; one for each worker process."""

    def __init__(self, name: str = RANKS):
        import duckdb

        ranks = load_ranks(name)
        pairs, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left * 1048576 + right)
                    merged.append(rank)
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = list(map(len, ranks))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merge_rows = pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(merged, pa.int32())})
        vocab_rows = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [k.hex() for k in ranks]})
        self.con.register("merge_rows", merge_rows)
        self.con.register("vocab_rows", vocab_rows)
        self.con.execute("create table merges as from merge_rows")
        self.con.execute("create table vocab as from vocab_rows")
        self.con.unregister("merge_rows")
        self.con.unregister("vocab_rows")

    def contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids), by the recursion."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        w = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        pos = (np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
        self.con.register("word_bytes", pa.table({"w": w, "pos": pos, "id": self.byte[flat]}))
        ids = self.con.sql(ENCODE).to_arrow_table()
        self.con.unregister("word_bytes")
        return np.bincount(ids["w"].to_numpy(), minlength=len(words)), ids["id"].to_numpy()

    def groups(self, words: list[bytes]) -> Iterator[list[bytes]]:
        """The words in order, as many at a time as DuckDB takes."""
        some, size = [], 0
        for word in words:
            if some and (len(some) == WORDS_AT_ONCE or size + len(word) > BYTES_AT_ONCE):
                yield some
                some, size = [], 0
            some.append(word)
            size += len(word)
        if some:
            yield some

    def long(self, word: bytes, piece: int = LONG) -> np.ndarray:
        """The ids of a long word, from pieces."""
        while piece < len(word):
            half = piece // 2
            starts = range(0, len(word) - half, half)
            counts, ids = (np.concatenate(x) for x in zip(*map(self.contracted, self.groups([word[s : s + piece] for s in starts]))))
            found = self.joined(np.arange(len(starts)) * half, counts, ids)
            if found is not None:
                return found
            piece *= 4
        return self.contracted([word])[1]

    def joined(self, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray | None:
        """The ids of pieces that begin at ``starts``, put together at the first id that each has in common with the
        one before it; None if some piece has none."""
        of = np.repeat(np.arange(len(starts)), counts)
        first = np.cumsum(counts) - counts
        size = self.length[ids]
        before = np.cumsum(size) - size
        at = starts[of] + before - before[first][of]
        out, low = [], 0
        for k in range(len(starts) - 1):
            here, there = slice(first[k], first[k] + counts[k]), slice(first[k + 1], first[k + 1] + counts[k + 1])
            _, a, b = np.intersect1d((at[here] << 32) | ids[here], (at[there] << 32) | ids[there], assume_unique=True, return_indices=True)
            if not len(a):
                return None
            out.append(ids[low : first[k] + a[0]])
            low = first[k + 1] + b[0]
        return np.concatenate([*out, ids[low:]])

    def decoded(self, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of bytes of each word, all bytes) from the ids."""
        w = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        pos = (np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        self.con.register("ids", pa.table({"w": w, "pos": pos, "id": ids}))
        rows = self.con.sql(DECODE).to_arrow_table()
        self.con.unregister("ids")
        back = [bytes.fromhex(x) for x in rows["hex"].to_pylist()]
        n_bytes = np.zeros(len(counts), np.int64)
        n_bytes[rows["w"].to_numpy()] = np.fromiter(map(len, back), np.int64, len(back))
        return n_bytes, np.frombuffer(b"".join(back), np.uint8)

    def some(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        short = [k for k, x in enumerate(words) if len(x) <= LONG]
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        if short:
            n, ids = self.contracted([words[k] for k in short])
            if len(short) < len(words):
                for k, x in zip(short, np.split(ids, np.cumsum(n)[:-1])):
                    parts[k] = x
        if len(short) < len(words):
            for k, x in enumerate(words):
                if len(x) > LONG:
                    parts[k] = self.long(x)
            n, ids = np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)
        n_bytes, back = self.decoded(n, ids)
        return n, ids.astype(np.uint32), n_bytes, back

    def __call__(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of each word), (decoded bytes of each word), as lengths and one flat array each."""
        got = [self.some(group) for group in self.groups([x.encode("utf-8", "surrogatepass") for x in words])]
        n_ids, ids, n_bytes, back = (np.concatenate(x) for x in zip(*got))
        return [(n_ids, ids), (n_bytes, back)]


def worker_cache(name: str) -> SpanCache:
    return worker_resource(("byte-bpe", name), lambda: SpanCache(Coder(name)))


def encode_texts(texts: list[str], name: str = RANKS) -> Iterator[tuple[np.ndarray, bytes]]:
    """(ids, decoded bytes) of each text, in order."""
    cache = worker_cache(name)
    for _, _, pack in packed(texts):
        starts, ends = matches(pack)
        rows = cache.rows(pack, starts, ends)
        counts = pack.counts(starts)
        n, ids = cache.gather(0, rows)
        id_ends = np.cumsum(sums_by_text(n, counts)) if len(rows) else np.zeros(len(pack.texts), np.int64)
        n, back = cache.gather(1, rows)
        back_ends = np.cumsum(sums_by_text(n, counts)) if len(rows) else np.zeros(len(pack.texts), np.int64)
        del n
        a = b = 0
        for c, d in zip(id_ends.tolist(), back_ends.tolist()):
            yield ids[a:c], back[b:d].tobytes()
            a, b = c, d


def encode(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """docs' columns with ``ids`` (array of int) and ``decoded`` (binary) for the column ``text``.

    Input columns of these two names give way to them; all others stay.
    """
    from pyspark.sql import types as T

    fields = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    plain = docs.select(*[f"`{f.name.replace('`', '``')}`" for f in fields])
    out = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch):
                rows = batch.slice(at, len(texts))
                got = list(encode_texts(texts, name))
                offsets = np.zeros(len(got) + 1, np.int32)
                np.cumsum([len(x) for x, _ in got], out=offsets[1:])
                flat = np.concatenate([x for x, _ in got]).astype(np.int32) if got else np.zeros(0, np.int32)
                arrays = [*rows.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([b for _, b in got], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names, "ids", "decoded"])

    return map_arrow(plain, run, out)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            n, ids_hex, back_hex = [], [], []
            for _, texts in text_slices(batch):
                for ids, back in encode_texts(texts):
                    n.append(len(ids))
                    ids_hex.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    back_hex.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(back_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_arrow(docs, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
