"""Token-ID shards: independent zstandard frames, a trailing seek table, and a checksum for every frame.

A shard holds documents in ascending doc_id order. Its ids are little-endian unsigned 32-bit integers, cut into
frames at document bounds (a document larger than a frame has a frame of its own). After the frames stand two
skippable frames: the document index (doc ids, null marks, token counts), and the seek table, whose last nine bytes
say how many entries it has. The seek table has each frame's compressed size, decompressed size, and the low 32 bits
of the XXH64 of its content, so a reader fetches, decompresses and verifies only the frames of the documents it wants.

A shard has about ``SHARD_BYTES`` of text and at most about ``SHARD_DOCS`` documents, whatever the table's size, so
neither its writer nor the reader of its document index grows with the table. Rows are dealt to shards by ranges of
doc_id and, within one, of the text's hash, so that many rows with one doc_id, or none, don't share a shard.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first; rows with equal doc_id are
ordered by their text's hash, then by text; an empty table writes one shard without documents, and reads back no rows;
further columns are ignored; the tokenizer's added tokens are one id each where their strings stand in a text, as the
library has it.
A shard appears whole or not at all, and a task that runs again writes the same bytes under the same name.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicFile, file_system, map_arrow, new_dir, read_table, text_or_empty, worker_resource
from .textcore import Packed, SpanCache, packed, sums_by_text, text_slices

TOKENIZER, END_ID = "word_bpe_49k.json", 2
FRAME_TOKENS = 1 << 16
#: About the bytes of text, and the documents, of a shard.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 250_000
# Fixed values of the zstandard format and its seekable variant.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, HAS_CHECKSUM = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
# White space that separates words whatever the tokenizer's normaliser does: both its rules and its pattern end there.
# So they do between an ASCII letter and these marks; the apostrophe isn't one, as contractions begin with it.
GAPS, MARKS = " \t\n\r", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
GAP, LETTER, MARK = 1, 2, 3
#: Words that the tokenizer gets as one input.
WORDS_AT_ONCE = 256


@lru_cache(maxsize=1)
def tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))


@lru_cache(maxsize=1)
def added_tokens(name: str) -> list[str]:
    """Strings that the tokenizer knows as one token wherever they stand in a text, in lower case."""
    return sorted({t.content.lower() for t in tokenizer(name).get_added_tokens_decoder().values()})


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """What each ASCII code point is to the cutting of words; the last entry stands for all others."""
    found = np.zeros(129, np.uint8)
    for kind, chars in ((GAP, GAPS), (MARK, MARKS), (LETTER, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")):
        found[list(map(ord, chars))] = kind
    return found


def words(pack: Packed) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces that the tokenizer encodes independently of what stands around them."""
    kind = kinds()[np.minimum(pack.cps, 128)]
    cut = np.zeros(len(kind), bool)
    if len(kind):
        a, b = kind[:-1], kind[1:]
        cut[1:] = ((a == LETTER) & (b == MARK)) | ((a == MARK) & (b == LETTER))
    return pack.runs(kind != GAP, cut)


def worker_cache(name: str) -> SpanCache:
    def encode(found: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        groups = [found[i : i + WORDS_AT_ONCE] for i in range(0, len(found), WORDS_AT_ONCE)]
        got = tokenizer(name).encode_batch(groups, is_pretokenized=True, add_special_tokens=False)
        counts = [np.bincount(np.array(x.word_ids, np.int64), minlength=len(g)) for x, g in zip(got, groups)]
        return [(np.concatenate(counts), np.concatenate([np.array(x.ids, np.uint32) for x in got]))]

    return worker_resource(("token-shards", name), lambda: SpanCache(encode))


def encode_texts(texts: list[str], name: str = TOKENIZER, end_id: int | None = END_ID) -> Iterator[np.ndarray]:
    """The ids of each text, in order; the end id follows if one is given.

    Each distinct word is encoded once by the tokenizer and the ids put together. A text that may hold an added
    token, which reaches over words, is encoded whole.
    """
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    added = added_tokens(name)
    first = added[0][:1] if added else ""
    first = first if all(x.startswith(first) for x in added) else ""  # one character rules out most texts
    special = [any(x in t.lower() for x in added) if added and first in t else False for t in texts]
    plain = encode_words([t if not s else "" for t, s in zip(texts, special)], name)
    for text, whole, ids in zip(texts, special, plain):
        found = np.array(tokenizer(name).encode(text, add_special_tokens=False).ids, np.uint32) if whole else ids
        yield np.concatenate([found, tail])


def encode_words(texts: list[str], name: str) -> Iterator[np.ndarray]:
    cache = worker_cache(name)
    for _, _, pack in packed(texts):
        starts, ends = words(pack)
        # The tokenizer lowers case, so words that differ in the case of ASCII letters alone share their ids.
        pack.cps = np.where((pack.cps >= 65) & (pack.cps <= 90), pack.cps + np.uint32(32), pack.cps)
        rows = cache.rows(pack, starts, ends)
        n, ids = cache.gather(0, rows)
        stops = np.cumsum(sums_by_text(n, pack.counts(starts))) if len(rows) else np.zeros(len(pack.texts), np.int64)
        a = 0
        for b in stops.tolist():
            yield ids[a:b]
            a = b


class ShardWriter:
    """Writes documents to one shard; call ``add`` in order, then leave the context."""

    def __init__(self, uri: str, frame_tokens: int = FRAME_TOKENS):
        import zstandard

        self.file = AtomicFile(uri)
        self.frame_tokens = frame_tokens
        self.compressor = zstandard.ZstdCompressor(level=1, write_checksum=True)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0
        self.entries: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.n_held and self.n_held + len(ids) > self.frame_tokens:
            self.flush()
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))

    def flush(self) -> None:
        import xxhash

        if not self.n_held:
            return
        raw = np.concatenate(self.held).astype("<u4").tobytes()
        frame = self.compressor.compress(raw)
        self.file.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def __enter__(self) -> "ShardWriter":
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            import xxhash

            self.flush()
            known = np.array([x is not None for x in self.doc_ids], np.uint8)
            index = struct.pack("<Q", len(self.counts)) + np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + known.tobytes() + np.array(self.counts, "<u8").tobytes()
            body = self.compressor.compress(index)
            self.file.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
            self.entries.append((len(body) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
            table = b"".join(struct.pack("<III", *x) for x in self.entries) + struct.pack("<IBI", len(self.entries), HAS_CHECKSUM, SEEK_MAGIC)
            self.file.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.file.__exit__(kind, value, trace)


class ShardReader:
    """Random access to a shard's documents."""

    def __init__(self, uri: str):
        import xxhash
        import zstandard

        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        self.digest = lambda raw: xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF
        self.unzip = zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, self.file.size() - 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUM:
            raise ValueError(f"{uri}: no seek table with checksums")
        table = np.frombuffer(self.file.read_at(12 * n, self.file.size() - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.cumsum(table[:, 0]) - table[:, 0]
        self.table = table
        raw = self.unzip.decompress(self.file.read_at(int(table[-1, 0]) - 8, int(self.at[-1]) + 8))
        self.verify(raw, n - 1)
        (docs,) = struct.unpack("<Q", raw[:8])
        ids = np.frombuffer(raw, "<i8", docs, 8).tolist()
        known = np.frombuffer(raw, np.uint8, docs, 8 + 8 * docs).tolist()
        self.doc_ids = [i if k else None for i, k in zip(ids, known)]
        self.counts = np.frombuffer(raw, "<u8", docs, 8 + 9 * docs).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.frame_start = (np.cumsum(table[:-1, 1]) - table[:-1, 1]) // 4
        self.decompressed = 0

    def verify(self, raw: bytes, k: int) -> None:
        if self.digest(raw) != self.table[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")

    def frame(self, k: int) -> np.ndarray:
        raw = self.unzip.decompress(self.file.read_at(int(self.table[k, 0]), int(self.at[k])))
        self.verify(raw, k)
        self.decompressed += 1
        return np.frombuffer(raw, "<u4")

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, its first id's place in the shard, ids) of the wanted doc ids, or of all."""
        keep = None if wanted is None else set(wanted)
        held, ids = -1, np.zeros(0, "<u4")
        for i, doc_id in enumerate(self.doc_ids):
            if keep is not None and doc_id not in keep:
                continue
            start, n = int(self.starts[i]), int(self.counts[i])
            k = int(np.searchsorted(self.frame_start, start, "right")) - 1 if n else held
            if n and k != held:
                held, ids = k, self.frame(k)
            first = start - int(self.frame_start[k]) if n else 0
            yield doc_id, start, ids[first : first + n]

    def __enter__(self) -> "ShardReader":
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def shards_for(docs: DataFrame) -> int:
    """How many shards the table needs by bytes and by rows."""
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    return max(1, -(-size["bytes"] // SHARD_BYTES), -(-size["n"] // SHARD_DOCS))


def write_shards(docs: DataFrame, folder: str, shards: int, name: str = TOKENIZER, end_id: int | None = END_ID) -> list[tuple[int, int]]:
    """Write (doc_id, text) rows as shards in ascending doc_id order; (shard, tokens) of each, in order.

    Only the text is shuffled, by ranges of doc_id; a shard is written as its partition is read. What comes back to
    the driver is one row a shard.
    """

    def run(batches):
        shard = TaskContext.get().partitionId()
        with ShardWriter(f"{folder}/shard-{shard:06d}.zst") as out:
            for batch in batches:
                doc_ids = batch.column("doc_id").to_pylist()
                for at, texts in text_slices(batch):
                    for doc_id, ids in zip(doc_ids[at:], encode_texts(texts, name, end_id)):
                        out.add(doc_id, ids)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_tokens": pa.array([out.n_tokens], pa.int64())})

    texts = docs.select("doc_id", text_or_empty("text").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = texts.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text")
    return sorted(map(tuple, map_arrow(ranged, run, "shard int, n_tokens bigint").collect()))


def read_shards(spark: SparkSession, folder: str, manifest: list[tuple[int, int]], wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) read back from the shards; ``start`` counts all ids before, over all shards."""
    starts = np.cumsum([0, *(n for _, n in manifest)]).tolist()

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                with ShardReader(f"{folder}/shard-{manifest[k][0]:06d}.zst") as shard:
                    rows, held = [], 0
                    for doc_id, start, ids in shard.read(wanted):
                        rows.append((doc_id, starts[k] + start, ids))
                        held += len(ids)
                        if held >= 1 << 20:
                            yield as_batch(rows)
                            rows, held = [], 0
                    yield as_batch(rows)

    def as_batch(rows):
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(x) for _, _, x in rows], out=offsets[1:])
        flat = np.concatenate([x for _, _, x in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in rows], pa.int64()), pa.array([x for _, x, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "start", "ids"])

    return map_arrow(spark.range(0, len(manifest), 1, max(1, len(manifest))), run, "doc_id bigint, start bigint, ids array<int>")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "token-shards")
    docs = read_table(spark, sf_dir, "documents")
    manifest = write_shards(docs, folder, shards_for(docs))
    starts = np.cumsum([0, *(n for _, n in manifest)]).tolist()

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                with ShardReader(f"{folder}/shard-{manifest[k][0]:06d}.zst") as shard:
                    got = [(doc_id, starts[k] + start, len(ids), zlib.crc32(ids.tobytes())) for doc_id, start, ids in shard.read()]
                columns = list(zip(*got)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(spark.range(0, len(manifest), 1, max(1, len(manifest))), run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
