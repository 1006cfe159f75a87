import zlib

import numpy as np
import pytest

import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import token_shards as T
from millrace.llm.common import file_system

from .helpers import ODD_TEXTS, documents, write_tables

SPECIAL = ["<|endoftext|> a<|startoftext|>b", "<|EndOfText|> it <|endoftext|", "<|<|endoftext|>|>", "x " * 3000 + "<|endoftext|>it's"]
MORE = ["it's 's ''s we'll'd don't", "A.B,c;d e-f 12 3a a3", "x≠y ≮ z", *SPECIAL, "\x1c\x85  a b"]


LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def test_encodes_as_the_library_does():
    texts = ODD_TEXTS + MORE
    assert [x.tolist() for x in T.encode_texts([t or "" for t in texts])] == [whole(t) for t in texts]


def test_added_tokens_are_one_id():
    got = [x.tolist() for x in T.encode_texts(["<|endoftext|>", "a<|startoftext|>"], end_id=None)]
    assert got[0] == [49407] and got[1][-1] == 49406 and len(got[1]) == 2


def test_random_texts_as_the_library_does():
    import random

    rng = random.Random(4)
    parts = [" ", "\n", "a", "Be", "'s", "'LL", "1", "é", "e\u0301", "中", ".", "<|", "|>", "endoftext", "<|endoftext|>", "_", "-", "\u00a0", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert [x.tolist() for x in T.encode_texts(texts)] == [whole(t) for t in texts]


def test_shards_follow_bytes_and_rows(spark, tmp_path, monkeypatch):
    docs = documents(spark, ["some text"] * 40 + [None], ids=[5] * 20 + list(range(20)) + [None])
    assert T.shards_for(docs) == 1 and T.shards_for(docs.limit(0)) == 1
    monkeypatch.setattr(T, "SHARD_DOCS", 10)
    assert T.shards_for(docs) == 5
    monkeypatch.setattr(T, "SHARD_BYTES", 36)
    assert T.shards_for(docs) == 10
    varied = documents(spark, [f"text {i}" for i in range(200)], ids=[None] * 100 + [7] * 100)
    manifest = T.write_shards(varied, f"file://{tmp_path}/s", 8)
    assert len(manifest) == 8 and all(0 < n < 900 for _, n in manifest)
    read = T.read_shards(spark, f"file://{tmp_path}/s", manifest).collect()
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in read) == sorted((7 * (i >= 100), tuple(whole(f"text {i}"))) for i in range(200))


def test_query_against_whole_texts(spark, tmp_path):
    texts = (ODD_TEXTS + MORE) * 3
    ids = [(7 * i) % len(texts) for i in range(len(texts))]
    folder = write_tables(spark, tmp_path, documents=documents(spark, texts, extra=True, ids=ids))
    got = sorted(T.op5(spark, folder).collect(), key=lambda r: r.doc_id)
    start = 0
    by_id = dict(zip(ids, texts))
    for row, doc_id in zip(got, sorted(ids), strict=True):
        want = whole(by_id[doc_id])
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(want))
        assert row.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_null_and_repeated_ids_and_empty_table(spark, tmp_path):
    folder = write_tables(spark, tmp_path / "a", documents=documents(spark, ["b", "a", "c"], ids=[1, 1, None]))
    assert sorted((r.start, r.doc_id) for r in T.op5(spark, folder).collect()) == [(0, None), (2, 1), (4, 1)]
    folder = write_tables(spark, tmp_path / "b", documents=documents(spark, []))
    assert T.op5(spark, folder).count() == 0


def shard(path, docs, frame_tokens=10):
    with T.ShardWriter(str(path), frame_tokens) as out:
        for doc_id, ids in docs:
            out.add(doc_id, np.array(ids, np.uint32))


def test_reads_only_the_frames_it_needs(tmp_path):
    docs = [(i, list(range(i, i + 6))) for i in range(50)] + [(99, []), (100, list(range(40)))]
    shard(tmp_path / "s.zst", docs)
    with T.ShardReader(str(tmp_path / "s.zst")) as r:
        assert [(d, x.tolist()) for d, _, x in r.read([3, 99, 100])] == [docs[3], docs[50], docs[51]]
        assert r.decompressed == 2
    with T.ShardReader(str(tmp_path / "s.zst")) as r:
        assert [(d, x.tolist()) for d, _, x in r.read()] == docs


def test_frames_are_independent_zstandard_frames(tmp_path):
    import zstandard

    shard(tmp_path / "s.zst", [(i, [i] * 6) for i in range(5)])
    raw = (tmp_path / "s.zst").read_bytes()
    out = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert np.frombuffer(out, "<u4").tolist() == [i for i in range(5) for _ in range(6)]


def test_a_damaged_frame_is_noticed(tmp_path):
    shard(tmp_path / "s.zst", [(i, list(range(i * 6, i * 6 + 6))) for i in range(5)])
    raw = bytearray((tmp_path / "s.zst").read_bytes())
    raw[14] ^= 255
    (tmp_path / "s.zst").write_bytes(raw)
    import zstandard

    with T.ShardReader(str(tmp_path / "s.zst")) as r, pytest.raises((ValueError, zstandard.ZstdError)):
        list(r.read())


def test_a_failed_write_leaves_nothing(tmp_path):
    with pytest.raises(RuntimeError), T.ShardWriter(str(tmp_path / "s.zst")) as out:
        out.add(1, np.arange(5, dtype=np.uint32))
        raise RuntimeError
    assert not list(tmp_path.iterdir())
    assert file_system("file:///a/b")[1] == "/a/b"
