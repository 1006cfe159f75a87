import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from millrace.llm import byte_bpe as B

from .helpers import ODD_TEXTS, documents, write_tables


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.load_ranks(B.RANKS), special_tokens={})


def test_random_texts_as_tiktoken(reference):
    rng = random.Random(4)
    chars = " \t\n\r\x0b\x1c\x85\xa0   ''''strevmlldabcXYZé中文١٢12ⅷ½!?-_.😀é‍ß　\x00<|>"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [t or "" for t in ODD_TEXTS] + ["it's 's ''s 'store we'll'd", "a \n \nb", "   ", " 's", "'", "'l", "x'"]
    for text, (ids, back) in zip(texts, B.encode_texts(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text), repr(text)
        assert back == text.encode()


def test_classes_of_code_points(reference):
    texts = [f"a{chr(c)}b1{chr(c)} {chr(c)}" for c in range(0, 0x20000, 13) if not 0xD800 <= c < 0xE000]
    assert all(ids.tolist() == reference.encode_ordinary(t) for t, (ids, _) in zip(texts, B.encode_texts(texts)))


def test_query(spark, tmp_path, reference):
    texts = ODD_TEXTS + ["same", "same"]
    folder = write_tables(spark, tmp_path, documents=documents(spark, texts, extra=True))
    got = {r.doc_id: r for r in B.op8(spark, folder).collect()}
    for i, t in enumerate(texts):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_operator_keeps_columns(spark, reference):
    got = B.encode(documents(spark, ["hello world", None, ""], extra=True)).orderBy("doc_id").collect()
    assert got[0].ids == reference.encode_ordinary("hello world") and bytes(got[0].decoded) == b"hello world"
    assert got[1].text is None and got[1].ids == [] and got[0].key == "k"
    assert B.encode(documents(spark, [])).count() == 0


def test_cache_limit_changes_nothing(reference):
    from millrace.llm.textcore import SpanCache, packed

    cache = SpanCache(B.Coder(), limit=50)
    rng = random.Random(1)
    for _ in range(8):
        text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(60))
        for _, _, pack in packed([text]):
            rows = cache.rows(pack, *B.matches(pack))
            assert cache.gather(0, rows)[1].tolist() == reference.encode_ordinary(text)


def test_long_matches_as_tiktoken(reference):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéñ"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (127, 128, 129, 191, 193, 500, 3000)]
    texts += [x * n for x in ("a", "ab", "abc", "-", "=", "é", "中", "haha", "0") for n in (100, 129, 1001)]
    texts += ["the" * 300 + "x" * 301 + "the" * 300, " " * 999 + "a" + "\n" * 777, "日本語の文章" * 90]
    for text, (ids, back) in zip(texts, B.encode_texts(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text), text[:40]
        assert back == text.encode()


def test_pieces_without_a_common_place_are_made_longer(reference, monkeypatch):
    monkeypatch.setattr(B, "LONG", 8)
    rng = random.Random(5)
    coder = B.Coder()
    for word in ["-" * 300, "a" * 77, "".join(rng.choice("ab") for _ in range(400)), "internationalization" * 12]:
        assert coder.long(word.encode(), 8).tolist() == reference.encode_ordinary(word)


def test_a_match_of_100_000_letters(reference):
    import time

    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    began = time.perf_counter()
    (ids, back), = B.encode_texts([text])
    assert back == text.encode() and len(ids) < len(text) and time.perf_counter() - began < 60
    again = B.Coder()
    head = text[:4000]
    assert again.long(head.encode()).tolist() == reference.encode_ordinary(head)
