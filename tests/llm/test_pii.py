import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import pii as P
from millrace.llm.textcore import Packed

from .helpers import ODD_TEXTS, documents, write_tables

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
SAMPLE = "call +1 (974) 555-3436 now; mail bob.b@site.example.com, host 97.51.17.173, card 4111 1111 1111 1111 end"


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = [True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 13 <= len(digits) <= 19 and P.luhn(digits), 9 <= len(digits) <= 15][kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def field():
    rng = random.Random(3)
    texts = []
    for _ in range(400):
        n = "".join(rng.choice("0123456789") for _ in range(7))
        texts.append(f"the word {n[:3]} and then +1 ({n[:3]}) 555-{n[3:]} of it from {rng.randint(1, 255)}.{rng.randint(0, 255)}.2.{rng.randint(0, 255)} to a{n}@mail{n[0]}.example.com")
    return P.train(texts)


def test_base_spans_as_the_patterns_give_them():
    rng = random.Random(2)
    parts = ["1", "2", "25", "255", "256", "0", "4111111111111111", "49", ".", ".", " ", "-", "@", "a", "b.c", "+", "(", ")", "é", "٣", "\n", "+1 (555) 123-4567", "x@y.z", "1.2.3.4", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    texts += [t or "" for t in ODD_TEXTS]
    got = [x for i in range(0, len(texts), 500) for x in P.base_spans(Packed(texts[i : i + 500]))]
    assert got == [brute(t) for t in texts]


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000):
        P.base_spans(Packed([text]))


def test_a_repeated_mention_takes_the_label_of_its_match(field):
    text = SAMPLE + " later: 555-3436 and 5553436, or 123-9876"
    (base, added), = P.find([text], field)
    assert base == brute(text)
    assert [text[a:b] for _, a, b in added] == ["555-3436", "5553436"] and {k for k, _, _ in added} == {3}


@pytest.mark.parametrize("mentions", [1, 4, 5, 8, 20, 40, 50, 400])
def test_every_mention_takes_the_label_of_its_match(field, mentions):
    match, again = "call +1 (974) 555-3436 now", " and later 555-3436 of it" * mentions
    for text in (match + again, again + " " + match):
        (base, added), = P.find([text, "555-3436 alone"], field)[:1]
        assert base == brute(text)
        assert [text[a:b] for _, a, b in added] == ["555-3436"] * mentions and {k for k, _, _ in added} == {3}


@pytest.mark.parametrize("other", ["5553436", "974-555-3436", "555 3436"])
def test_spellings_in_turn(field, other):
    text = "call +1 (974) 555-3436 now" + f" then 555-3436 or {other} again" * 8
    (_, added), = P.find([text], field)
    assert sum(text[a:b] == "555-3436" for _, a, b in added) == 8 and {k for k, _, _ in added} == {3}
    assert " " in other or sum(text[a:b] == other for _, a, b in added) == 8


def test_many_spans_of_a_text_take_linear_time(field):
    import time

    text = " ".join(f"a{i}@b{i}.example.com" for i in range(100_000))
    began = time.perf_counter()
    (base, added), = P.find([text], field)
    assert len(base) == 100_000 and not added and time.perf_counter() - began < 60


def test_marks_are_those_of_the_last_match_that_touches(field):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a1", "+1 22", "3.4.5.6", "x@y.z", "7777", "4111111111111111"]) for _ in range(30)) for _ in range(40)]
    pack = Packed(texts)
    base = P.base_spans(pack)
    tokens = P.Tokens(pack, base)
    for t, a, b, label in zip(tokens.text, tokens.start, tokens.end, tokens.label.tolist()):
        touching = [(x, y, k) for k, x, y in base[t] if x < b and y > a]
        assert label == (max(touching)[2] + 1 if touching else 0)


def test_a_long_token_is_judged_whole():
    assert P.looks("1" * 100 + "@a.b", -1)[1] == 1.0 and P.looks("1" * 100 + "(", -1)[17] == 1.0


def test_no_match_no_added_span(field):
    texts = ["555-3436 and 5553436 or 12 of 2024", "plain words only", "x1 x2 x3 " * 50, ""]
    assert all(not base and not added for base, added in P.find(texts, field))


def test_edges_grow_with_tokens():
    pack = Packed(["5553436 " * 5000])
    tokens = P.Tokens(pack, P.base_spans(pack))
    assert tokens.size == 5000 and len(tokens.u) < 3 * 5000


def test_message_passing_is_exact_on_a_tree():
    import itertools

    pack = Packed(["+1 x 12 34 y"])
    tokens = P.Tokens(pack, P.base_spans(pack))
    field = P.Field()
    rng = np.random.default_rng(1)
    field.look, field.match, field.edge = rng.normal(size=field.look.shape), rng.normal(size=field.match.shape), rng.normal(size=field.edge.shape)
    shown = np.ones(tokens.size, bool)
    unary = field.unary(tokens, shown)
    want = np.zeros((tokens.size, P.LABELS))
    for labels in itertools.product(range(P.LABELS), repeat=tokens.size):
        score = sum(unary[i, y] for i, y in enumerate(labels)) + sum(field.edge[k][labels[u], labels[v]] for u, v, k in zip(tokens.u, tokens.v, tokens.kind))
        for i, y in enumerate(labels):
            want[i, y] += np.exp(score)
    want /= want.sum(1, keepdims=True)
    assert tokens.size == 3 and len(tokens.u) == 1
    assert np.allclose(field.marginals(tokens, shown)[0], want, atol=1e-3)


def test_query(spark, tmp_path):
    texts = ODD_TEXTS + [SAMPLE, SAMPLE, "é😀 a@b.c"]
    folder = write_tables(spark, tmp_path / "a", documents=documents(spark, texts, extra=True))
    got = {r.doc_id: r for r in P.op1(spark, folder).collect()}
    for i, t in enumerate(texts):
        base = brute(t or "")
        spans = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [sum(x == j for x, _, _ in base) for j in range(4)]
        assert set(spans.split(",")) <= set(got[i].spans.split(",")) or not spans
    assert P.op1(spark, write_tables(spark, tmp_path / "b", documents=documents(spark, []))).count() == 0


def test_masking(spark):
    assert P.masked("ab cd ef", [(0, 0, 2), (3, 1, 5)]) == "[EMAIL] ef"
    docs = documents(spark, [SAMPLE, None, "", "clean"], extra=True)
    got = P.redact(docs, P.Field()).orderBy("doc_id").collect()
    assert got[0].text == "call [PHONE] now; mail [EMAIL], host [IP], card [CARD] end" and got[0].n_chars == len(got[0].text)
    assert [r.text for r in got[1:]] == [None, "", "clean"] and got[1].n_chars is None and got[0].key == "k"
