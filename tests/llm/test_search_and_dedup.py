import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam as D
from millrace.llm import hamming as H
from millrace.llm import neardup as N
from millrace.llm.common import lookup, written
from millrace.llm.shingles import shingles
from millrace.llm.textcore import Packed

from .helpers import ODD_TEXTS, documents, write_tables


def bag(text):
    return Counter(shingles(Packed([(text or "").lower()]))[0].tolist())


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(texts, least=0.8):
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            near = jaccard(bags[i], bags[j]) >= least if bags[i] or bags[j] else (texts[i] or "") == (texts[j] or "")
            if near:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(texts))]


def words(rng, n, vocabulary=10**6):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, text, share):
    out = list(text)
    for i in rng.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = f"e{rng.randrange(10**6)}"
    return out


def test_bag_minhash_estimates_weighted_jaccard():
    rng = random.Random(3)
    base = words(rng, 200)
    for share, tail in ((0.01, 0), (0.05, 80), (0.1, 150)):
        a, b = " ".join(base + base[:60] * 3), " ".join(edited(rng, base, share) + base[:60] * 2 + base[:tail])
        hashes, counts = shingles(Packed([a, b]))
        s = N.bag_signatures(*N.multisets(hashes, counts), 2, 4000)
        assert abs((s[0] == s[1]).mean() - jaccard(bag(a), bag(b))) < 0.03


def test_signatures_do_not_depend_on_the_batch():
    texts = ["a b c d e f g h a b c d e f g", " ".join(words(random.Random(1), 3000)), "x " * 4000, "one two"]
    together = N.bag_signatures(*N.multisets(*shingles(Packed(texts))), len(texts), 125)
    for i, t in enumerate(texts):
        assert (N.bag_signatures(*N.multisets(*shingles(Packed([t]))), 1, 125)[0] == together[i]).all()


def test_classes_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = list(ODD_TEXTS) + [None, "", "one", "A, b c!", "!!! ??? ###"]
    common = words(rng, 60)
    for _ in range(12):
        base = words(rng, rng.randint(40, 150))
        texts += [" ".join(base)] * rng.randint(1, 3)
        texts += [" ".join(edited(rng, base, s)) for s in (0.005, 0.01, 0.02, 0.04)]
        texts.append(" ".join(common + words(rng, 20)))
    chain = words(rng, 200)
    for _ in range(12):
        chain = edited(rng, chain, 0.01)
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    folder = write_tables(spark, tmp_path, documents=documents(spark, texts, extra=True))
    got = {r.doc_id: r.class_id for r in N.op7(spark, folder).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "x", "x", "y"], ids=[4, 4, None, 2, None])
    assert sorted((r.doc_id or 0, r.class_id) for r in N.classes_of(docs).collect()) == [(0, None), (0, None), (2, 2), (4, 4), (4, 4)]
    assert sorted((r.doc_id or 0, r.text) for r in N.one_of_each(docs).collect()) == [(0, "x"), (0, "y"), (2, "x"), (4, "a b c d e f")]
    assert N.classes_of(documents(spark, [])).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(6)
    base = words(rng, 120)
    texts = [" ".join(edited(rng, base, 0.005)) for _ in range(600)] + [" ".join(words(rng, 100)) for _ in range(200)]
    got = N.classes_of(documents(spark, texts)).collect()
    assert {r.class_id for r in got if r.doc_id < 600} == {0} and all(r.class_id == r.doc_id for r in got if r.doc_id >= 600)


def test_large_open_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "LARGE", 2)
    passage = words(random.Random(1), 300)

    def pair(seed):
        rng = random.Random(seed)
        both = words(rng, 8)
        return [" ".join(passage + both + words(rng, 36)) for _ in range(2)]

    # These pairs agree on bands of the first signature in buckets of many texts only, and on no finer band of another.
    seeds = [243, 611, 649, 670, 1127, 1193]
    texts = [t for k in [*seeds, *range(10**6, 10**6 + 20)] for t in pair(k)]
    bags = [bag(t) for t in texts]
    assert all(0.8 <= jaccard(bags[i], bags[i + 1]) < 0.81 for i in range(0, len(texts), 2))
    got = {r.doc_id: r.class_id for r in N.classes_of(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def test_borderline_pairs_that_all_share_a_passage(spark):
    # By default settings: hundreds of texts in one bucket of each band, each with one partner at 0.8 to 0.81.
    passage, texts = words(random.Random(1), 300), []
    for seed in range(150):
        rng = random.Random(10**7 + seed)
        both = words(rng, 8)
        texts += [" ".join(passage + both + words(rng, 36)) for _ in range(2)]
    got = {r.doc_id: r.class_id for r in N.classes_of(documents(spark, texts)).collect()}
    want = classes(texts)
    assert len(set(want)) == 150 and [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("block, split", [(256, False), (8, True)])
def test_buckets_are_split_only_where_that_makes_fewer_rows(spark, monkeypatch, block, split):
    # Buckets of up to 120 rows: in few blocks they are compared as they are, in many they go to finer bands.
    monkeypatch.setattr(N, "BLOCK", block)
    asked, refined = [], N.refined
    monkeypatch.setattr(N, "refined", lambda sets, nodes: asked.append(nodes.count()) or refined(sets, nodes))
    passage, texts = words(random.Random(1), 300), []
    for seed in range(60):
        rng = random.Random(10**7 + seed)
        both = words(rng, 8)
        texts += [" ".join(passage + both + words(rng, 36)) for _ in range(2)]
    got = {r.doc_id: r.class_id for r in N.classes_of(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts) and bool(asked) == split


def test_blocks_make_no_more_rows_than_finer_bands(spark):
    columns = "bucket bigint, node bigint, n bigint, comp bigint, major bigint, minor bigint, minor_items bigint, items bigint, rows bigint"
    for major, minor, split in ((1, 64, False), (1, 300, False), (1, 900, True), (3000, 200, False), (2000, 700, True)):
        total = major + minor
        rows = spark.createDataFrame([(9, n, 10, 0 if n < major else n, 0, minor, minor * 10, total * 10, total) for n in range(total)], columns)
        assert rows.filter(N.split_further(N.BANDS)).count() == (total if split else 0)
        assert split == (N.blocks(rows).count() * N.BANDS > total * N.FINE_BANDS)


@pytest.mark.parametrize("items", [40, 10**6])
def test_heavy_buckets_are_cut_into_blocks(spark, monkeypatch, items):
    monkeypatch.setattr(N, "BLOCK_ITEMS", items)
    columns = "bucket bigint, node bigint, n bigint, comp bigint, major bigint, minor bigint, minor_items bigint, items bigint, rows bigint"
    rows = spark.createDataFrame([(9, n, 10, n % 6, 0, 15, 150, 180, 18) for n in range(18)], columns)
    groups = {}
    for r in N.blocks(rows).collect():
        groups.setdefault((r.i, r.j), set()).add(r.node)
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b and a % 6 != b % 6}
    assert met == {(a, b) for a in range(18) for b in range(a + 1, 18) if a % 6 != b % 6}
    assert (len(groups) > 1) == (items == 40)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_all_pairs_of_different_components_meet_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    comps = [0, 0, 0, 0, 4, 4, 6, 7, 8]
    columns = "bucket bigint, node bigint, n bigint, comp bigint, major bigint, minor bigint, minor_items bigint, items bigint, rows bigint"
    rows = spark.createDataFrame([(9, n, 10, c, 0, 5, 50, 90, 9) for n, c in enumerate(comps)], columns)
    groups = {}
    for r in N.blocks(rows).collect():
        groups.setdefault((r.i, r.j), []).append(r.node)
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b and comps[a] != comps[b]}
    assert met == {(a, b) for a in range(9) for b in range(a + 1, 9) if comps[a] != comps[b]}


def test_links_that_no_hub_sees(spark, monkeypatch):
    # Texts near two others each in a ring, but not near the bucket's hub; bands so coarse that all share buckets.
    rng = random.Random(11)
    common = words(rng, 100)
    ring = [words(rng, 2) for _ in range(40)]
    texts = [" ".join(common + sum(ring[i : i + 12], [])) for i in range(25)]
    monkeypatch.setattr(N, "LARGE", 10**9)
    monkeypatch.setattr(N, "BLOCK", 5)
    got = {r.doc_id: r.class_id for r in N.classes_of(documents(spark, texts), bands=60, rows=1, least=0.9).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts, 0.9)


@pytest.mark.parametrize("at_once", [10, 10**6])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(N, "LINKS", at_once)
    rng = random.Random(8)
    links = [(i, i - 1) for i in range(1, 30)] + [(100 + i, 100) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    links = [(max(a, b), min(a, b)) for a, b in links if a != b]
    got = {r.node: r.comp for r in N.components(spark.createDataFrame(links, "node bigint, hub bigint")).collect()}
    want = {n: n for l in links for n in l}
    for _ in range(300):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_lookup_with_a_hot_key(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    right = written(left.groupBy("k").count().filter("k <> 'k3'").withColumn("v", F.col("k")), "test-right")
    for share in (0.001, 1.0):
        got = lookup(left, right, "k", "count", 4000, share).collect()
        assert len(got) == 4000 and all(r.v == (None if r.k == "k3" else r.k) for r in got)


def contained(texts, items, least=0.8):
    out = set()
    for d, t in enumerate(texts):
        have = set(bag(t))
        for i, x in enumerate(items):
            want = set(bag(x))
            if want and len(want & have) >= least * len(want):
                out.add((d, i, len(want & have), len(want)))
    return out


def test_decontamination_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    items = [" ".join(words(rng, n)) for n in (1, 3, 5, 6, 8, 12, 20, 40, 70, 130, 300, 900)] + [None, "", "??"]
    texts = list(ODD_TEXTS)
    for x in items:
        w = (x or "").split()
        for size in (0, 50, 8000):
            for share in (0, 0.02, 0.3):
                around = words(rng, size)
                part = edited(rng, w, share) if share and w else w
                texts.append(" ".join(around + [p.upper() + "," for p in part] + around[::-1]))
        half = len(w) // 2
        texts.append(" ".join(w[: half + 4] + words(rng, 3000) + w[half:]))
    docs = documents(spark, texts, extra=True)
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").withColumn("shingles", F.lit(1))
    got = {tuple(r) for r in D.op9(spark, write_tables(spark, tmp_path, documents=docs, benchmark=table)).collect()}
    want = contained(texts, items)
    assert got == want
    left = {r.doc_id for r in D.clean(docs, table).collect()}
    assert left == set(range(len(texts))) - {d for d, *_ in got}


def test_decontamination_in_groups_and_empty_tables(spark, monkeypatch):
    rng = random.Random(10)
    items = [" ".join(words(rng, 20)) for _ in range(30)]
    docs = documents(spark, items + ["clean text of some words"])
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 7)
    monkeypatch.setattr(D, "IDS_A_ROW", 4)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, table).collect()} == {(i, i) for i in range(30)}
    assert [r.doc_id for r in D.clean(docs, table).collect()] == [30]
    assert D.contaminated(documents(spark, []), table).count() == 0
    assert D.contaminated(docs, table.limit(0)).count() == 0 and D.clean(docs, table.limit(0)).count() == 31


def nearest(rows, k):
    code = {i: [x is not None and x > 0 for x in v] for i, v in rows if i is not None and v and None not in v}
    return {q: sorted((sum(a != b for a, b in zip(code[q], code[i])), i) for i in code if len(code[i]) == len(code[q]))[:k] for q in code if q % 50 == 0}


@pytest.mark.parametrize("dim", [1, 7, 64, 100])
def test_search_against_brute_force(spark, tmp_path, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(size=dim).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(300)]  # a vector that many rows share
    rows += [(None, rows[0][1]), (2000, None), (2050, []), (2100, [None] * dim), (2150, [float("nan")] * dim), (2200, [1.0] * (dim + 1))]
    table = spark.createDataFrame([(i, v, 0, "c") for i, v in rows], "vec_id bigint, embedding array<float>, label int, code string")
    got = {}
    for r in H.op3(spark, write_tables(spark, tmp_path, embeddings=table)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.id)
    assert {q: [v for _, v in sorted(x.items())] for q, x in got.items()} == nearest(rows, H.K)


def test_search_in_blocks_and_of_an_empty_table(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    monkeypatch.setattr(H, "BLOCK_CODES", 64)
    monkeypatch.setattr(H, "QUERY_CODES", 2)
    monkeypatch.setattr(H, "ANSWERS", 1)
    got = {}
    for r in H.search(df, df.filter("id % 50 = 0"), 4).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    assert {q: sorted(v) for q, v in got.items()} == nearest(rows, 4)
    assert H.search(df.limit(0), df.limit(0)).count() == 0


def test_the_radius_grows_only_as_far_as_needed():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, (5000, 1), dtype=np.uint64)
    index = H.MultiIndex(codes, 64)
    query = codes[7] ^ np.uint64(1)
    where, distance = index.nearest(query, np.ones(5000, np.int64), 1)
    assert where[0] == 7 and distance[0] == 1


def test_equal_items_and_equal_ids(spark, monkeypatch):
    rng = random.Random(31)
    a, b = (" ".join(words(rng, 20)) for _ in range(2))
    items = [(i, a) for i in range(30)] + [(None, a), (7, b), (7, b)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, [a, "x " + b, a + " y", "clean"], ids=[1, 1, 2, 3])
    for ids_a_row in (4, 1000):
        monkeypatch.setattr(D, "IDS_A_ROW", ids_a_row)
        got = Counter((r.doc_id, r.item_id, r.n_item) for r in D.contaminated(docs, table).collect())
        want = Counter((d, i, 16) for d in (1, 2) for i, t in items if t == a) + Counter({(1, 7, 16): 2})
        assert got == want
        assert [r.doc_id for r in D.clean(docs, table).collect()] == [3]


def test_items_of_one_shingle_are_never_missed(spark):
    rng = random.Random(32)
    items = [" ".join(words(rng, 5)) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [" ".join(words(rng, 40) + [x] + words(rng, 40)) for x in items for _ in range(5)]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(documents(spark, texts), table).collect()}
    assert got == {(i, i // 5) for i in range(2000)}
