"""Near-duplicate classes by BagMinHash: weighted Jaccard similarity of multisets of word shingles.

Signatures. A shingle of a text has as weight the number of its occurrences. For each shingle there is a hierarchy of
Poisson processes over discretised weights: the weight intervals [0, 1), [1, 2), [2, 4), [4, 8), ... have a process
each, whose rate is the interval's width. A point has a time, a weight level uniform in the interval, and one of the
signature's components; all three follow from the shingle and interval alone. A text with weight w takes the points at
levels below w, and a component's value is the earliest time. Two texts agree on a component with a probability equal
to their weighted Jaccard similarity. A process is left as soon as its time is past every component's value.

Candidates. Rows of components make bands; texts that agree on a band share a bucket. Copies (equal multisets) count
as one node before that, by an aggregation. In each bucket all nodes are paired with one hub, so pairs grow with the
input and not with a group's square; a pair's multiset overlap is verified exactly on 64-bit shingle hashes. Verified
links give components. Texts that share a common passage meet in large buckets although they are far apart; nodes of
buckets with over ``LARGE`` rows and several components meet by the finer bands of a second, independent signature
instead, unless comparing the bucket in blocks makes no more rows than these bands would. In buckets that then still
hold several components, all pairs of nodes of different components are compared inside tasks, in blocks of at most
``BLOCK`` x ``BLOCK`` nodes and ``BLOCK_ITEMS`` occurrences on average, first by sketches and then, for nodes that a
sketch left a partner, by their multisets. Only links leave a task, fewer than it has nodes, and pairs of two nodes of a
bucket's largest component aren't looked at, so no list of pairs is made.

Chance of a miss, for a pair at 0.8 exactly: it agrees on no band of the first signature with (1 - 0.8**5)**25, 5e-5;
if it agrees on bands in such split buckets only, it agrees on none of the finer bands with (1 - 0.8**10)**90, 4e-5.
Both fall quickly as the similarity grows (4e-6 and 3e-7 at 0.83). Pairs of all other buckets meet for certain.

Everything stays in DataFrames: links, components and buckets are never collected. Keys with many rows (copies,
common buckets) are aggregated first and joined by ``lookup``. Rounds end in tables in the shared folder.

Defined cases: a null text is the empty text; texts without words are near only to texts that are equal in every
character; a null doc_id has the class null; rows that share a doc_id are one document; repeated rows have equal
classes; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, map_arrow, read_table, scratch, written
from .shingles import shingles
from .textcore import Packed, mix, sums_by_text, text_slices

BANDS, ROWS, LEAST = 25, 5, 0.8
#: Pairs whose sketches agree on less than ``least`` - SLACK of the components aren't looked at further: that is over
#: five standard deviations below what the similarity gives.
SLACK = 0.2
#: Buckets with more open rows are split by finer bands, where these make fewer rows than blocks.
LARGE, FINE_BANDS, FINE_ROWS = 64, 90, 10
#: Links that one task contracts.
LINKS = 500_000
#: Nodes of a bucket that a task compares with as many others.
BLOCK = 256
#: Occurrences of the nodes of a block, on average.
BLOCK_ITEMS = 4_000_000
_SEED = np.uint64(0xA0761D6478BD642F)
_ODD = np.uint64(0xE7037ED1A0B428DB)


def multisets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, their text, their weight) of all texts."""
    of = np.repeat(np.arange(len(counts)), counts)
    codes, _ = pd.factorize(mix(hashes + of.astype(np.uint64) * _ODD))
    n = int(codes.max(initial=-1)) + 1
    where = np.empty(n, np.int64)
    where[codes] = np.arange(len(codes))
    return hashes[where], of[where], np.bincount(codes, minlength=n)


def bag_signatures(items: np.ndarray, of: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """(texts, size) earliest times; the largest integer throughout for a text without items.

    Times are integers, so sums don't depend on what else is in the batch, nor on how many points are made at once.
    """
    best = np.full(texts * size, np.iinfo(np.uint64).max, np.uint64)
    # One process for each item and weight interval that the weight reaches: level 0 is [0, 1), level k [2**(k-1), 2**k).
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    item = np.repeat(np.arange(len(items)), levels)
    level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    process = mix(items[item] ^ (level.astype(np.uint64) * _SEED))
    owner, weights = of[item], weight[item]
    times, made = np.zeros(len(item), np.uint64), np.zeros(len(item), np.int64)
    batch = 8  # at first so many points for each component of a text; most signatures are full then
    while len(process):
        rate = np.bincount(owner, width, minlength=texts)
        points = np.maximum(1, np.ceil(batch * size * width / rate[owner])).astype(np.int64)
        which = np.repeat(np.arange(len(process)), points)
        first = np.cumsum(points) - points
        number = made[which] + np.arange(len(which)) - first[which]
        a = mix(process[which] + number.astype(np.uint64) * _ODD)
        b = mix(a ^ _SEED)
        gap = (-np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * 2.0**40 / width[which]).astype(np.uint64)
        total = np.cumsum(gap, dtype=np.uint64)
        moment = total - (total[first] - gap[first])[which] + times[which]
        spot = ((b >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width[which]).astype(np.int64)
        component = ((b & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        taken = low[which] + spot < weights[which]
        np.minimum.at(best, owner[which[taken]] * size + component[taken], moment[taken])
        times, made = moment[first + points - 1], made + points
        on = times < best.reshape(texts, size).max(1)[owner]
        process, owner, weights, times, made, low, width = process[on], owner[on], weights[on], times[on], made[on], low[on], width[on]
        batch = 2
    return best.reshape(texts, size)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands): a 64-bit hash of each band and its number."""
    out = np.zeros((len(signatures), bands), np.uint64)
    for r in range(rows):
        out = mix(out + signatures[:, r : bands * rows : rows] + _ODD)
    return mix(out + np.arange(bands, dtype=np.uint64) * _SEED).view(np.int64)


def weighted_items(items: np.ndarray, of: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each occurrence, its text): the multiset as a set, in which the k-th occurrence has a hash of its own."""
    k = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    return mix(np.repeat(items, weight) + k.astype(np.uint64) * _SEED), np.repeat(of, weight)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, n, bands, sketch) from (doc_id, text): the multiset's identity and size, its band hashes, and a
    byte of each component of its signature."""

    def run(batches):
        for batch in batches:
            for at, raw in text_slices(batch):
                pack = Packed([t.lower() for t in raw])
                hashes, counts = shingles(pack)
                items, of, weight = multisets(hashes, counts)
                signatures = bag_signatures(items, of, weight, len(counts), bands * rows)
                found = band_hashes(signatures, bands, rows)
                one, two = (sums_by_text(mix(hashes ^ c), counts).tolist() for c in (_SEED, _ODD))
                keys = [f"{a:016x}{b:016x}{n}" if n else "=" + hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for a, b, n, t in zip(one, two, counts.tolist(), raw)]
                offsets = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(np.where(counts > 0, bands, 0), out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[counts > 0].ravel()))
                sketch = pa.array([x.tobytes() for x in mix(signatures).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(raw)), pa.array(keys), pa.array(counts), lists, sketch], names=["doc_id", "key", "n", "bands", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, key string, n bigint, bands array<bigint>, sketch binary")


def multiset_table(docs: DataFrame) -> DataFrame:
    """(node, items): each text's occurrence hashes, sorted, as bytes."""

    def run(batches):
        for batch in batches:
            for at, raw in text_slices(batch):
                each, of = weighted_items(*multisets(*shingles(Packed([t.lower() for t in raw]))))
                order = np.lexsort((each, of))
                stops = np.searchsorted(of[order], np.arange(len(raw) + 1))
                data = each[order]
                values = [data[a:b].tobytes() for a, b in zip(stops[:-1], stops[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(raw)), pa.array(values, pa.binary())], names=["node", "items"])

    return map_arrow(docs.select("doc_id", "text"), run, "node bigint, items binary")


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``least``."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(x) < least * len(y) - 1e-9:
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both >= least * (len(x) + len(y) - both) - 1e-9


def verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The (node, hub) pairs whose multisets have a weighted Jaccard similarity of at least ``least``.

    Sketches go first, multisets decide. A hub with many partners is sent to as many places as it has multiples of
    500 partners.
    """
    degree = pairs.groupBy("hub").count().withColumn("salts", (F.col("count") / 500).cast("int") + 1)
    degree = written(degree.join(sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub"), "pair-degree", pairs.count())
    left = lookup(pairs, degree, "hub", "count", pairs.count()).join(sketches, "node")

    def sieve(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch", "hub_sketch"))
                keep = (a == b).sum(1) >= (least - SLACK) * a.shape[1]
                yield batch.select(["node", "hub", "salts"]).filter(pa.array(keep))

    left = map_arrow(left.select("node", "hub", "salts", "sketch", "hub_sketch"), sieve, "node bigint, hub bigint, salts int")
    left = left.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).join(sets, "node").select("node", "hub", "salt", "items")
    hubs = degree.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hubs = hubs.join(sets.select(F.col("node").alias("hub"), F.col("items").alias("hub_items")), "hub")

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("items"), batch.column("hub_items")):
                keep.append(similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), least))
            yield batch.select(["node", "hub"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(left.join(hubs, ["hub", "salt"]).select("node", "hub", "items", "hub_items"), run, "node bigint, hub bigint")


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """The same components from fewer links (a, b): each of ``parts`` tasks links its nodes to their smallest one."""

    def run(batches):
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = sorted((top(a), top(b)))
                parent[b] = a
        found = [(x, top(x)) for x in list(parent)]
        columns = list(zip(*((x, t) for x, t in found if x != t))) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return map_arrow(edges.coalesce(parts), run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of the connected component, for every node of (node, hub) links.

    Tasks of about ``LINKS`` links each first contract what they hold; if that takes one task, it is the result.
    Otherwise, in each round, every label is replaced by the smallest label beside it, and links between equal labels
    go. Nothing is collected.
    """
    parts = max(1, -(-links.count() // LINKS))
    edges = written(contracted(links.select(F.col("node").alias("a"), F.col("hub").alias("b")), parts), "cc-edges", parts, 1)
    if parts == 1:
        whole = edges.unionByName(edges.select(F.col("b").alias("a"), "b"))
        return whole.select(F.col("a").alias("node"), F.col("b").alias("comp")).distinct()
    labels = None
    while labels is None or not edges.isEmpty():
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = written(sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("deg")), "cc-best", parts * LINKS)
        if labels is None:
            labels = best.select(F.col("a").alias("node"), F.col("label").alias("comp"))
        else:
            sizes = written(labels.groupBy("comp").agg(F.count("*").alias("c")).join(best.select(F.col("a").alias("comp"), "label"), "comp"), "cc-sizes", parts * LINKS)
            labels = lookup(labels, sizes, "comp", "c", labels.count()).select("node", F.coalesce("label", "comp").alias("comp"))
        labels = written(labels, "cc-labels", parts * LINKS)
        n = edges.count()
        for side in ("a", "b"):
            edges = lookup(edges, best.select(F.col("a").alias(side), F.col("label").alias(f"l{side}"), "deg"), side, "deg", n)
        edges = written(edges.filter("la <> lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct(), "cc-edges", n)
    return labels


def beside(rows: DataFrame, *tables: DataFrame) -> DataFrame:
    """``rows`` with the tables' columns of their node. A node's rows, one for each of its buckets and blocks, are
    listed first, so that each table is joined once a node."""
    names = [c for c in rows.columns if c != "node"]
    listed, more = rows.groupBy("node").agg(F.collect_list(F.struct(*names)).alias("rows")), []
    for table in tables:
        more += [c for c in table.columns if c != "node"]
        listed = listed.join(table, "node")
    return listed.select("node", F.explode("rows").alias("r"), *more).select("node", "r.*", *more)


def block_counts() -> tuple[Column, Column, Column]:
    """Of an open row's bucket: the blocks of its largest component, those of its other rows, whether it is one block."""
    parts = lambda n, items: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK)), F.ceil(items / F.lit(BLOCK_ITEMS))).cast("int")
    n_major = parts(F.col("rows") - F.col("minor"), F.col("items") - F.col("minor_items"))
    return n_major, parts(F.col("minor"), F.col("minor_items")), (F.col("rows") <= BLOCK) & (F.col("items") <= BLOCK_ITEMS)


def split_further(bands: int) -> Column:
    """Whether an open row's bucket goes to finer bands: it is large, and its blocks would make more rows than those.

    A node has FINE_BANDS finer rows, whatever the number of its buckets, of which there are at most ``bands``. So blocks
    in which a bucket's rows appear at most FINE_BANDS / bands times on average make no more rows, and miss no pair.
    """
    n_major, n_minor, single = block_counts()
    major, minor = F.col("rows") - F.col("minor"), F.col("minor")
    made = F.when(single, F.col("rows")).otherwise(major * n_minor + minor * (n_major + n_minor))
    return (F.col("rows") > LARGE) & (made * bands > F.col("rows") * FINE_BANDS)


def blocks(rows: DataFrame, *more: str) -> DataFrame:
    """Open rows with (i, j), the pairs of a bucket's blocks that they belong to, and the columns ``more``.

    A bucket of at most BLOCK rows and BLOCK_ITEMS occurrences is one block. In others, rows of the largest component
    and all other rows have blocks of their own, numbered from 0 down and from 1 up; every block meets each of the
    others' blocks.
    """
    n_major, n_minor, single = block_counts()
    hashed = F.xxhash64("node")
    own = F.when(F.col("comp") == F.col("major"), -F.pmod(hashed, n_major)).otherwise(1 + F.pmod(hashed, n_minor)).cast("int")
    others = F.when(F.col("comp") == F.col("major"), F.sequence(F.lit(1), n_minor)).otherwise(F.sequence(1 - n_major, n_minor))
    others = F.when(single, F.array(F.lit(1))).otherwise(others)
    own = F.when(single, F.lit(1)).otherwise(own)
    met = rows.withColumn("own", own).withColumn("other", F.explode(others))
    return met.select("bucket", "node", "n", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *more)


def within(open_rows: DataFrame, sketches: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (node, hub) that join all components which verified pairs in the open buckets join."""

    def partners(sketch: np.ndarray, n: np.ndarray, comp: np.ndarray, k: int) -> np.ndarray:
        """Nodes after the k-th that may be similar to it and have another component."""
        rest = slice(k + 1, None)
        fit = (comp[rest] != comp[k]) & (np.minimum(n[rest], n[k]) >= least * np.maximum(n[rest], n[k]) - 1e-9)
        at = np.flatnonzero(fit) + k + 1
        return at[(sketch[at] == sketch[k]).sum(1) >= (least - SLACK) * sketch.shape[1]]

    def arrays(group: pa.Table):
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(group.num_rows, -1)
        return sketch, group.column("n").to_numpy(), group.column("comp").to_numpy()

    def promising(group: pa.Table) -> pa.Table:
        sketch, n, comp = arrays(group)
        keep = np.zeros(group.num_rows, bool)
        for k in range(group.num_rows - 1):
            at = partners(sketch, n, comp, k)
            keep[at] = True
            keep[k] |= bool(len(at))
        return group.select(["bucket", "i", "j", "node", "n", "comp"]).filter(pa.array(keep))

    def links(group: pa.Table) -> pa.Table:
        sketch, n, comp = arrays(group)
        items = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        node, comp, found = group.column("node").to_numpy(), comp.copy(), []
        for k in range(group.num_rows - 1):
            for m in partners(sketch, n, comp, k).tolist():
                if comp[m] != comp[k] and similar(items[k], items[m], least):
                    found.append((max(node[k], node[m]), min(node[k], node[m])))
                    comp[comp == comp[m]] = comp[k]
        return pa.table({"node": pa.array([int(a) for a, _ in found], pa.int64()), "hub": pa.array([int(b) for _, b in found], pa.int64())})

    keys = ["bucket", "i", "j"]
    columns = "bucket bigint, i int, j int, node bigint, n bigint, comp bigint"
    met = blocks(beside(open_rows, sketches), "sketch")
    some = written(met.groupBy(*keys).applyInArrow(promising, columns), "promising", open_rows.count(), 2_000)
    full = beside(some, sketches, sets).select(*keys, "node", "n", "comp", "sketch", "items")
    return full.groupBy(*keys).applyInArrow(links, "node bigint, hub bigint").distinct()


def bucketed(rows: DataFrame, total: int) -> DataFrame:
    """Rows (node, n, bucket) whose bucket has others, with the bucket's hub (its smallest node), the hub's n, and size."""
    first = rows.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    buckets = written(first.select("bucket", F.col("first.node").alias("hub"), F.col("first.n").alias("hub_n"), F.col("c").alias("size"), "c"), "buckets", total, 200_000)
    # Rows without a partner keep null here, so the join's size doesn't depend on how many texts resemble each other.
    return written(lookup(rows, buckets, "bucket", "c", total).filter("hub is not null"), "members", total, 200_000)


def refined(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, comp) by finer bands of an independent signature, for the given nodes (node, comp)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                items = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("items")]
                counts = np.array([len(x) for x in items], np.int64)
                of = np.repeat(np.arange(len(items)), counts)
                signatures = bag_signatures(mix(np.concatenate(items) + _SEED), of, np.ones(len(of), np.int64), len(items), FINE_BANDS * FINE_ROWS)
                found = band_hashes(signatures, FINE_BANDS, FINE_ROWS)
                node, comp = (np.repeat(part.column(c).to_numpy(), FINE_BANDS) for c in ("node", "comp"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.ravel(), node, np.repeat(counts, FINE_BANDS), comp)], names=["bucket", "node", "n", "comp"])

    return map_arrow(sets.join(nodes, "node").select("node", "comp", "items"), run, "bucket bigint, node bigint, n bigint, comp bigint")


def relabelled(comp: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """The labels (node, comp) after further links between nodes: only the labels that the links join are searched.

    Hubs and labels may have any share of the rows, so both are looked up.
    """
    n = links.count()
    hubs = links.groupBy("hub").agg(F.count("*").alias("c")).join(comp.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), "hub")
    hubs = written(hubs, "hub-labels", n)
    named = lookup(links.join(comp.select("node", F.col("comp").alias("node_comp")), "node").select("node_comp", "hub"), hubs, "hub", "c", n)
    joined = components(named.filter("node_comp <> hub_comp").select(F.col("node_comp").alias("node"), F.col("hub_comp").alias("hub")))
    joined = joined.select(F.col("node").alias("comp"), F.col("comp").alias("joined"))
    labels = written(comp.groupBy("comp").agg(F.count("*").alias("c")).join(joined, "comp"), "joined-labels", rows)
    return written(lookup(comp, labels, "comp", "c", rows).select("node", F.coalesce("joined", "comp").alias("comp")), "components", rows)


def near(a: str, b: str, least: float):
    """Whether the sizes allow the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least)


def classes_of(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) for each row of docs (doc_id, text); class_id is the class's smallest doc_id."""
    with scratch() as kept:
        signed = written(sign(docs, bands, rows), "signatures")
        total = signed.count()
        nodes = written(
            signed.filter("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
            "nodes",
            total,
            20_000,
        )
        members = bucketed(nodes.filter("n > 0").select("node", "n", F.explode("bands").alias("bucket")), total * bands)
        near_rows = members.count()
        wanted = written(members.select("node").distinct(), "candidates", near_rows)
        plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        # Both joins carry all documents, so they keep their partitions, however few documents are wanted.
        sets = written(multiset_table(plain.join(wanted.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi")), "multisets")
        sketches = written(nodes.select("node", "sketch").join(wanted, "node", "left_semi"), "sketches")

        tested = written(members.filter((F.col("node") != F.col("hub")) & near("n", "hub_n", least)).select("node", "hub").distinct(), "pairs", near_rows)
        comp = relabelled(wanted.select("node", F.col("node").alias("comp")), written(verified(tested, sketches, sets, least), "links", tested.count(), 2_000), near_rows)
        # Components are joined to nodes, and their bands listed after that. The pair of a bucket of two is done.
        banded = nodes.select("node", "n", "bands").join(comp, "node").select(F.explode("bands").alias("bucket"), "node", "n", "comp")
        open_rows = still_open(banded, total * bands, 3)
        large = written(open_rows.filter(split_further(bands)).select("node", "comp").distinct(), "large-bucket-nodes", near_rows)
        if not large.isEmpty():
            some = large.count()
            fine = still_open(written(refined(sets, large), "fine-bands", some, 500), some * FINE_BANDS)
            open_rows = open_rows.filter(~split_further(bands)).unionByName(fine)
        if not open_rows.isEmpty():
            comp = relabelled(comp, written(within(open_rows, sketches, sets, least), "links", open_rows.count(), 2_000), near_rows)
        final = nodes.join(comp, "node", "left").select("key", F.coalesce("comp", "node").alias("class_id"), "copies")
        final = written(final, "classes", total)
        kept += [signed, final]
        out = lookup(signed.select("doc_id", "key"), final, "key", "copies", total)
        return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each class: the smallest doc_id's. Rows with a null doc_id stay.

    Rows that repeat both doc_id and text count once.
    """
    with scratch() as lasting:
        classes = written(classes_of(docs), "document-classes")
        lasting.append(classes)
    kept = classes.filter("doc_id = class_id").groupBy("doc_id").count()
    # Ids grow with the corpus, so they aren't broadcast, however few they are in a small one.
    ids = kept.select("doc_id").hint("merge")
    out = docs.join(ids, docs["doc_id"].cast("bigint") == ids["doc_id"], "left_semi")
    if not kept.filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    if not classes.filter("doc_id is null").isEmpty():
        out = out.unionByName(docs.filter("doc_id is null"))
    return out


def still_open(labelled: DataFrame, total: int, least: int = 2) -> DataFrame:
    """Of rows (bucket, node, n, comp), those of buckets of ``least`` rows that hold several components: (bucket, node,
    n, comp, major, minor, minor_items, items, rows).

    ``major`` is the bucket's largest component, ``minor`` the number of its rows of other components; items are the
    occurrences of its rows.
    """
    sizes = labelled.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("items"))
    top = sizes.groupBy("bucket").agg(F.max(F.struct("c", "comp", "items")).alias("most"), F.count("*").alias("k"), F.sum("c").alias("rows"), F.sum("items").alias("items")).filter((F.col("k") > 1) & (F.col("rows") >= least))
    minor = [(F.col("rows") - F.col("most.c")).alias("minor"), (F.col("items") - F.col("most.items")).alias("minor_items")]
    top = written(top.select("bucket", F.col("most.comp").alias("major"), *minor, "items", "rows", F.col("rows").alias("c")), "open-buckets", total, 200_000)
    return written(lookup(labelled, top, "bucket", "c", total).filter("major is not null"), "open-rows", total, 200_000)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of(read_table(spark, sf_dir, "documents"))
