"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is found in a document if at least ``LEAST`` of the item's distinct five-word shingles occur in the document.
Jaccard similarity says little about a short item in a long document, so both sides are partitioned by size: items by
the power of two below their number of shingles, and, for each such class, documents into blocks of at most twice the
class's largest size. Items and blocks are sketched by one-permutation MinHash: a shingle's hash chooses a bin, and
the bin keeps its least hash. Small classes have more bins, as they have fewer chances to match. An item and a block
that agree on any bin make a candidate; the document's whole shingle set then decides. So a document is read once, in
its own task, without a shuffle, and an item that is spread over several blocks still counts as a whole.

Items with equal shingles are one row with their ids beside; the ids of a much repeated item are dealt to several rows
of about ``IDS_A_ROW``. Rows come in groups of bounded size (``ITEMS_AT_ONCE`` rows, ``BYTES_AT_ONCE`` bytes of shingles
and ids on average); a group is sent to the tasks, and the documents are read once for each group. All items are
searched.

Chance of a miss: items of one shingle are looked up among all shingles of a document, so none is missed. Otherwise a
shingle is its bin's least with a probability of at least 0.63, and an item of n shingles is missed only if none of
its 0.8 n or more shared shingles is.

Defined cases: a null or wordless text, of an item or a document, matches nothing; a text of one to four words has one
shingle, of all its words, and matches only another such text; a null id stays null; repeated rows give repeated rows,
also where ids are equal and texts are not; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, scratch, written
from .shingles import shingles
from .textcore import packed, text_slices, texts_of

LEAST = 0.8
ITEMS_AT_ONCE, BYTES_AT_ONCE, IDS_A_ROW = 20_000, 64 << 20, 1000
FILTER_BITS = 22


def block_size(size_class: int) -> int:
    return 2 << size_class


def bins(size_class: int) -> int:
    return block_size(size_class) << max(0, 8 - 2 * size_class)


def bin_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, shingles): each item's distinct shingle hashes as bytes; items without words are left out."""

    def run(batches):
        for batch in batches:
            ids, values, done = [], [], 0
            every = batch.column("item_id").to_pylist()
            for _, _, pack in packed([t.lower() for t in texts_of(batch.column("text"))]):
                hashes, counts = shingles(pack)
                at = 0
                for n in counts.tolist():
                    if n:
                        ids.append(every[done])
                        values.append(np.unique(hashes[at : at + n]).tobytes())
                    at += n
                    done += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary())], names=["item_id", "shingles"])

    return map_arrow(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text"), run, "item_id bigint, shingles binary")


class Index:
    """Some items' ids and shingles, and for each size class the sketches' values in order with the items that have
    them."""

    def __init__(self, rows: list[tuple[list[int | None], bytes]]):
        self.ids = [i for i, _ in rows]
        self.sets = [np.frombuffer(b, np.uint64) for _, b in rows]
        by_class: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            by_class.setdefault(int(math.log2(len(s))), []).append(k)
        self.classes = []
        for c, members in sorted(by_class.items()):
            values, owners = [], []
            for k in members:
                s = self.sets[k]
                at = bin_of(s, bins(c))
                _, first = np.unique(at, return_index=True)  # the set is sorted, so a bin's first is its least
                values.append(s[first])
                owners.append(np.full(len(first), k))
            value, owner = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            maybe = np.zeros(1 << FILTER_BITS, bool)
            maybe[value & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.classes.append((c, value, owner, maybe))

    def candidates(self, hashes: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a bin's value in some block."""
        found: set[tuple[int, int]] = set()
        of = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
        for c, value, owner, maybe in self.classes:
            if c == 0:  # one shingle: no sketch is needed
                least, text_at = hashes, of
            else:
                size, n = block_size(c), bins(c)
                per_text = (counts + size - 1) // size
                block = (np.cumsum(per_text) - per_text)[of] + place // size
                codes, keys = pd.factorize(block * n + bin_of(hashes, n))
                least = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(least, codes, hashes)
                text_at = np.repeat(np.arange(len(counts)), per_text)[keys // n]
            hit = np.flatnonzero(maybe[least & np.uint64((1 << FILTER_BITS) - 1)])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(value, least[hit], "left"), np.searchsorted(value, least[hit], "right")
            real = hi > lo
            if not real.any():
                continue
            for t, a, b in zip(text_at[hit[real]].tolist(), lo[real].tolist(), hi[real].tolist()):
                found.update((t, k) for k in owner[a:b].tolist())
        return found

    def matches(self, texts: list[str], least: float = LEAST):
        """(text's number, item's number, shared shingles) of every item found in a text."""
        for i, _, pack in packed([t.lower() for t in texts]):
            hashes, counts = shingles(pack)
            if not len(hashes):
                continue
            stops = np.cumsum(counts)
            by_text: dict[int, list[int]] = {}
            for t, k in self.candidates(hashes, counts):
                by_text.setdefault(t, []).append(k)
            for t, items in sorted(by_text.items()):
                have = np.sort(hashes[stops[t] - counts[t] : stops[t]])
                for k in sorted(items):
                    s = self.sets[k]
                    shared = int((have[np.minimum(np.searchsorted(have, s), len(have) - 1)] == s).sum())
                    if shared >= least * len(s) - 1e-9:
                        yield i + t, k, shared


def index_groups(items: DataFrame):
    """The items as broadcast Index objects of bounded size, one after the other."""
    spark = items.sparkSession
    with scratch() as kept:
        each = written(item_shingles(items), "benchmark-shingles")
        spread = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-each.count() // IDS_A_ROW))))
        alike = each.groupBy("shingles", spread.alias("part")).agg(F.collect_list(F.struct("item_id")).alias("ids"))
        table = written(alike.select("shingles", "part", F.col("ids.item_id").alias("ids")), "benchmark-items")
        kept.append(table)
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("shingles") + 8 * F.size("ids")), F.lit(0)).alias("bytes")).first()
    groups = max(1, math.ceil(size["n"] / ITEMS_AT_ONCE), math.ceil(size["bytes"] / BYTES_AT_ONCE))
    order = lambda i: (i is None, i or 0)
    for g in range(groups):
        rows = table.filter(F.pmod(F.xxhash64("shingles", "part"), F.lit(groups)) == g).collect()
        if rows:
            listed = [(sorted(r["ids"], key=order), bytes(r["shingles"])) for r in rows]
            yield spark.sparkContext.broadcast(Index(sorted(listed, key=lambda r: (order(r[0][0]), r[1]))))


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for each document and item found in it."""
    schema = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint"
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def finder(shared):
        def run(batches):
            for batch in batches:
                index, ids = shared.value, batch.column("doc_id").to_pylist()
                rows = [(ids[at + t], item, n, len(index.sets[k])) for at, texts in text_slices(batch) for t, k, n in index.matches(texts, least) for item in index.ids[k]]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_shared", "n_item"])

        return run

    parts = [map_arrow(plain, finder(shared), schema) for shared in index_groups(items)]
    found = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents, all columns, in which no item is found."""

    def dropper(shared):
        def run(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[at + t for at, texts in text_slices(batch) for t, _, _ in shared.value.matches(texts, least)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for shared in index_groups(items):
        docs = map_arrow(docs, dropper(shared), docs.schema)
    return docs


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item")


OP9_SQL = r"""
with texts as (
  select 0 as side, doc_id as id, row_number() over () as k, text from documents
  union all
  select 1, item_id, row_number() over (), text from benchmark
), words as (
  select side, id, k, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from texts
), starts as (
  select side, id, k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0
), s as (
  select distinct side, id, k, array_to_string(w[i:i + 4], ' ') as shingle from starts
), n as (
  select k, count(*) as n_item from s where side = 1 group by k
)
select d.id as doc_id, b.id as item_id, count(*) as n_shared, any_value(n_item) as n_item
from s b join s d on b.shingle = d.shingle and d.side = 0 join n on n.k = b.k
where b.side = 1 group by d.k, b.k, d.id, b.id having count(*) >= 0.8 * any_value(n_item) - 1e-9
"""
