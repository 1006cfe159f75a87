"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension, set where the value is above 0. Codes are cut into ``SEGMENTS``; an
index has, for each segment, the codes in order of the segment's value. A query looks up all values within a radius
of its own segments, the radius growing by one in one segment after the other. Once segments 0..j have been searched
to radius r and the others to r - 1, every code within distance SEGMENTS * r + j has been met, so the search
ends when the k-th verified distance is at most that. Results are exact.

At scale: equal codes are one code, with its k smallest ids, by an aggregation before anything else, so a vector that
many rows share costs one code. Distinct codes are dealt into index blocks of bounded size (``BLOCK_CODES``, and
fewer where that would leave cores idle); distinct query codes, ``QUERY_CODES`` at a time, meet every index block in
one pass over the index; each pair of blocks gives k candidates a query, of which an aggregation keeps the k nearest.
No pair of rows is made beyond that. A task holds one block, its index and a small part of its results. The query ids
of a code, which may be many, are looked up at the end.

Order: distance, then id. Defined cases: a null embedding, or one that is empty or has a null in it, has no code: it
is neither found nor a query; NaN counts as not above 0; vectors of different lengths are apart from each other (only
codes of one length are compared); a null id is neither found nor a query; repeated ids with equal codes are one row;
fewer than k rows give fewer results; an empty table gives none; further columns are ignored. A query finds itself.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, map_arrow, read_table, scratch, written

K, SEGMENTS, QUERY_EACH = 10, 4, 50
BLOCK_CODES, LEAST_BLOCK, QUERY_CODES = 1 << 20, 1 << 13, 1 << 18
#: Queries whose results a task holds at a time.
ANSWERS = 2048


@lru_cache(maxsize=128)
def masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(width), radius)], np.uint32)


class MultiIndex:
    """Codes (n, words of 64 bits) of ``bits`` bits, indexed by segments."""

    def __init__(self, codes: np.ndarray, bits: int, segments: int = SEGMENTS):
        self.codes, self.bits = codes, bits
        segments = max(1, min(segments if bits <= 16 * segments else -(-bits // 16), bits))
        edges = np.linspace(0, bits, segments + 1).astype(int)
        self.parts = [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:])]
        self.tables = []
        for a, width in self.parts:
            value = self.segment(codes, a, width)
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], np.arange((1 << width) + 1))
            self.tables.append((order, starts))

    @staticmethod
    def segment(codes: np.ndarray, a: int, width: int) -> np.ndarray:
        word, shift = divmod(a, 64)
        value = codes[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (codes[:, word + 1] << np.uint64(64 - shift))
        return (value & np.uint64((1 << width) - 1)).astype(np.int64)

    def nearest(self, query: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, distances) of enough codes, nearest first, for k rows; ``weights``: rows of each code.

        All codes as near as the last one needed are given, so ties can be settled by id.
        """
        seen = np.zeros(len(self.codes), bool)
        found, near = [], []
        counts = np.zeros(self.bits + 2, np.int64)
        keys = [int(self.segment(query[None, :], a, w)[0]) for a, w in self.parts]
        for radius in range(max(w for _, w in self.parts) + 1):
            for j, ((_, width), (order, starts)) in enumerate(zip(self.parts, self.tables)):
                if radius > width:
                    continue
                values = masks(width, radius).astype(np.int64) ^ keys[j]
                lo, hi = starts[values], starts[values + 1]
                n = hi - lo
                total = int(n.sum())
                if total:
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                    new = order[at]
                    new = new[~seen[new]]
                    if len(new):
                        seen[new] = True
                        d = np.bitwise_count(self.codes[new] ^ query).sum(1).astype(np.int64)
                        found.append(new)
                        near.append(d)
                        counts += np.bincount(d, weights[new], minlength=len(counts)).astype(np.int64)
                # Every code within this distance has been met: in each segment the search has gone past its share.
                covered = len(self.parts) * radius + j
                reach = np.cumsum(counts)
                kth = int(np.searchsorted(reach, k))
                if kth <= covered and kth < len(counts):
                    where, dist = np.concatenate(found), np.concatenate(near)
                    keep = dist <= kth
                    order_out = np.argsort(dist[keep], kind="stable")
                    return where[keep][order_out], dist[keep][order_out]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, dist = np.concatenate(found), np.concatenate(near)
        order_out = np.argsort(dist, kind="stable")
        return where[order_out], dist[order_out]


def code_of(embedding: str):
    """A vector's code as text of 0 and 1, or null."""
    bit = lambda x: F.when(~F.isnan(x.cast("double")) & (x > 0), F.lit("1")).otherwise(F.lit("0"))
    usable = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, lambda x: x.isNull())
    return F.when(usable, F.array_join(F.transform(embedding, bit), ""))


def packed_codes(texts: list[str]) -> np.ndarray:
    """Codes of one length as rows of 64-bit words; bit i of the code is bit i % 64 of word i // 64."""
    bits = np.frombuffer("".join(texts).encode(), np.uint8).reshape(len(texts), -1) - 48
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little").view("<u8")


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of rows (id, embedding) for each of queries (id, embedding)."""
    spark = rows.sparkSession
    coded = rows.filter("id is not null").select(F.col("id").cast("bigint").alias("id"), code_of("embedding").alias("code")).filter("code is not null")
    # The k smallest ids of a code: the smallest of each of many buckets of ids come first, so no list grows with a code's rows.
    distinct = coded.groupBy("code", "id").count().select("code", "id")
    with scratch() as kept:
        codes = written(smallest(distinct, "code", "id", k).withColumn("bits", F.length("code")), "codes")
        asked = queries.filter("id is not null").select(F.col("id").cast("bigint").alias("query_id"), code_of("embedding").alias("code")).filter("code is not null")
        asked = written(asked.distinct(), "queries")
        query_codes = written(asked.groupBy("code").agg(F.count("*").alias("asked")), "query-codes")
        n_codes, n_queries = codes.count(), query_codes.count()
        blocks = max(1, -(-n_codes // BLOCK_CODES), min(spark.sparkContext.defaultParallelism, -(-n_codes // LEAST_BLOCK)))
        slices = max(1, -(-n_queries // QUERY_CODES))
        dealt = codes.repartition(blocks, F.xxhash64("code"))
        parts = []
        for s in range(slices):
            some = query_codes.filter(F.pmod(F.xxhash64("code"), F.lit(slices)) == s).select("code").collect()
            by_length: dict[int, list[str]] = {}
            for r in some:
                by_length.setdefault(len(r["code"]), []).append(r["code"])
            parts.append(map_arrow(dealt, block_search(spark.sparkContext.broadcast(by_length), k), "code string, id bigint, distance int"))
        met = parts[0]
        for part in parts[1:]:
            met = met.unionByName(part)
        best = met.groupBy("code").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "id"))), 1, k).alias("best"))
        best = written(best.join(query_codes, "code"), "nearest")
        kept += [asked, best]
    found = lookup(asked, best, "code", "asked", max(1, asked.count())).select("query_id", F.posexplode("best").alias("rank", "hit"))
    return found.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("id"), F.col("hit.distance").alias("distance"))


def smallest(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, ids): the k smallest distinct values of each key, in order, with no list beyond k for each of 64 parts."""
    ranked = rows.withColumn("part", F.pmod(F.xxhash64(value), F.lit(64)))
    lists = ranked.groupBy(key, "part").agg(F.slice(F.sort_array(F.collect_list(value)), 1, k).alias("ids"))
    return lists.groupBy(key).agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"))


def block_search(shared, k: int):
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        lengths = table.column("bits").to_numpy()
        for bits, queries in sorted(shared.value.items()):
            here = np.flatnonzero(lengths == bits)
            if not len(here):
                continue
            part = table.take(pa.array(here))
            index = MultiIndex(packed_codes(part.column("code").to_pylist()), bits)
            ids = part.column("ids").combine_chunks()
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            weights = np.diff(offsets)
            for first in range(0, len(queries), ANSWERS):
                some = queries[first : first + ANSWERS]
                out_code, out_id, out_distance = [], [], []
                for text, query in zip(some, packed_codes(some)):
                    where, distance = index.nearest(query, weights, k)
                    got = np.concatenate([flat[offsets[w] : offsets[w + 1]] for w in where.tolist()]) if len(where) else np.zeros(0, np.int64)
                    far = np.repeat(distance, weights[where])
                    order = np.lexsort((got, far))[:k]
                    out_code += [text] * len(order)
                    out_id.append(got[order])
                    out_distance.append(far[order])
                yield pa.RecordBatch.from_arrays([pa.array(out_code, pa.string()), pa.array(np.concatenate(out_id), pa.int64()), pa.array(np.concatenate(out_distance).astype(np.int32))], names=["code", "id", "distance"])

    return run


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search(rows, rows.filter(F.col("id") % QUERY_EACH == 0))


OP3_SQL = f"""
with c as (
  select distinct vec_id as id, array_to_string([case when x > 0 and not isnan(x) then '1' else '0' end for x in embedding], '') as code
  from embeddings where vec_id is not null and len(embedding) > 0 and not list_contains([x is null for x in embedding], true)
), d as (
  select q.id as query_id, r.id as id, cast(hamming(q.code, r.code) as int) as distance
  from c q join c r on len(q.code) = len(r.code) where q.id % {QUERY_EACH} = 0
), k as (
  select *, cast(row_number() over (partition by query_id order by distance, id) as int) as rank from d
)
select query_id, rank, id, distance from k where rank <= {K}
"""
