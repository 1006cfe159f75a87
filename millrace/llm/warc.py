"""WARC archives with an index written first, read back by coalesced byte ranges.

Writing: each page becomes a record in a gzip member of its own. Of pages with equal payloads the one with the
smallest page_id is a response, the others are revisits that refer to it and hold no payload. Who is first is found
on digests alone, aggregated before any shuffle. Payloads so common that they could burden one task (over a
thousandth of all pages; so at most a thousand payloads) are matched by a broadcast, and their pages are dealt out
evenly; all others are joined by digest.

The index has a row for each record: file, offset, length, URL, digest. Readers take the index rows of the records
they want, sort them by place, join neighbouring ranges to larger reads, parse what they fetched, and hold each
record's digest against the index's: a record that isn't the one the index names is an error.

Defined cases: a null html is an empty payload; a null URL is an empty target; a null page_id comes after all others
as the first of its payload; rows that repeat the smallest page_id of a payload are all responses; an empty table
gives an empty index; further columns are ignored. Files have a name of their own for each attempt of a task, and the
index names the files of the attempts that counted, so a lost executor leaves at most unused files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicFile, file_system, lookup, map_arrow, new_dir, read_table, wide_enough, written

#: Payloads of fewer bytes are always responses.
LEAST_BYTES = 0
#: A payload that more than this share of all pages has is matched by a broadcast; there are at most 1 / HOT_SHARE.
HOT_SHARE = 0.001
#: Ranges closer than GAP are read together, up to READ bytes at once.
GAP, READ = 64 << 10, 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, file string, offset bigint, length bigint, url string, digest string"
RECORD = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, is_revisit: bool, date: str, digest: str) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if is_revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{'' if first is None else first}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[int | None, str, bytes, int, str, str, int | None]:
    """The fields of RECORD from one record's bytes; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't match its digest")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI", ""), payload, size, digest, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None


def with_first(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload) with ``first``, the page_id that the page revisits, and whether it does."""
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload")).withColumn("key", F.sha2("payload", 256))
    shared = written(
        rows.filter(F.length("payload") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"),
        "warc-shared",
    )
    found = lookup(rows, shared.select("key", "first", F.lit(True).alias("shared"), "n"), "key", "n", pages.count(), HOT_SHARE)
    is_revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", "payload", "key", "first", is_revisit.alias("is_revisit"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write all pages (page_id, url, html) as records below ``folder``; the index, itself written and read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = None, []
        name = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"

        def index() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "file", "offset", "length", "url", "digest"])

        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    for page in batch.slice(at, 500).to_pylist():
                        out = out or AtomicFile(name)
                        digest = base32_sha1(page["payload"])
                        raw = record(page["page_id"], page["url"], page["payload"], page["first"], page["is_revisit"], date, digest)
                        zipper = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = zipper.compress(raw) + zipper.flush()
                        rows.append((page["page_id"], name, out.size, len(member), page["url"], digest))
                        out.write(member)
                    yield index()
                    rows.clear()
        except BaseException as failure:
            if out:
                out.__exit__(type(failure), failure, None)
            raise
        if out:
            out.__exit__(None, None, None)

    ready = with_first(pages, least_bytes).sortWithinPartitions("page_id", "url", "key").drop("key")
    return written(map_arrow(ready, run, INDEX), "warc-index")


def coalesced(places: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges joined to reads (offset, length, ranges in it)."""
    reads: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in places:
        if reads and offset - reads[-1][0] - reads[-1][1] <= gap and offset + length - reads[-1][0] <= most:
            start, size, held = reads[-1]
            reads[-1] = (start, max(size, offset + length - start), held)
            held.append((offset, length))
        else:
            reads.append((offset, length, [(offset, length)]))
    return reads


def fetch(file: str, places: list[tuple[int, int]]) -> Iterator[bytes]:
    """The records, unpacked, at sorted places of a file."""
    fs, path = file_system(file)
    with fs.open_input_file(path) as source:
        for start, size, held in coalesced(places):
            data = memoryview(source.read_at(size, start))
            for offset, length in held:
                yield zlib.decompress(data[offset - start : offset - start + length], 31)


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (RECORD) that the selected index rows point to, parsed from the archives alone.

    ``payloads=False`` leaves the payload column null after its digest was checked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            by_file: dict[str, list[tuple[int, int, str]]] = {}
            for f, *place in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "digest"))):
                by_file.setdefault(f, []).append(tuple(place))
            rows, held = [], 0
            for file, places in by_file.items():
                for (offset, _, digest), raw in zip(places, fetch(file, [p[:2] for p in places]), strict=True):
                    got = parse(raw)
                    if got[4] != digest:
                        raise ValueError(f"{file} at {offset}: the record isn't the one that the index names")
                    rows.append(got if payloads else (*got[:2], None, *got[3:]))
                    held += len(got[2]) if payloads else 64
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    places = index.select("file", "offset", "length", "digest", F.floor(F.col("offset") / F.lit(64 << 20)).alias("part"))
    dealt = places.repartition(wide_enough(index.sparkSession), "file", "part").sortWithinPartitions("file", "offset")
    return map_arrow(dealt.select("file", "offset", "length", "digest"), run, RECORD)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(read_table(spark, sf_dir, "pages"), new_dir(spark, "warc"))
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (
  select page_id, coalesce(html, '') as payload, min(page_id) over (partition by coalesce(html, '')) as first_id from pages
), d as (
  select *, sha1(payload) as h from p
)
select page_id, cast(strlen(payload) as bigint) as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 5 * cast(i // 4 as int), 5))::bigint >> (15 - 5 * cast(i % 4 as int))) & 31))::int, 1) for i in range(0, 32)], '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from d
"""
