"""What the training-data operators share: inputs, the shared folder, and file access from executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of an input folder, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set for it if it runs on this machine alone; on a cluster
    executors couldn't read that, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context_dir = spark.sparkContext.getCheckpointDir()
    if not found and not context_dir and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not found:
        found = context_dir or "file://" + tempfile.mkdtemp(prefix="millrace-")
    if not context_dir:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_made: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("made", default=None)


def written(df: DataFrame, what: str, rows: int | None = None, per_file: int = 50_000) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there.

    ``rows``, an upper estimate of the rows, keeps small tables from many tiny files: there are at most as many files
    as ``per_file`` rows each need, and at most as many as ``df`` has partitions. It is for narrow rows whose number
    grows with the input; what carries whole texts keeps its partitions.
    """
    spark = df.sparkSession
    path = new_dir(spark, what)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    made = _made.get()
    if made is not None:
        made.append((table, path))
    return table


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that ``written`` makes inside are deleted at the end, but for those put in the list that it yields.

    What is returned from inside must read kept tables only. Tables kept by an inner ``scratch`` are up to the outer.
    """
    outer, made, kept = _made.get(), [], []
    token = _made.set(made)
    try:
        yield kept
    finally:
        _made.reset(token)
        for table, path in made:
            if not any(table is k for k in kept):
                drop_dir(table.sparkSession, path)
            elif outer is not None:
                outer.append((table, path))


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` whose tasks give free memory back to the system when they end.

    Python workers are kept for later tasks, and would hold on to what their largest slice took.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def release() -> None:
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_held: dict = {}


def worker_resource(key, make):
    """What ``make()`` gave in this process for ``key``; one such thing is held at a time, whatever operator it is of."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``new_dir`` or ``written`` made, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; a local path for ``file:`` or no scheme."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A binary file that appears under its name only when closed without an error.

    A task that is retried or run twice replaces the file whole, so readers never see a part of it.
    """

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def __enter__(self) -> "AtomicFile":
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def text_or_empty(name: str):
    """A text column with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def wide_enough(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a shuffle whose parts Python reads: the session's own setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lookup(left: DataFrame, right: DataFrame, key: str, count: str, total: int, share: float = 0.001) -> DataFrame:
    """``left`` with the columns of ``right`` (one row a key; null where none), safe for keys with many left rows.

    ``count`` is right's column with the number of left rows of its key. Keys that have more than ``share`` of
    ``total`` are at most 1 / share, so they are broadcast, and their left rows, which need no other partner, are
    dealt out by a hash of the whole row; all other keys are joined by a shuffle in which none stands out. ``right``
    is read twice, so it should be a written table.
    """
    names = [c for c in right.columns if c not in (key, count)]
    hot_side = right.filter(F.col(count) > F.lit(total * share)).select(F.col(key), F.struct(*names, F.lit(True).alias("__known")).alias("__hot"))
    cold_side = right.filter(F.col(count) <= F.lit(total * share)).select(F.col(key).alias("__cold_key"), F.struct(*names, F.lit(True).alias("__known")).alias("__cold"))
    # A row that no left row has keeps the plan the same where no key is hot; it stands for nothing if one had it.
    unused = F.lit("\0") if dict(right.dtypes)[key] == "string" else F.lit(-(1 << 63)).cast(dict(right.dtypes)[key])
    nothing = F.lit(None).cast(hot_side.schema["__hot"].dataType)
    hot_side = hot_side.unionByName(left.sparkSession.range(1).select(unused.alias(key), nothing.alias("__hot")))
    marked = left.join(F.broadcast(hot_side), key, "left")
    # Left rows with a hot key get a negative salt in a column of its own; a cold row has salt 0 there.
    marked = marked.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.xxhash64(*left.columns)).otherwise(F.lit(0).cast("bigint")))
    cold_side = cold_side.withColumn("__cold_salt", F.lit(0).cast("bigint"))
    joined = marked.join(cold_side.hint("merge"), (F.col(key) == F.col("__cold_key")) & (F.col("__salt") == F.col("__cold_salt")), "left")
    found = F.coalesce("__hot", "__cold")
    return joined.select(*left.columns, *(found[n].alias(n) for n in names))
