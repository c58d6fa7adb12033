"""Shared folder, written intermediate tables, and joins of checked size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns is sent to every executor.
BROADCAST_ROWS = 200_000

#: Bytes of text that a Python worker turns into objects at a time.
SLICE_BYTES = 4 << 20

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="marlstone-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/marlstone/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, codec: str = "snappy", partition: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder, in a folder for each value of ``partition``, and reads it back: cuts lineage, outlives executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path, partitionBy=partition)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.marlstone_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables written by ``materialise`` that no later step reads."""
    for t in tables:
        path = getattr(t, "marlstone_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small; else it is left to a shuffle join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df.hint("merge")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` is called like it, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose ``column`` has at most ``size`` bytes, or of one longer row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])
