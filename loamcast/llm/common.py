"""Shared pieces of the corpus operators: stage tables, raw text access, row keys."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Where the setting is absent a temporary folder is set for a session whose executors share the
    driver's machine (local masters, as in tests); on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loamcast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class StageTable:
    """A DataFrame written as Parquet in the shared folder; reading it needs no earlier stage."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, *names: str) -> str | list[str]:
    """Names like these that no column of df has (case apart), for columns beside the caller's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out[0] if len(out) == 1 else out


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., which no column that an operator adds is called."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def restored(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The columns c0, c1, ... under their own names again, and more behind them."""
    return df.select(*(f"c{k}" for k in range(len(names))), *more).toDF(*names, *more)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, or its stage table where its rows could come in another order when they are computed again.

    Files and given rows are read alike each time; what comes out of a shuffle isn't, so row numbers over
    it must not be computed twice.
    """
    left = [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() not in ("Project", "Filter") and not node.nodeName().startswith(("LogicalRelation", "Relation", "LocalRelation", "LogicalRDD", "Scan ExistingRDD")):
            return stage(df, name)
        kids = node.children()
        left += [kids.apply(k) for k in range(kids.size())]
    return df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    out = StageTable(df, name).df
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of stages that nothing refers to any more.

    The scheduler knows its last job until the next one comes, so a job of one row comes first.
    """
    gc.collect()
    spark.range(0, 1, 1, 1).collect()
    spark.sparkContext._jvm.System.gc()


_holders: list[Callable[[], None]] = []


def holder(clear: Callable[[], None]) -> None:
    """Register what lets go of the tables that a module keeps in a worker for its next task."""
    _holders.append(clear)


def make_room() -> None:
    """In a worker, at the start of another operator's work: give kept tables and free memory back."""
    for clear in _holders:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


def slices(batch: pa.RecordBatch, text: int, most: int = 8 << 20):
    """The batch in pieces of about `most` text bytes, so that a piece's arrays stay small."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def word_count(text):
    """Number of words of a text column, JVM-side; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
