"""Shared helpers: reading tables, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many rows of at most 64 bytes are broadcast after they have been counted.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a local run gets a temporary
    folder; a cluster, whose executors would not see it, gets an error.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="impactloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with null-safe keys; ``small`` is broadcast if it has at most ``limit`` rows.

    ``small`` should be cheap to count (cut it first).  With more rows both sides are shuffled.
    Its key columns do not appear in the result; the keys of ``big`` do.
    """
    side = small.select(*[F.col(c).alias(f"__{c}" if c in on else c) for c in small.columns])
    if small.limit(limit + 1).count() <= limit:
        side = F.broadcast(side)
    cond = None
    for c in on:
        this = F.col(c).eqNullSafe(F.col(f"__{c}"))
        cond = this if cond is None else cond & this
    return big.join(side, cond, how).drop(*[f"__{c}" for c in on])


def without_rows(docs: DataFrame, gone: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not in ``gone`` (id, text_hash), which should be cheap to count.

    A row is known by its identifier, null or not, and its text together: rows that only share one of them stay.
    """
    marked = known_rows(docs, text, key)
    return join_small(marked, gone.select("id", "text_hash"), ["id", "text_hash"], "left_anti").select("row.*")


def known_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row, id, text_hash): rows as one struct each, so that none of their columns clashes with what is joined."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("text_hash"))


def give_back() -> None:
    """Give memory that is free again back to the system; Python workers live on, and would keep it beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which gives its memory back at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
