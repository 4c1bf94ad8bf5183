"""Exact deduplication by content sort.

Normalised texts are range-partitioned by sampled splitters, sorted inside each partition by Spark's external
sort, and compared in full with their neighbour, also over the edges of batches and partitions.  A splitter holds
the first 24 characters of a text, its SHA-256 and the row's identifier: it stays short however long texts are, texts
that begin alike are split, equal texts keep neighbouring places in the order of their identifiers, and one text with
a third of all rows is spread over many partitions.  The digest only orders texts; what decides is the comparison.

Runs of equal texts are numbered per partition.  What goes on over an edge are the first and the last run of a
partition, two rows for each: their texts are compared with those of the partitions beside, runs that continue are
chained, and the chains' sizes and keepers come back by (partition, run).  A task holds one text, and 8 bytes for
each row of the run that it is in.

Null texts count as empty; a null identifier loses to any other.  Of rows that agree in text and identifier exactly
one is kept.  Texts of any length are compared whole.  An empty table gives an empty result; other columns are
ignored by ``mark`` and kept, whatever their names, by ``distinct_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, frugal, join_small
from .text import ascii_lower

_MARKS = "id long, keep long, head boolean, total long, digest binary, part int, run long, edge string"


def _starts(norm: pa.Array, before: str | None) -> np.ndarray:
    """Where texts differ from the one before them; ``before`` is the last one of the batch before."""
    change = np.ones(len(norm), bool)
    change[0] = before is None or norm[0].as_py() != before
    if len(norm) > 1:
        change[1:] = pc.not_equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _edge(part: int, run: int, text: str, schema: pa.Schema, **more: int | None) -> pa.RecordBatch:
    """One row that tells of a run at the edge of a partition."""
    known = {"part": part, "run": run, "edge": text, **more}
    return pa.RecordBatch.from_arrays([pa.array([known.get(f.name)], f.type) for f in schema], schema=schema)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (norm, id, digest) to ``_MARKS``; rows of edge runs without a total, and a row with ``edge`` for each such run."""
    part, run, text, digest, held = TaskContext.get().partitionId(), -1, None, None, []
    schema = pa.schema(
        [("id", pa.int64()), ("keep", pa.int64()), ("head", pa.bool_()), ("total", pa.int64()), ("digest", pa.binary()), ("part", pa.int32()), ("run", pa.int64()), ("edge", pa.string())]
    )

    def rows(ids: pa.Array, digests: pa.Array, sizes: np.ndarray, first: int, at_edge: bool) -> pa.RecordBatch:
        starts = np.cumsum(sizes) - sizes
        head = np.zeros(len(ids), bool)
        head[starts] = True
        total = pa.nulls(len(ids), pa.int64()) if at_edge else pa.array(np.repeat(sizes, sizes), pa.int64())
        runs = np.repeat(np.arange(first, first + len(sizes)), sizes)
        keep = ids.take(pa.array(np.repeat(starts, sizes)))
        return pa.RecordBatch.from_arrays([ids, keep, pa.array(head), total, digests, pa.array(np.full(len(ids), part, np.int32)), pa.array(runs, pa.int64()), pa.nulls(len(ids), pa.string())], schema=schema)

    def ended(last: bool) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(held)
        if last or run == 0:
            yield _edge(part, run, text, schema, total=len(ids), keep=ids[0].as_py())
        yield rows(ids, pa.array([digest] * len(ids), pa.binary()), np.array([len(ids)]), run, last or run == 0)

    for batch in batches:
        if not batch.num_rows:
            continue
        norm, ids, digests = batch.column("norm"), batch.column("id"), batch.column("digest")
        starts = _starts(norm, text)
        copied = ids.take(pa.array(np.arange(len(ids))))  # a slice would hold on to the texts of the batch
        if not len(starts):
            held.append(copied)
            continue
        if starts[0]:
            held.append(copied.slice(0, int(starts[0])))
        if held:
            yield from ended(False)
        if run < 0 and len(starts) > 1:  # the partition's first run ends in its first batch
            run, text, digest, held = 0, norm[0].as_py(), digests[0].as_py(), [copied.slice(0, int(starts[1]))]
            yield from ended(False)
            starts = starts[1:]
        a, z = int(starts[0]), int(starts[-1])
        if z > a:
            yield rows(copied.slice(a, z - a), digests.slice(a, z - a), np.diff(starts), run + 1, False)
        run, text, digest, held = run + len(starts), norm[z].as_py(), digests[z].as_py(), [copied.slice(z)]
    if held:
        yield from ended(True)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (norm, row) to the first row of each run (row, part, run), and a row with ``edge`` for each edge run."""
    part, run, text, schema = TaskContext.get().partitionId(), -1, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column("norm")
        starts = _starts(norm, text)
        schema = schema or pa.schema([batch.schema.field("row"), ("part", pa.int32()), ("run", pa.int64()), ("edge", pa.string())])
        if run < 0:
            yield _edge(part, 0, norm[0].as_py(), schema)
        if len(starts):
            n = len(starts)
            runs = pa.array(np.arange(run + 1, run + 1 + n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(starts)), pa.array(np.full(n, part, np.int32)), runs, pa.nulls(n, pa.string())], schema=schema)
            run += n
        text = norm[batch.num_rows - 1].as_py()
    if run > 0:
        yield _edge(part, run, text, schema)


def _ordered(df: DataFrame, text: str, key: str, keep: str, partitions: int | None, carry: bool) -> DataFrame:
    """(norm, id, digest, row) sorted inside ranges; ``row`` only if it is to be carried."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []
    rows = df.select(ascii_lower(F.col(text)).alias("norm"), F.col(key).cast("long").alias("id"), *row)
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    order = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    begin = F.substring("norm", 1, 24)
    ranged = rows.repartitionByRange(partitions, begin, "digest", order) if partitions else rows.repartitionByRange(begin, "digest", order)
    return ranged.sortWithinPartitions(begin, "digest", "norm", order)


def _chained(edges: DataFrame) -> DataFrame:
    """Edge runs (part, run, edge, ...) with ``chain`` and ``goes_on``: whether a run continues that of the partition before it.

    There are two runs for each partition at most; only their numbers are put in one order, their texts meet by number.
    """
    edges = cut(edges)
    in_order = Window.orderBy("part", "run")
    before = edges.select("part", "run").withColumn("prior", F.lag(F.struct("part", "run")).over(in_order)).where((F.col("run") == 0) & F.col("prior").isNotNull())
    pairs = before.join(edges.select("part", "run", "edge"), ["part", "run"]).select("part", "run", "edge", F.col("prior.part").alias("p"), F.col("prior.run").alias("r"))
    earlier = edges.select(F.col("part").alias("p"), F.col("run").alias("r"), F.col("edge").alias("last"))
    same = pairs.join(earlier, ["p", "r"]).where(F.col("edge") == F.col("last")).select("part", "run", F.lit(True).alias("goes_on"))
    told = edges.drop("edge").join(same, ["part", "run"], "left").fillna(False, ["goes_on"])
    return told.withColumn("chain", F.sum((~F.col("goes_on")).cast("long")).over(in_order))


def mark(df: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """One row per row: ``key``, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    runs = cut(_ordered(df, text, key, keep, partitions, False).select("norm", "id", "digest").mapInArrow(frugal(_mark), _MARKS))
    chains = _chained(runs.where("edge is not null").select("part", "run", "edge", "total", "keep"))
    whole = Window.partitionBy("chain")
    # Later partitions hold later identifiers of a text, so the first run of a chain has the keeper.
    edges = cut(chains.select("part", "run", "goes_on", F.sum("total").over(whole).alias("all"), F.first("keep").over(whole.orderBy("part", "run")).alias("best")))
    return join_small(runs.where("edge is null"), edges, ["part", "run"], "left").select(
        F.col("id").alias(key),
        F.when(F.col("total").isNull(), F.col("best")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("total", "all").alias("group_size"),
        (F.col("head") & ~F.coalesce("goes_on", F.lit(False))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_rows(df: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """The rows of ``df``, with all their columns, of which one per text is left."""
    rows = _ordered(df, text, key, keep, partitions, True).select("norm", "row")
    schema = StructType().add("row", rows.schema["row"].dataType).add("part", "integer").add("run", "long").add("edge", "string")
    heads = cut(rows.mapInArrow(frugal(_heads), schema))
    chains = _chained(heads.where("edge is not null").select("part", "run", "edge"))
    again = cut(chains.where("goes_on").select("part", "run"))
    return join_small(heads.where("edge is null"), again, ["part", "run"], "left_anti").select("row.*")
