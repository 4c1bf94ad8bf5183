"""Merkle manifest of a dataset: leaves by group, trees of a fixed fan-out, proofs for every row.

A leaf is the SHA-256 of a row's fields (null as ``-``, else the UTF-8 byte count, ``:`` and the value).  The leaves of a
group stand in the order of their key; while more than one node remains, every ``FANOUT`` consecutive ones, the last run
maybe fewer and without padding, become the SHA-256 of their digests' hex text.  What remains is the group's root, and the
groups' roots in order of the groups (null first, by bytes) are the leaves of one more tree, whose top is the root.

Rows are dealt in ranges of (group, key), so a large group lies in many partitions.  A row for each partition tells the
index, within its group, of the first row of every partition.  With that index a partition keeps a mountain range: one
open run for each level.  A run that fills up is written, and its digest is carried to the next level.  Runs that reach over
an edge of the partition are written in pieces; they are a few for each partition and level, and a grouped job for each level
puts them together.  Proofs go down from the roots: each run gets the path of its parent, joined by (group, run).

Null keys come first; rows with equal keys stand in order of their leaves.  Equal rows are leaves of their own.  Null and
empty texts are different leaves, and so are null and empty groups.  Long texts are hashed whole.  An empty table has an
empty manifest.  Other columns are no part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FANOUT = 16
#: The level of the leaves themselves; that of their runs is 0.
LEAF = -1
_PATH = "array<struct<before: string, after: string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(fields: list[Column]) -> Column:
    """The digest of one row's fields."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return sha(F.concat(*told))


def fold(digest: Column, path: Column) -> Column:
    """The root that ``digest`` and the siblings of ``path`` lead to."""
    return F.aggregate(path, digest, lambda d, step: sha(F.concat(step["before"], d, step["after"])))


def proof(path: Column) -> Column:
    """The digest of all siblings, from the leaf's up to the root's."""
    return sha(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))))


class Forest(NamedTuple):
    #: (g, at, digest, item): every leaf with its index in its group.
    leaves: DataFrame
    #: (g, level, at, digests): every run of every level with the digests of its nodes.
    runs: DataFrame
    #: (g, depth, top): the levels of every group's tree, and its root.
    tops: DataFrame
    #: The most levels of a tree.
    depth: int


def depth_of(n: int) -> int:
    """The levels of runs over ``n`` leaves."""
    depth = 0
    while n > 1:
        n, depth = -(-n // FANOUT), depth + 1
    return depth


class _Range:
    """The open runs of one group within one partition, one for each level.

    ``total`` is the group's size; None if the group lies in this partition alone, for then it is known at its end.
    """

    def __init__(self, at: int, total: int | None, emit: Callable[..., None]) -> None:
        self.at, self.total, self.emit = at, total, emit
        self.depth = None if total is None else depth_of(total)
        self.open: list[list] = []  # by level: run, place of its first node, digests

    def leaves(self, digests: list[str]) -> None:
        self.add(0, self.at, digests)
        self.at += len(digests)

    def add(self, level: int, at: int, digests: list[str]) -> None:
        """Consecutive nodes of a level, from index ``at``."""
        if level == self.depth:
            return  # the group's root
        while len(self.open) <= level:
            self.open.append([])
        done = 0
        while done < len(digests):
            run, place = divmod(at + done, FANOUT)
            if not self.open[level]:
                self.open[level] = [run, place, []]
            taken = digests[done : done + FANOUT - place]
            self.open[level][2] += taken
            done += len(taken)
            if place + len(taken) == FANOUT:
                self.close(level, True)

    def close(self, level: int, full: bool) -> None:
        """Write an open run; a whole one is carried to the next level."""
        run, first, digests = self.open[level]
        self.open[level] = []
        whole = full and first == 0
        self.emit(self.depth, level, run, first, digests, whole)
        if whole:
            self.add(level + 1, run, [hashlib.sha256("".join(digests).encode()).hexdigest()])

    def end(self) -> None:
        """The group's last row in this partition has been added; short runs are whole only if it is the last of all."""
        if self.total is None:
            self.total, self.depth = self.at, depth_of(self.at)
        level = 0
        while level < min(len(self.open), self.depth):
            if self.open[level]:
                self.close(level, self.at == self.total)
            level += 1


_NODES = [("g", pa.string()), ("depth", pa.int32()), ("level", pa.int32()), ("at", pa.int64()), ("first", pa.int32()), ("digests", pa.list_(pa.string())), ("whole", pa.bool_())]


def _stacks(edges: dict[int, tuple[int, dict[str, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (part, g, digest, item) to leaves with their index, and runs.

    ``edges``: by partition, the index of its first row, and the sizes of those of its groups that reach over its edges.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: list[tuple] = []
        here: _Range | None = None
        group = None

        def runs(item: pa.DataType) -> Iterator[pa.RecordBatch]:
            if written:
                arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*written, strict=True), _NODES, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(written), item)], schema=pa.schema([*_NODES, ("item", item)]))
                written.clear()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            base, sizes = edges[batch.column("part")[0].as_py()]
            groups, digests = batch.column("g"), batch.column("digest").to_pylist()
            starts = np.flatnonzero(np.diff(groups.dictionary_encode().indices.to_numpy(), prepend=-1)).tolist()
            index = np.empty(n, np.int64)
            for begin, stop in zip(starts, [*starts[1:], n], strict=True):
                g = groups[begin].as_py()
                if g != group:
                    if here:
                        here.end()
                    here = _Range(0 if here else base, sizes.get(g), lambda *x, g=g: written.append((g, *x)))
                    group = g
                index[begin:stop] = np.arange(here.at, here.at + stop - begin)
                here.leaves(digests[begin:stop])
            each = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), batch.column("digest"))
            told = [groups, pa.nulls(n, pa.int32()), pa.array(np.full(n, LEAF, np.int32)), pa.array(index), pa.array(np.zeros(n, np.int32)), each, pa.array(np.ones(n, bool))]
            item = batch.column("item")
            yield pa.RecordBatch.from_arrays([*told, item], schema=pa.schema([*_NODES, ("item", item.type)]))
            yield from runs(item.type)
        if here:
            here.end()
            yield from runs(item.type)

    return run


def _edges(ranged: DataFrame) -> dict[int, tuple[int, dict[str, int]]]:
    """What ``_stacks`` needs of each partition; a row for each partition comes to the driver."""
    sizes = ranged.groupBy("part", "g").agg(F.count(F.lit(1)).alias("n"))
    row = F.struct("g", "n")
    found = sizes.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last")).orderBy("part").collect()
    before, totals = {}, {}
    group, n = None, 0
    for r in found:
        before[r["part"]] = n if r["first"]["g"] == group else 0
        for g, more in {r["first"]["g"]: r["first"]["n"], r["last"]["g"]: r["last"]["n"]}.items():
            n = n + more if g == group else more
            group, totals[g] = g, n
    return {r["part"]: (before[r["part"]], {g: totals[g] for g in (r["first"]["g"], r["last"]["g"])}) for r in found}


def forest(rows: DataFrame, order: list[Column]) -> Forest:
    """Trees over ``rows`` (g, digest, item, and what ``order`` names), one for each group, in the order given.

    ``g`` is not null and sorts as the groups do.  ``order`` should end with something that tells all rows apart, so that
    repeated rows are spread too.
    """
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    ranged = cut(dealt.select(F.spark_partition_id().alias("part"), "g", "digest", "item"))
    told = f"g string, depth int, level int, at long, first int, digests array<string>, whole boolean, item {ranged.schema['item'].dataType.simpleString()}"
    nodes = cut(ranged.mapInArrow(_stacks(_edges(ranged)), told))
    loose = nodes.where("NOT whole").select("g", "depth", "level", "at", "first", "digests")
    most = loose.agg(F.max("depth")).first()[0] or 0
    merged, carried = [], None
    for level in range(most):  # a few rows for each partition
        pieces = loose.where(F.col("level") == level)
        if carried:
            pieces = pieces.unionByName(carried)
        parts = F.array_sort(F.collect_list(F.struct("first", "digests")))
        whole = cut(pieces.groupBy("g", "depth", "at").agg(F.flatten(F.transform(parts, lambda p: p["digests"])).alias("digests")))
        merged.append(whole.select("g", F.lit(level).alias("level"), "at", "digests"))
        up = whole.where(F.col("depth") > level + 1)
        carried = up.select("g", "depth", F.lit(level + 1).alias("level"), F.floor(F.col("at") / FANOUT).alias("at"), F.pmod("at", F.lit(FANOUT)).cast("int").alias("first"), F.array(sha(F.concat_ws("", "digests"))).alias("digests"))
    runs = nodes.where("whole AND level >= 0").select("g", "level", "at", "digests")
    for m in merged:
        runs = runs.unionByName(m)
    leaves = nodes.where(F.col("level") == LEAF)
    first = runs.where("at = 0").unionByName(leaves.where("at = 0").select("g", "level", "at", "digests"))
    tops = first.groupBy("g").agg(F.max("level").alias("level"), F.max_by("digests", "level").alias("digests"))
    top = F.when(F.col("level") == LEAF, F.col("digests")[0]).otherwise(sha(F.concat_ws("", "digests")))
    tops = cut(tops.select("g", (F.col("level") + 1).alias("depth"), top.alias("top")))
    return Forest(leaves.select("g", "at", F.col("digests")[0].alias("digest"), "item"), runs, tops, tops.agg(F.max("depth")).first()[0] or 0)


def _step(digests: Column, place: Column) -> Column:
    """The siblings of the node at ``place``, in hex text."""
    before = F.concat_ws("", F.slice(digests, F.lit(1), place))
    after = F.concat_ws("", F.slice(digests, place + 2, F.lit(FANOUT)))
    return F.array(F.struct(before.alias("before"), after.alias("after")))


def _down(nodes: DataFrame, over: DataFrame, keep: list[str]) -> DataFrame:
    """``nodes`` (g, at, ...) with the path of the run that each is in, or of the group where it is the group's root."""
    place = F.pmod("at", F.lit(FANOUT)).cast("int")
    joined = nodes.withColumn("up", F.floor(F.col("at") / FANOUT)).join(over, ["g", "up"])
    path = F.when(F.col("over").isNull(), F.col("above")).otherwise(F.concat(_step(F.col("over"), place), F.col("above")))
    return joined.select(*keep, path.alias("path"), "rest")


def paths(trees: Forest, heads: DataFrame) -> DataFrame:
    """Leaves (g, digest, item) with the path (before, after) of each level.

    ``heads`` (g, path, rest): the path from each group's root on, and anything that goes down with it.
    """
    heads = trees.tops.join(heads, "g").select("g", "depth", F.lit(0).cast("long").alias("up"), F.lit(None).cast("array<string>").alias("over"), F.col("path").alias("above"), "rest")

    def over(level: int, runs: DataFrame | None) -> DataFrame:
        found = heads.where(F.col("depth") == level).drop("depth")
        return found if runs is None else found.unionByName(runs.select("g", F.col("at").alias("up"), F.col("digests").alias("over"), F.col("path").alias("above"), "rest"))

    runs = None
    for level in reversed(range(trees.depth)):
        runs = _down(trees.runs.where(F.col("level") == level), over(level + 1, runs), ["g", "at", "digests"])
    return _down(trees.leaves, over(0, runs), ["g", "digest", "item"])


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: ``key``, leaf, subroot (the group's), root, path, and what ``carry`` names.

    ``fold`` and ``proof`` read the path.
    """
    carry = carry or {}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("g"),
        leaf_of([F.col(f) for f in fields]).alias("digest"),
        F.struct(F.col(key).alias("key"), *[c.alias(f"c{i}") for i, c in enumerate(carry.values())]).alias("item"),
        F.monotonically_increasing_id().alias("place"),
    )
    trees = forest(rows, [F.col("item.key").asc_nulls_first(), F.col("digest"), F.col("place")])
    roots = trees.tops.select(F.lit("").alias("g"), F.col("top").alias("digest"), F.struct(F.col("g").alias("of")).alias("item"))
    whole = forest(roots, [F.col("item.of")])
    none = F.array().cast(_PATH)
    heads = paths(whole, whole.tops.select("g", none.alias("path"), F.struct(F.col("top").alias("root"), F.lit(None).cast("string").alias("subroot")).alias("rest")))
    heads = heads.select(F.col("item.of").alias("g"), "path", F.struct("rest.root", F.col("digest").alias("subroot")).alias("rest"))
    found = paths(trees, heads)
    more = [F.col(f"item.c{i}").alias(name) for i, name in enumerate(carry)]
    return found.select(F.col("item.key").alias(key), F.col("digest").alias("leaf"), "rest.subroot", "rest.root", "path", *more)
