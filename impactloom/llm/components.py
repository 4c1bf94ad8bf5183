"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A round's edges are written in files of at least so many, but not in fewer than ``FILES``.
EDGES_A_FILE, FILES = 200_000, 16


#: Tables of the nodes of at most so many edges are broadcast, about 100 bytes each.
BROADCAST_EDGES = 100_000


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(F.broadcast(least) if small else least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges have a < b: b's smaller neighbours, and b, go to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(F.broadcast(least) if small else least, "b").select("m", F.explode(F.array("a", "b")).alias("v"))
    return moved.where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node with an edge; component is its least reachable node.

    ``edges`` has columns a and b of one orderable type; repeats, loops and either direction are
    fine.  Each round writes its edges to the shared folder, so neither plan nor lineage grows.  A
    path of n nodes takes about log2 n rounds; more than ``rounds`` are an error, never a partial result.
    """
    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sign = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31)).alias("s")]
    before = now.agg(*sign).first()
    for _ in range(rounds):
        if not before["n"]:
            break
        small = before["n"] <= BROADCAST_EDGES
        now = cut(_small_star(_large_star(now, small), small).coalesce(max(FILES, before["n"] // EDGES_A_FILE)))
        after = now.agg(*sign).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.select("a", F.explode(F.array("a", "b")).alias("node"))
    return nodes.select("node", F.col("a").alias("component")).distinct()
