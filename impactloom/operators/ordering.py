"""Latest rows, occurrences, budgets, cut-offs, caps, pages."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import cut


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The greatest row by ``order`` of each group; an aggregation, so groups need no sort and combine early."""
    rest = [c for c in df.columns if c not in by]
    top = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__top"))
    return top.select(*by, "__top.*")


def occurrences(df: DataFrame, seed: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*seed).orderBy(*order)))


def places(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place in the whole order: sorted in ranges, numbered in each, and moved by the ranges' sizes."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    # The upper bits of such a number are the range, the lower 33 the row's place in it.
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = ranged.withColumn("__part", part).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")  # a row for each range
    return moved.withColumn(name, F.col("__before") + row + 1).select(*df.columns, name)


def unique_only(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs once; keys are counted with early combination, not by windows."""
    once = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(*key)
    return df.join(once, key, "left_semi")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def adaptive_cutoff(df: DataFrame, by: list[str], score: str, ties: list[str], n: int, gap: float, cap: int = 100) -> DataFrame:
    """The ``n`` best rows of a group, and further ones up to ``cap`` that come within ``gap`` of the last of them."""
    w = Window.partitionBy(*by)
    top = top_per_group(df, by, [F.col(score).desc(), *[F.col(t) for t in ties]], cap)
    ranked = top.withColumn("__r", F.row_number().over(w.orderBy(F.col(score).desc(), *ties)))
    ranked = ranked.withColumn("__last", F.max(F.when(F.col("__r") == n, F.col(score))).over(w))
    kept = (F.col("__r") <= n) | ((F.col(score) >= F.col("__last") * (1 - gap)) if gap > 0 else F.lit(False))
    return ranked.where(kept).drop("__r", "__last")


def within_budget(df: DataFrame, by: list[str], order: list[Column], text: str, budget: int = 30_000, items: int = 12, least: int = 500, mark: str = "\n... [TRUNCATED]") -> DataFrame:
    """Texts in order until ``budget`` characters or ``items`` are used.

    A text over the budget is cut to what is left, with ``mark`` behind it, if more than ``least`` is left; else it
    and all after it stay out.  After a cut the budget is used up, so one running sum decides.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = top_per_group(df, by, order, items).withColumn("__left", F.lit(budget) - before)
    fits = F.length(text) <= F.col("__left")
    rows = rows.where(fits | (F.col("__left") > least))
    cut = F.concat(F.expr(f"substring({text}, 1, CAST(greatest(__left, 0) AS INT))"), F.lit(mark))
    return rows.withColumn("truncated", ~fits).withColumn(text, F.when(fits, F.col(text)).otherwise(cut)).drop("__left")


def running_counts(df: DataFrame, by: list[str], order: list[str], counters: dict[str, Column]) -> DataFrame:
    """Rows with the running sum of each counter over their group, in order; null counts as 0.

    One pass for all counters: rows are sorted in ranges, so a large group lies in many of them; sums run inside a range, and
    what a group has in earlier ranges is added.  Only one group of a range can have begun before it.  Rows that tie in
    ``order`` share a range's sorting, so ``order`` should tell rows apart.
    """
    rows = df.select(*df.columns, *[F.coalesce(c, F.lit(0)).alias(f"__{n}") for n, c in counters.items()])
    ranged = cut(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ranged.groupBy("__part", *by).agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in counters])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = next(iter(counters))
    before = parts.select(F.col("__part").alias("__of"), *[F.col(c).alias(f"__by_{c}") for c in by], *[F.sum(f"__{n}").over(earlier).alias(f"__before_{n}") for n in counters]).where(F.col(f"__before_{first}").isNotNull())
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], F.col("__part") == F.col("__of"))
    joined = ranged.join(F.broadcast(before), same, "left")  # a row for each range at most
    return joined.select(*df.columns, *[(F.sum(f"__{n}").over(w) + F.coalesce(f"__before_{n}", F.lit(0))).alias(n) for n in counters])


def within_limits(df: DataFrame, by: list[str], order: list[str], size: str, files: int, total: int) -> DataFrame:
    """Rows in order with ``kept``: false from the first on that passes the number of files or the total size."""
    counted = running_counts(df, by, order, {"__files": F.lit(1), "__bytes": F.col(size)})
    return counted.select(*df.columns, ((F.col("__files") <= files) & (F.col("__bytes") <= total)).alias("kept"))


def interleaved(df: DataFrame, by: list[str], lists: list[str], column: str, order: list[str], n: int) -> DataFrame:
    """Rows of the listed kinds taken in turn from each kind's order, ``n`` in all per group."""
    turn = F.row_number().over(Window.partitionBy(*by, column).orderBy(*order))
    place = F.array_position(F.array(*[F.lit(x) for x in lists]), F.col(column))
    # No list can give more than n, which bounds the second window.
    rows = df.withColumn("__turn", turn).where((F.col("__turn") <= n) & (place > 0)).withColumn("__list", place)
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy("__turn", "__list"))).where(F.col("pick") <= n).drop("__turn", "__list")


def margin(df: DataFrame, by: list[str], score: str, ties: list[str]) -> DataFrame:
    """The best row of a group, and how far it is ahead of the second (of 0 if there is none)."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), *ties)
    two = df.withColumn("__r", F.row_number().over(w)).withColumn("margin", F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0)))
    return two.where("__r = 1").drop("__r")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """A page of rows with ``has_more``; offsets over ``most`` are held there."""
    at = min(max(offset, 0), most)
    rows = df.orderBy(*order).offset(at).limit(limit + 1)  # bounded by limit + 1
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    numbered = rows.withColumn("__r", F.row_number().over(w)).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > limit)
    return numbered.where(F.col("__r") <= limit).drop("__r")


def merged(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
