"""Samples, shares and scorecards per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import count_if, first_match, ratio


def first_samples(df: DataFrame, by: list[str], item: str, k: int, *more: Column) -> DataFrame:
    """Aggregates per group, and its ``k`` least distinct items in order; no group is collected whole."""
    least = df.select(*by, item).distinct().withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(item))).where(F.col("__r") <= k)
    samples = least.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("samples"))
    sums = df.groupBy(*by).agg(*more)
    same = [sums[c].eqNullSafe(samples[c]) for c in by]
    return sums.join(samples, same).select(*[sums[c] for c in by], *[c for c in sums.columns if c not in by], "samples")


def share(hits: str, of: str, empty: float) -> Column:
    """|hits and of| / |of| of two array columns; ``empty`` for an empty list."""
    return ratio(F.size(F.array_intersect(hits, of)), F.size(of), empty)


def scorecard(rows: DataFrame, by: str) -> DataFrame:
    """Rates as ratios of sums over all cases, and whether they are enough for a decision."""
    n = F.countDistinct("case_id")
    return rows.groupBy(by).agg(
        n.alias("cases"),
        ratio(F.sum("wrong"), F.sum("reviewed")).alias("burden"),
        ratio(count_if(F.col("correct")), F.count(F.lit(1))).alias("correct_rate"),
        first_match([(n < 3, "INSUFFICIENT_CASES"), (F.sum("reviewed") > 0, "READY_FOR_PRODUCT_DECISION")], "INSUFFICIENT_OBSERVATIONS").alias("status"),
    )
