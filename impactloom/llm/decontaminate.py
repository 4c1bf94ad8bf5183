"""Benchmark decontamination by size-partitioned MinHash containment search, native to Spark SQL.

A short item inside a long document has next to no Jaccard similarity with the whole of it, so the
sets that are hashed are windows: the MinHash value of ``w`` consecutive word shingles.  Items are
partitioned by size, and a partition's ``w`` is the greatest power of two that fits in the longest run
of shared shingles that an item of that size must keep.  Of n shingles at most l = n (100 - percent) / 100
may be missing; an edit between shared words breaks k - 1 shingles or more, so there are at most
l / (k - 1) of them, and of the runs between, one has (n - l) / (l / (k - 1) + 1) shingles or more: for five
words and 80 % one shingle at n = 1, 7 at 8, 13 at 100.  That run holds a whole window, whose MinHash
value is the same on both sides, so nothing is left to chance; only a document that has overlapping
pieces of an item at separate places can lose more runs, and then windows with equal minima remain.
Values of wider windows are minima of two values of the next narrower ones, so each partition
costs one more pass over an array, and neighbouring windows mostly share a value: of w shingles
about two values are left to look up.

Where many items share a window, as with one prompt template, their rarest shingles lead to them instead (``_told_apart``): texts
that quote the template are no candidates for all of them.  Candidates are verified by exact containment: shared shingles /
shingles of the item, counted for candidate pairs alone.

An item's row with a null or empty text has no shingles and is never found; items or texts shorter
than k words are one shingle.  Items with the same identifier count as one by the union of their
shingles; documents likewise, but ``clean_rows`` tells rows apart by identifier and text.  Empty tables give an
empty result; extra columns are ignored.  Long texts are read whole.  There are no ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_small, without_rows
from .text import let, shingles

#: Items that may share a window before it counts as a template's.
SHARED = 16


def _wider(values: Column, step: int) -> Column:
    """MinHash values of windows of 2 * step from those of step; arrays shorter than that stay as they are."""

    def of(v: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(v) - step - 1, F.lit(0)))
        return F.when(F.size(v) > step, F.transform(at, lambda i: F.least(F.get(v, i), F.get(v, i + step)))).otherwise(v)

    return let(values, of)


def _level(size: Column, k: int, percent: int) -> Column:
    """log2 of the window width for items of that size."""
    lost = F.floor(size * (100 - percent) / 100)
    run = (size - lost) / (F.floor(lost / max(k - 1, 1)) + 1)
    return F.floor(F.log2(F.greatest(run, F.lit(1.0))) + F.lit(1e-9)).cast("int")


def _labelled(values: Column, level: int) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(level).alias("level"), v.alias("value")))


def _windows(df: DataFrame, levels: list[int]) -> DataFrame:
    """One row per level and MinHash value of the windows over ``hashes``; a null row where there are none."""
    values, found = F.col("hashes"), []
    for p in range(max(levels, default=-1) + 1):
        if p:
            values = F.col(f"__v{p - 1}")
            df = df.withColumn(f"__v{p}", _wider(values, 1 << (p - 1)))
        else:
            df = df.withColumn("__v0", values)
        if p in levels:
            found.append(_labelled(F.array_distinct(F.col(f"__v{p}")), p))
    keys = F.concat(*found) if found else F.array().cast("array<struct<level:int,value:bigint>>")
    kept = [c for c in df.columns if c != "hashes" and not c.startswith("__v")]
    # explode_outer: explode would have the array computed a second time, to filter empty ones early.
    return df.select(*kept, F.explode_outer(keys).alias("__x")).select(*kept, F.col("__x.level").alias("level"), F.col("__x.value").alias("value"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    k: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Pairs (``key``, ``item_key``, shared, item_shingles) with 100 * shared >= percent * item_shingles."""
    own = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text"))
    sized = cut(own.select("item", shingles(F.col("text"), k).alias("hashes")).withColumn("of", _level(F.size(F.array_distinct("hashes")), k, percent))).where(F.size("hashes") > 0)
    levels = sorted(r[0] for r in sized.select("of").distinct().collect())  # one for each power of two
    keys = cut(_windows(sized, levels).where("level = of").select("level", "value", "item").distinct())
    of_item = cut(sized.select("item", F.explode("hashes").alias("h")).distinct())
    sizes = cut(of_item.groupBy("item").agg(F.count(F.lit(1)).alias("item_shingles")))
    wanted = cut(_told_apart(keys, of_item, sizes, percent))
    levels = sorted(r[0] for r in wanted.select("level").distinct().collect())
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    looked_up = _windows(texts.select("doc", shingles(F.col("text"), k).alias("hashes")), levels)
    candidates = cut(join_small(looked_up, wanted, ["level", "value"]).select("doc", "item").distinct())
    # Shingles meet only in pairs that are candidates, so what many items share does not multiply.
    sets = join_small(texts, candidates.select("doc").distinct(), ["doc"])
    each = sets.select("doc", F.explode_outer(shingles(F.col("text"), k)).alias("h")).distinct()
    asked = cut(join_small(candidates, of_item.withColumnRenamed("h", "of_h"), ["item"]).select("doc", "item", F.col("of_h").alias("h")))
    found = join_small(each, asked, ["doc", "h"]).groupBy("doc", "item").agg(F.count(F.lit(1)).alias("shared"))
    return (
        found.join(sizes.withColumnRenamed("item", "__item"), F.col("item").eqNullSafe(F.col("__item")))
        .where(F.col("shared") * 100 >= F.col("item_shingles") * percent)
        .select(F.col("doc").alias(key), F.col("item").alias(item_key), "shared", "item_shingles")
    )


def _told_apart(keys: DataFrame, of_item: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``keys`` (level, value, item) without the windows that many items share, as those of one prompt template do.

    Such a window would lead every text that quotes the template to all of the items.  Items that have one are looked up by single
    shingles as well: of an item of n shingles a text may lack n - c, where c are enough, so it has one of any n - c + 1; the
    item's rarest among all items are taken.  Nothing is lost, and a template alone leads to an item only where it is most of it.
    """
    crowd = keys.groupBy("level", "value").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") > SHARED)
    crowded = cut(join_small(keys, crowd.select("level", "value"), ["level", "value"], "left_semi"))
    if crowded.isEmpty():
        return keys
    kept = join_small(keys, crowded.select("level", "value").distinct(), ["level", "value"], "left_anti")
    whose = cut(crowded.select("item").distinct())
    commonness = of_item.groupBy("h").agg(F.count(F.lit(1)).alias("items"))
    rows = join_small(of_item, whose, ["item"], "left_semi").join(commonness, "h")
    place = F.row_number().over(Window.partitionBy("item").orderBy("items", "h"))  # an item's shingles
    enough = F.ceil(F.col("item_shingles") * percent / 100)
    ranked = join_small(rows.withColumn("place", place), sizes, ["item"])
    rare = ranked.where(F.col("place") <= F.col("item_shingles") - enough + 1).select(F.lit(0).alias("level"), F.col("h").alias("value"), "item")
    return kept.unionByName(rare).distinct()


def clean_rows(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item.

    Rows are known by identifier and text, so neither null nor repeated identifiers take other rows along.
    """
    rows = docs.select(F.struct(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("text_hash")).alias("row"), F.col(text).alias("text"))
    found = contaminated(rows, items, key="row", k=k, percent=percent)
    return without_rows(docs, cut(found.select("row.id", "row.text_hash").distinct()), text, key)
