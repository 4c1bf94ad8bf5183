"""The event log: policy, idempotent append, rate limits, leases, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import all_matches
from ..operators.ordering import places
from ..operators.rounds import cut


def policy_errors(event_type: Column, actor: Column, metadata: Column, key: Column, known: list[str]) -> Column:
    """What is wrong with an event; the expression holds for streams as well."""
    return all_matches(
        [
            (~F.coalesce(event_type.isin(known), F.lit(False)), "UNKNOWN_EVENT_TYPE"),
            (F.coalesce(F.trim(actor) == "", F.lit(True)) | (F.length(actor) > 100), "INVALID_ACTOR"),
            (F.octet_length(metadata) > 10_000, "EVENT_METADATA_TOO_LARGE"),
            (F.size(F.split(key, ":")) < 3, "INVALID_IDEMPOTENCY_KEY"),
        ]
    )


def append_once(events: DataFrame, key: str, time: str, watermark: str) -> DataFrame:
    """A stream of events without those whose key came before, as far back as the watermark."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def rate_limited(events: DataFrame, key: str, time_us: str, order: str, most: int, window_us: int) -> DataFrame:
    """Events (key, id, allowed): a key's first event opens a window, in which ``most`` events are allowed; the next one opens the next.

    Events get their places in the order of key, time and ``order``.  Each points to the first event of its key that no window
    which it opened could hold, found by a sorted search; the windows are the ways along these pointers from each key's first
    event, followed by doubling the pointers.  All steps are dealt by place or in ranges, so a key with many events is spread
    over tasks like any other; rounds go with the logarithm of a key's windows.  A null time is before all others and
    opens no window; null keys are a key.
    """
    rows = events.select(F.col(key).alias("key"), F.col(time_us).cast("long").alias("t"), F.col(order).alias("id"), F.monotonically_increasing_id().alias("row"))
    sort = [F.col("key").asc_nulls_first(), F.col("t").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("row")]
    placed = cut(places(rows, sort, "place").select("key", "t", "id", "place"))
    nexts = _next_windows(placed, window_us)
    opened = cut(placed.groupBy("key").agg(F.min("place").alias("place")).select("place"))
    while not nexts.isEmpty():
        opened = cut(opened.unionByName(opened.join(nexts, "place").select(F.col("to").alias("place"))))
        nexts = cut(nexts.join(nexts.select(F.col("place").alias("to"), F.col("to").alias("far")), "to").select("place", F.col("far").alias("to")))
    return _counted(placed, opened, most)


def _next_windows(placed: DataFrame, window_us: int) -> DataFrame:
    """(place, to): for each event the first of its key at least ``window_us`` later, if there is one."""
    both = placed.select("key", "t", F.lit(1).alias("kind"), "place").unionByName(placed.where("t IS NOT NULL").select("key", (F.col("t") + window_us).alias("t"), F.lit(0).alias("kind"), "place"))
    sort = [F.col("key").asc_nulls_first(), F.col("t").asc_nulls_first(), F.col("kind"), F.col("place")]
    ranged = cut(both.repartitionByRange(*sort).withColumn("part", F.spark_partition_id()))
    event = F.when(F.col("kind") == 1, F.col("place"))
    # From the last row of a range back: the nearest event behind.  Places grow with the order, so it is the least.
    back = Window.partitionBy("part", "key").orderBy(F.col("t").desc_nulls_last(), F.col("kind").desc(), F.col("place").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = ranged.withColumn("to", F.min(event).over(back)).where("kind = 0")
    keys = ranged.groupBy("key", "part").agg(F.min(event).alias("first"))
    later = Window.partitionBy("key").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # Keys that lie in several ranges: a row for each range at most.
    ahead = keys.withColumn("ahead", F.min("first").over(later)).where("ahead IS NOT NULL").select(F.col("key").alias("k"), F.col("part").alias("p"), "ahead")
    joined = here.join(F.broadcast(ahead), F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")), "left")
    return cut(joined.select("place", F.coalesce("to", "ahead").alias("to")).where("to IS NOT NULL"))


def _counted(placed: DataFrame, opened: DataFrame, most: int) -> DataFrame:
    """Events with ``allowed``: how far each stands behind the last window's first event, in ranges of places."""
    marked = placed.join(opened.withColumn("opens", F.lit(True)), "place", "left")
    ranged = cut(marked.repartitionByRange("place").withColumn("part", F.spark_partition_id()))
    begin = F.when(F.col("opens"), F.col("place"))
    so_far = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ranged.groupBy("part").agg(F.max(begin).alias("last"))
    # A row for each range.
    before = parts.select(F.col("part").alias("p"), F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    since = ranged.withColumn("since", F.max(begin).over(so_far)).join(F.broadcast(before), F.col("part") == F.col("p"))
    return since.select("key", "id", (F.col("place") - F.coalesce("since", "before") < most).alias("allowed"))


def expired(jobs: DataFrame, now: Column, lease: str = "INTERVAL 15 MINUTES") -> DataFrame:
    """Jobs with running ones failed that were not heard of within the lease."""
    late = (F.col("status") == "RUNNING") & (F.col("updated_at") < now - F.expr(lease))
    return jobs.withColumn("status", F.when(late, "FAILED").otherwise(F.col("status")))


def folded(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """The state of each key after its last event, and how many there were."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count(F.lit(1)).alias("n_events"))
