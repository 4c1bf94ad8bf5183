"""Queries over the event log; two of them run as streams over the files that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..session import shared_path
from ..streaming import events as e
from .joins import over
from .views import oracle, view


def streamed(spark, sf, build, name: str):
    """What a streaming query makes of the events: it runs until all files are read, and its table is read back."""
    path = f"{sf}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, for the table may be one file
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    build(rows).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


@query("st_event", oracle("SELECT DISTINCT idempotency_key FROM v_event"))
def st_event(spark, sf):
    """Each key is written once, however often it comes within the watermark."""
    key = F.concat_ws(":", "user_id", "event_type", F.day("ts")).alias("idempotency_key")
    return streamed(spark, sf, lambda s: e.append_once(s.select(F.col("ts").cast("timestamp").alias("ts"), key), "idempotency_key", "ts", "60 days").select("idempotency_key"), "events")


@query("st_event_prefix", oracle("SELECT event_id, idempotency_key FROM v_event WHERE idempotency_key LIKE '7:%'"))
def st_event_prefix(spark, sf):
    return view(spark, sf, "v_event").where(F.col("idempotency_key").startswith("7:")).orderBy("ts", "event_id").select("event_id", "idempotency_key")


# The catalogue of event types.
KNOWN_TYPES = ["click", "purchase", "signup", "view"]
_TOLD = "SELECT event_id, event_type, CASE WHEN user_id % 10 = 0 THEN ' ' ELSE concat('u', user_id) END AS actor, props, CASE WHEN user_id % 7 = 0 THEN 'a:b' ELSE concat('d:', user_id, ':x') END AS k FROM events"


@query("st_validate", oracle("SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'UNKNOWN_EVENT_TYPE' END, CASE WHEN trim(actor) = '' THEN 'INVALID_ACTOR' END, CASE WHEN k = 'a:b' THEN 'INVALID_IDEMPOTENCY_KEY' END) AS errors FROM t", ("t", _TOLD)))
def st_validate(spark, sf):
    t = over(spark, sf, _TOLD, "events")
    return t.select("event_id", F.array_join(e.policy_errors(F.col("event_type"), F.col("actor"), F.col("props"), F.col("k"), KNOWN_TYPES), ",").alias("errors"))


_OPENED = """SELECT user_id, min(epoch_us(ts)) AS s FROM events GROUP BY user_id UNION ALL
SELECT w.user_id, (SELECT min(epoch_us(ts)) FROM events x WHERE x.user_id = w.user_id AND epoch_us(ts) >= w.s + 86400000000) FROM w WHERE (SELECT min(epoch_us(ts)) FROM events x WHERE x.user_id = w.user_id AND epoch_us(ts) >= w.s + 86400000000) IS NOT NULL"""


@query("st_ratelimit", oracle("SELECT user_id AS key, event_id AS id, row_number() OVER (PARTITION BY user_id, s ORDER BY t, event_id) <= 2 AS allowed FROM (SELECT v.user_id, v.event_id, epoch_us(v.ts) AS t, max(w.s) AS s FROM events v JOIN w ON w.user_id = v.user_id AND w.s <= epoch_us(v.ts) GROUP BY v.user_id, v.event_id, v.ts) y", ("w", _OPENED)))
def st_ratelimit(spark, sf):
    """Two events a day for each user; the day begins with the user's first event."""
    ev = view(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.rate_limited(ev, "user_id", "us", "event_id", 2, 86_400_000_000)


_JOBS = "SELECT event_id, CASE WHEN event_type = 'click' THEN 'RUNNING' ELSE 'QUEUED' END AS status, ts AS updated_at FROM events"


@query("st_lease", oracle("SELECT event_id, CASE WHEN status = 'RUNNING' AND updated_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 15 MINUTE THEN 'FAILED' ELSE status END AS status FROM j", ("j", _JOBS)))
def st_lease(spark, sf):
    return e.expired(over(spark, sf, _JOBS, "events"), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id", "status")


@query("st_state", oracle("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM events GROUP BY user_id"))
def st_state(spark, sf):
    return e.folded(view(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])
