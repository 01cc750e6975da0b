"""Streams over the events, in several batches, through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.storage import checkpoint_folder
from ..streaming import sessions, stateful

BATCHES = 4


def _staged(rows: DataFrame, name: str, order: str, files: int = BATCHES) -> tuple[DataFrame, str]:
    """Rows as a file stream that brings one range of their order a batch, and a place for its checkpoint."""
    spark = rows.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    rows.repartitionByRange(files, order).withColumn("batch", F.spark_partition_id()).write.partitionBy("batch").parquet(f"{path}/all")
    ranges = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch int").parquet(f"{path}/all")
    for k in range(files):  # the time at which a file is written decides its batch
        ranges.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(f"{path}/events")
    return sessions.read_events(spark, f"{path}/events", rows.schema, 1), f"{path}/state"


#: some events end their session or name a nation that isn't there; a user that is no customer has no session
APPENDED = """SELECT concat('s', user_id) AS session_id, event_id, CASE WHEN value > 150 THEN 'session_ended' ELSE event_type END AS event_type,
 concat('n:', event_id % 30) AS target, CAST(ts AS TIMESTAMP) AS occurred_at FROM {events}"""
KNOWN = "SELECT concat('s', c_custkey) AS session_id FROM {customer}"
TARGETS = "SELECT concat('n:', n_nationkey) AS target FROM {nation}"


@query("", """, t AS (SELECT ev.*, CASE WHEN k.session_id IS NULL THEN 'unknown session' WHEN g.target IS NULL THEN 'unknown target' END AS bad
 FROM ev LEFT JOIN known k ON ev.session_id = k.session_id LEFT JOIN targets g ON ev.target = g.target),
 e AS (SELECT *, coalesce(bool_or(bad IS NULL AND event_type = 'session_ended') OVER (PARTITION BY session_id
 ORDER BY occurred_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM t),
 n AS (SELECT *, count(*) FILTER (bad IS NULL AND NOT over) OVER (PARTITION BY session_id ORDER BY occurred_at, event_id) AS k FROM e)
 SELECT session_id, CASE WHEN bad IS NULL AND NOT over THEN k END AS sequence_number, event_id, event_type, CASE WHEN bad IS NOT NULL THEN bad
 WHEN over THEN 'session has ended' END AS reason FROM n""", ev=APPENDED, known=KNOWN, targets=TARGETS)
def session_append(ev: DataFrame, known: DataFrame, targets: DataFrame) -> DataFrame:
    """All events in four batches: numbers where session and target are known and the session is open, else reasons."""
    stream, state = _staged(ev, "append", "occurred_at")
    return stateful.run(stateful.append_events(stream, known, targets), state).drop("occurred_at")


EVENT_ROWS = "SELECT concat('s', user_id) AS session_id, event_id, event_type, CAST(ts AS TIMESTAMP) AS occurred_at, value FROM {events}"


@query("", " SELECT session_id, event_id, event_type, value FROM ev", ev=EVENT_ROWS)
def event_deduplicated(ev: DataFrame) -> DataFrame:
    """Every event sent twice, kept once."""
    stream, state = _staged(ev.union(ev), "stream", "occurred_at")
    return sessions.run_once(sessions.deduplicated(stream, "60 days"), "events", state).select("session_id", "event_id", "event_type", "value")


#: what was there when the subscribers came, and what their stream brings: two days are in both
NUMBERED = "SELECT concat('s', user_id) AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence_number, event_id, CAST(day(ts) AS BIGINT) AS day FROM {events}"
SUBSCRIBERS = """SELECT DISTINCT concat('web-', user_id) AS subscriber, concat('s', user_id) AS session_id, CAST(0 AS BIGINT) AS after_sequence FROM {events}
 UNION ALL SELECT DISTINCT concat('cli-', user_id), concat('s', user_id), CAST(12 AS BIGINT) FROM {events}"""
PAGE, LOGGED, SENT = 40, 20, 18


@query("", f""", w AS (SELECT s.subscriber, e.session_id, e.sequence_number, e.event_id, e.day, row_number() OVER (PARTITION BY s.subscriber ORDER BY e.sequence_number) AS k,
 count(*) FILTER (e.day <= {LOGGED}) OVER (PARTITION BY s.subscriber) AS waiting FROM subs s
 JOIN ev e ON e.session_id = s.session_id AND e.sequence_number > s.after_sequence)
 SELECT subscriber, session_id, sequence_number, event_id, day, CASE WHEN day <= {LOGGED} THEN 'replay'
 ELSE 'tail' END AS phase, day <= {LOGGED} AND waiting > {PAGE} AS has_more FROM w WHERE waiting <= {PAGE} OR k <= {PAGE}""", ev=NUMBERED, subs=SUBSCRIBERS)
def event_stream(ev: DataFrame, subs: DataFrame) -> DataFrame:
    """Replay of what was logged, then the tail; a subscriber with more than a page waiting gets the page alone."""
    stream, state = _staged(ev.where(F.col("day") >= SENT), "tail", "day")
    log = ev.where(F.col("day") <= LOGGED)
    first = stateful.replayed(subs, log, PAGE)
    later = stateful.run(stateful.tail(stream, stateful.high_water(subs, first)), state)
    return first.withColumn("phase", F.lit("replay")).unionByName(later.withColumns({"phase": F.lit("tail"), "has_more": F.lit(False)}))


#: clicks and views change files, purchases are session activity, errors say that work has failed, searches that it is done
SIGNALS = """SELECT concat('w', user_id) AS workspace_id, CASE WHEN value > 190 THEN 'fault' WHEN event_type IN ('click', 'view') THEN 'changed'
 WHEN event_type = 'purchase' THEN 'activity'
 WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS kind, concat('src/', event_type, '/', event_id % 50, '.cs') AS path, CAST(ts AS TIMESTAMP) AS at FROM {events}"""


@query("", None, signals=SIGNALS)
def change_sets(signals: DataFrame) -> DataFrame:
    """When each user's pending files are handed over; a last signal of another workspace moves the watermark to the end."""
    end = signals.agg((F.max("at") + F.expr("INTERVAL 30 DAYS")).alias("at")).select(F.lit("clock").alias("workspace_id"), F.lit("activity").alias("kind"), F.lit(None).cast("string").alias("path"), "at")
    stream, state = _staged(signals.unionByName(end), "signals", "at")
    found = stateful.run(stateful.change_sets(stream, 7_200_000, 21_600_000, "1 hour"), state)
    return found.select("workspace_id", "dispatched_at", F.array_join("paths", ",").alias("paths"), "full_inventory")


#: a governor serves ten users' runs; a purchase completes the event before it, an error is a rate limit
REQUESTS = """SELECT concat('g', user_id % 15) AS governor_id, concat('r', user_id) AS run_id, CAST(CASE WHEN event_type = 'purchase' THEN lag(event_id) OVER (PARTITION BY user_id
 ORDER BY ts, event_id) ELSE event_id END AS VARCHAR(20)) AS request_id,
 CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'rate_limited'
 ELSE 'reserve' END AS kind, CAST(ts AS TIMESTAMP) AS at, CAST(100 * value AS BIGINT) AS tokens, value / 100 AS cost, CAST(60000 * value AS BIGINT) AS retry_after_ms
 FROM {events}"""


@query("", None, requests=REQUESTS)
def model_governor(requests: DataFrame) -> DataFrame:
    """What happens to every reservation: admitted, or refused by cooldown, concurrency, or its run's quotas."""
    stream, state = _staged(requests, "requests", "at")
    return stateful.run(stateful.governed(stream, stateful.Limits(40, 25, 100_000, 9.0, 600_000)), state).drop("at")
