"""Stateful session streams: numbering behind checks, replay followed by a tail, and change sets with two clocks.

State is a few numbers a session or subscriber, or what waits for the watermark; none of it grows with
the events that went through. The processors need the RocksDB state store, which run() sets for its queries.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampType

from .sessions import replay

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """The state store that transformWithState asks for, while a query starts."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into files beside its checkpoint, and gives their rows."""
    path = f"{checkpoint}-rows"
    with rocks(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


# numbering

NUMBERED = "session_id string, sequence_number long, event_id long, event_type string, micros long, reason string"
_NUMBERED = Row(*[c.split()[0] for c in NUMBERED.split(", ")])


class _Number(StatefulProcessor):
    """State of a session: its last number, and whether it has ended."""

    def __init__(self, end_type: str, keep_ms: int | None):
        self.end_type, self.keep_ms = end_type, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "number long, ended boolean", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = sorted(rows, key=lambda r: (r.micros is None, r.micros, r.event_id is None, r.event_id))
        if self.state.exists():
            number, ended = self.state.get()
        else:
            number, ended = max((r.stored_number for r in batch if r.stored_number is not None), default=0), any(r.stored_end for r in batch)
        for r in batch:
            reason, given = r.reason, None
            if reason is None and ended:
                reason = "session has ended"
            elif reason is None:
                given = number = number + 1
                ended = r.event_type == self.end_type
            yield _NUMBERED(key[0], given, r.event_id, r.event_type, r.micros, reason)
        self.state.update((number, ended))

    def close(self) -> None:
        pass


def append_events(events: DataFrame, known: DataFrame, targets: DataFrame | None = None, late: str = "1 hour", end_type: str = "session_ended", keep_ms: int | None = None) -> DataFrame:
    """(session_id, sequence_number, event_id, event_type, occurred_at, reason): gap-free numbers per session in order of arrival.

    events is a stream with session_id, event_id, event_type, occurred_at and perhaps target; what arrives in one batch is in
    order of (occurred_at, event_id). known has a row for each session, with last_sequence and ended where it was stored before;
    targets has all identities as target. An event whose session or target is unknown, or whose session has ended,
    comes back without a number and with the reason. A repeat of (session_id, event_id) within the time late is
    passed over. A session that keep_ms pass without events leaves the state, and starts again from known.
    """
    fresh = events.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["session_id", "event_id"])
    stored = [F.col(c) if c in known.columns else F.lit(None).cast(k).alias(c) for c, k in (("last_sequence", "long"), ("ended", "boolean"))]
    there = known.select(F.col("session_id"), stored[0].cast("long").alias("stored_number"), stored[1].alias("stored_end"), F.lit(True).alias("is_known"))
    rows = fresh.join(there, "session_id", "left")
    reason = F.when(F.col("is_known").isNull(), "unknown session")
    if targets is not None:
        rows = rows.join(targets.select("target", F.lit(True).alias("is_target")), "target", "left")
        reason = reason.when(F.col("target").isNotNull() & F.col("is_target").isNull(), "unknown target")
    rows = rows.select("session_id", "event_id", "event_type", F.unix_micros("occurred_at").alias("micros"), "stored_number", "stored_end", reason.alias("reason"))
    numbered = rows.groupBy("session_id").transformWithState(_Number(end_type, keep_ms), NUMBERED, "append", "None")
    return numbered.select("session_id", "sequence_number", "event_id", "event_type", F.timestamp_micros("micros").alias("occurred_at"), "reason")


# replay, then tail


class _Tail(StatefulProcessor):
    """State of a subscriber: the last number it was given."""

    def __init__(self, columns: list[str]):
        self.given = Row("subscriber", *columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "number long")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.mark.update((initialState.delivered,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = self.mark.get()[0] if self.mark.exists() else 0
        new: dict[int, Row] = {}
        for r in rows:
            if r.sequence_number is not None and r.sequence_number > mark:
                new.setdefault(r.sequence_number, r)
        if new:
            self.mark.update((max(new),))
        for number in sorted(new):
            yield self.given(*new[number])

    def close(self) -> None:
        pass


def replayed(subscribers: DataFrame, log: DataFrame, limit: int = 1000) -> DataFrame:
    """(subscriber, log's columns, has_more): for each subscriber the first limit events of its session behind after_sequence."""
    waiting = subscribers.select("subscriber", F.col("session_id").alias("of_session"), "after_sequence")
    rows = log.join(waiting, (F.col("session_id") == F.col("of_session")) & (F.col("sequence_number") > F.col("after_sequence")))
    each = rows.withColumns({"own_session": F.col("session_id"), "session_id": F.col("subscriber")}).drop("of_session", "after_sequence")
    return replay(each, 0, limit).withColumn("session_id", F.col("own_session")).select("subscriber", *log.columns, "has_more")


def high_water(subscribers: DataFrame, replay_rows: DataFrame) -> DataFrame:
    """(subscriber, session_id, delivered) of those who got all that waited; the others have to come back with their last number."""
    seen = replay_rows.groupBy("subscriber").agg(F.max("sequence_number").alias("last"), F.bool_or("has_more").alias("has_more"))
    rows = subscribers.join(seen, "subscriber", "left").where("NOT coalesce(has_more, false)")
    return rows.select("subscriber", "session_id", F.coalesce("last", "after_sequence").cast("long").alias("delivered"))


def tail(events: DataFrame, marks: DataFrame) -> DataFrame:
    """(subscriber, events' columns): a stream of numbered events for each subscriber, without what its replay has delivered.

    Numbers come to a subscriber once and rising. Start reading events before the log is read for the replay: what
    comes meanwhile is in both, and the mark drops it here.
    """
    columns = events.columns
    # moments go through the processor as numbers, which have no time zone
    moments = [f.name for f in events.schema if isinstance(f.dataType, TimestampType)]
    sent = events.join(marks.select(F.col("session_id"), F.col("subscriber").alias("by")), "session_id").select("by", *[F.unix_micros(c).alias(c) if c in moments else c for c in columns])
    out = "subscriber string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema[1:])
    start = marks.select(F.col("subscriber").alias("by"), "delivered").groupBy("by")
    rows = sent.groupBy("by").transformWithState(_Tail(columns), out, "append", "None", start)
    return rows.select("subscriber", *[F.timestamp_micros(c).alias(c) if c in moments else c for c in columns])


# change sets

SIGNALS = "workspace_id string, kind string, path string, at timestamp"
CHANGE_SETS = "workspace_id string, dispatched_ms long, paths array<string>, full_inventory boolean"
_CHANGE_SET = Row(*[c.split()[0] for c in CHANGE_SETS.split(", ")])


class Controller:
    """When pending changes are handed over: after settle ms without a change and idle ms without session activity.

    While a set is being worked on nothing is handed over; a failed one is pending again, from the time of its failure.
    """

    def __init__(self, settle: int, idle: int, memory: dict | None = None):
        self.settle, self.idle = settle, idle
        self.m = memory or {"pending": [], "full": False, "change": None, "activity": None, "free": None, "out": None, "waiting": []}

    def due(self) -> int | None:
        m = self.m
        if m["out"] is not None or not (m["pending"] or m["full"]):
            return None
        clocks = [(m["change"], self.settle), (m["activity"], self.idle), (m["free"], 0)]
        return max(at + window for at, window in clocks if at is not None)

    def hand_over(self, at: int) -> tuple[int, list[str], bool]:
        m = self.m
        m["out"] = [m["pending"], m["full"]]
        m["pending"], m["full"] = [], False
        return at, m["out"][0], m["out"][1]

    def signal(self, at: int, kind: str, path: str | None) -> None:
        m = self.m
        if kind == "changed":
            m["pending"], m["change"] = sorted({*m["pending"], path.replace("\\", "/")}), at
        elif kind == "activity":
            m["activity"] = at
        elif kind == "fault":
            m["full"], m["change"] = True, at
        elif kind in ("failed", "done") and m["out"] is not None:
            paths, full = m["out"]
            m["out"], m["free"] = None, at
            if kind == "failed":
                m["pending"], m["full"], m["change"] = sorted({*m["pending"], *paths}), m["full"] or full, at

    def until(self, now: int) -> Iterator[tuple[int, list[str], bool]]:
        """What is handed over up to now, taking the signals that wait in their order."""
        waiting = self.m["waiting"]
        while True:
            due = self.due()
            ahead = waiting[0][0] if waiting and waiting[0][0] <= now else None
            # at the same moment a signal comes before the timer that it might put off
            if ahead is not None and (due is None or ahead <= due):
                self.signal(*waiting.pop(0))
            elif due is not None and due <= now:
                yield self.hand_over(due)
            else:
                return


class _Debounce(StatefulProcessor):
    """State of a workspace: its controller, with the signals that the watermark has not reached."""

    def __init__(self, settle: int, idle: int):
        self.settle, self.idle = settle, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("controller", "memory string")

    def _step(self, key: tuple, signals: list, now: int) -> Iterator[Row]:
        c = Controller(self.settle, self.idle, json.loads(self.state.get()[0]) if self.state.exists() else None)
        c.m["waiting"] = sorted([*c.m["waiting"], *signals], key=lambda s: (s[0], s[1], s[2] or ""))
        sets = list(c.until(now))
        self.state.update((json.dumps(c.m),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [t for t in (c.due(), c.m["waiting"][0][0] if c.m["waiting"] else None) if t is not None]
        if times:
            self.handle.registerTimer(max(min(times), now + 1))
        for at, paths, full in sets:
            yield _CHANGE_SET(key[0], at, paths, full)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self._step(key, [[r.ms, r.kind, r.path] for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._step(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def change_sets(signals: DataFrame, settle_ms: int = 750, idle_ms: int = 30_000, late: str = "10 seconds") -> DataFrame:
    """(workspace_id, dispatched_at, paths, full_inventory) from a stream of signals (workspace_id, kind, path, at).

    Kinds: changed (with a path), activity of a session, fault of the watcher (asks for a full inventory), and done or failed
    of the last set. Signals are taken in order of time behind the watermark, so batches and the order of arrival within late don't
    matter, and a set is handed over by an event-time timer. At one moment signals are in order of kind and path.
    """
    if settle_ms <= 0 or idle_ms < 0:
        raise ValueError("the settle window has to be positive and the idle window not negative")
    rows = signals.withWatermark("at", late).select("workspace_id", "kind", "path", "at", F.unix_millis("at").alias("ms"))
    sets = rows.groupBy("workspace_id").transformWithState(_Debounce(settle_ms, idle_ms), CHANGE_SETS, "append", "EventTime")
    return sets.select("workspace_id", F.timestamp_millis("dispatched_ms").alias("dispatched_at"), "paths", "full_inventory")


# admission of model requests

REQUESTS = "governor_id string, run_id string, request_id string, kind string, at timestamp, tokens long, cost double, retry_after_ms long"
DECISIONS = "governor_id string, run_id string, request_id string, at timestamp, denial string, retry_after_ms long"


class Limits(NamedTuple):
    concurrent: int = 4
    requests: int = 100
    tokens: int = 100_000
    cost: float = 10.0
    cooldown_ms: int = 30_000


def admit(now: int, run: tuple, active: int, has_lease: bool, cooldown: int | None, tokens: int, cost: float, limits: Limits) -> tuple[str | None, int | None]:
    """(denial, wait): why a reservation is refused, None if it is not; run is what its run has reserved: requests, tokens, cost."""
    if cooldown is not None and cooldown > now:
        return "CooldownActive", cooldown - now
    if has_lease:
        return None, None
    if active >= limits.concurrent:
        return "ConcurrencyLimitReached", None
    if run[0] >= limits.requests:
        return "RequestQuotaExhausted", None
    if run[1] > limits.tokens - tokens:
        return "TokenQuotaExhausted", None
    if run[2] > limits.cost - cost:
        return "CostQuotaExhausted", None
    return None, None


class _Govern(StatefulProcessor):
    """State of a governor: the leases that are out, what each run has reserved, and the end of a cooldown.

    A batch reads the leases that are out and the runs that it names, folds its rows over them in order of time, and writes them back.
    """

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shared = handle.getValueState("shared", "active long, cooldown long")
        self.runs = handle.getMapState("runs", "run_id string", "requests long, tokens long, cost double")
        self.leases = handle.getMapState("leases", "run_id string, request_id string", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ms", "run_id", "request_id", "kind"], kind="stable")
        active, cooldown = self.shared.get() if self.shared.exists() else (0, -1)
        # no more leases are out than may be at a time, so all are read at once
        runs, before = {}, {tuple(lease) for lease in self.leases.keys()}
        leases = set(before)
        for run in batch["run_id"].dropna().unique():
            runs[run] = tuple(self.runs.getValue((run,))) if self.runs.containsKey((run,)) else (0, 0, 0.0)
        out = []
        for r in batch.itertuples():
            lease = (r.run_id, r.request_id)
            if r.kind == "rate_limited":
                wait = max(self.limits.cooldown_ms, 0 if pd.isna(r.retry_after_ms) else int(r.retry_after_ms))
                cooldown = max(cooldown, int(r.ms) + wait)
            elif r.kind == "complete" and lease in leases:
                leases.remove(lease)
                active -= 1
            elif r.kind == "reserve":
                denial, wait = admit(int(r.ms), runs[r.run_id], active, lease in leases, cooldown if cooldown >= 0 else None, int(r.tokens), float(r.cost), self.limits)
                if denial is None and lease not in leases:
                    leases.add(lease)
                    active, had = active + 1, runs[r.run_id]
                    runs[r.run_id] = (had[0] + 1, had[1] + int(r.tokens), had[2] + float(r.cost))
                out.append((key[0], *lease, r.at, denial, wait))
        for run, used in runs.items():
            if used[0]:
                self.runs.updateValue((run,), (int(used[0]), int(used[1]), float(used[2])))
        for lease in leases - before:
            self.leases.updateValue(lease, (0,))
        for lease in before - leases:
            self.leases.removeKey(lease)
        self.shared.update((int(active), int(cooldown)))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])
        yield frame.astype({"retry_after_ms": "Int64"})

    def close(self) -> None:
        pass


def governed(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(governor_id, run_id, request_id, at, denial, retry_after_ms) of every reservation in a stream of requests, in order of time.

    Kinds: reserve (with an estimate of tokens, 1 to 10 million, and cost), complete, which ends the lease of a request, and
    rate_limited, which starts a cooldown of at least cooldown_ms for the whole governor. An admission counts against the
    concurrency limit until its lease ends and against its run's requests, tokens and cost for ever; a refusal counts nothing. A request
    that holds a lease is admitted again without counting. Reservations with an estimate out of bounds are denied as InvalidEstimate.
    """
    valid = F.col("tokens").between(1, 10_000_000) & ~F.isnan("cost") & (F.col("cost") >= 0) & (F.col("cost") < float("inf"))
    kind = F.when((F.col("kind") == "reserve") & ~F.coalesce(valid, F.lit(False)), "invalid").otherwise(F.col("kind"))
    rows = requests.select("governor_id", "run_id", "request_id", kind.alias("kind"), "at", F.unix_millis("at").alias("ms"), "tokens", "cost", "retry_after_ms")
    decided = rows.where("kind != 'invalid'").groupBy("governor_id").transformWithStateInPandas(_Govern(limits), DECISIONS, "append", "None")
    refused = rows.where("kind = 'invalid'").select("governor_id", "run_id", "request_id", "at", F.lit("InvalidEstimate").alias("denial"), F.lit(None).cast("long").alias("retry_after_ms"))
    return decided.unionByName(refused)
