"""Streams over several batches: numbering, replay and tail, change sets."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from stratigraph.streaming import sessions, stateful

EVENTS = "session_id string, event_id long, event_type string, target string, occurred_at timestamp"
T0 = datetime.datetime(2024, 1, 1)


def staged(spark, folder, rows, schema, batches):
    """rows as files, in order, one for each batch of a stream."""
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def events(n, seed=1):
    g = random.Random(seed)
    out = []
    for i in range(n):
        s = g.randrange(6)
        kind = "session_ended" if g.random() < 0.02 else "note"
        out.append((f"s{s}", i, kind, g.choice([None, "t1", "t2", "lost"]), T0 + datetime.timedelta(seconds=i)))
    return [*out, *[(*r[:4], r[4]) for r in g.sample(out, 10)]]


def plain_numbers(rows, known, targets):
    out, last, ended, seen = [], dict(known), set(), set()
    for s, i, kind, target, at in sorted(rows, key=lambda r: (r[4], r[1])):
        if (s, i) in seen:
            continue
        seen.add((s, i))
        reason = "unknown session" if s not in known else "unknown target" if target is not None and target not in targets else "session has ended" if s in ended else None
        if reason is None:
            last[s] += 1
            if kind == "session_ended":
                ended.add(s)
        out.append((s, last[s] if reason is None else None, i, reason))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 5])
def test_numbers_do_not_depend_on_batches(spark, tmp_path, batches):
    rows = sorted(events(200), key=lambda r: (r[4], r[1]))
    known = spark.createDataFrame([(f"s{i}", 10 * i if i else None, False) for i in range(5)], "session_id string, last_sequence long, ended boolean")
    targets = spark.createDataFrame([("t1",), ("t2",)], "target string")
    stream = staged(spark, tmp_path / "in", rows, EVENTS, batches)
    got = stateful.run(stateful.append_events(stream, known, targets), str(tmp_path / "state")).collect()
    want = plain_numbers(rows, {f"s{i}": 10 * i for i in range(5)}, {"t1", "t2"})
    assert sorted(((r.session_id, r.sequence_number, r.event_id, r.reason) for r in got), key=str) == want
    assert {r.reason for r in got} == {None, "unknown session", "unknown target", "session has ended"}


def test_stored_sessions_stay_ended(spark, tmp_path):
    known = spark.createDataFrame([("a", 7, True), ("b", 7, False)], "session_id string, last_sequence long, ended boolean")
    stream = staged(spark, tmp_path / "in", [("a", 1, "note", None, T0), ("b", 2, "note", None, T0)], EVENTS, 1)
    got = stateful.run(stateful.append_events(stream, known), str(tmp_path / "state")).collect()
    assert sorted((r.session_id, r.sequence_number, r.reason) for r in got if r.reason is None) == [("b", 8, None)]
    assert [r.reason for r in got if r.session_id == "a"] == ["session has ended"]


LOG = "session_id string, sequence_number long, payload string"


def test_replay_then_tail_has_no_gap_and_no_repeat(spark, tmp_path):
    """While the log is read events go on: those from 30 on reach the tail, those to 40 the log."""
    numbered = [(s, k, f"{s}{k}") for k in range(1, 61) for s in ("a", "b")]
    log = spark.createDataFrame([r for r in numbered if r[1] <= 40], LOG)
    subscribers = spark.createDataFrame([("x", "a", 0), ("y", "a", 35), ("z", "b", 40), ("w", "b", 55), ("v", "c", 0)], "subscriber string, session_id string, after_sequence long")
    stream = staged(spark, tmp_path / "in", [r for r in numbered if r[1] >= 30], LOG, 4)
    first = stateful.replayed(subscribers, log).cache()
    marks = stateful.high_water(subscribers, first)
    later = stateful.run(stateful.tail(stream, marks), str(tmp_path / "state"))
    got = {}
    for r in [*first.collect(), *later.collect()]:
        got.setdefault(r.subscriber, []).append((r.sequence_number, r.payload))
    assert {k: sorted(v) for k, v in got.items()} == {"x": [(k, f"a{k}") for k in range(1, 61)], "y": [(k, f"a{k}") for k in range(36, 61)], "z": [(k, f"b{k}") for k in range(41, 61)], "w": [(k, f"b{k}") for k in range(56, 61)]}


def test_long_replays_end_with_has_more(spark):
    log = spark.createDataFrame([("a", k, "") for k in range(1, 1102)], LOG)
    subscribers = spark.createDataFrame([("x", "a", 0), ("y", "a", 101)], "subscriber string, session_id string, after_sequence long")
    rows = stateful.replayed(subscribers, log)
    got = {r.subscriber: (r.n, r.m, r.most) for r in rows.groupBy("subscriber").agg(F.count("*").alias("n"), F.bool_or("has_more").alias("m"), F.max("sequence_number").alias("most")).collect()}
    assert got == {"x": (1000, True, 1000), "y": (1000, False, 1101)}
    assert [(r.subscriber, r.delivered) for r in stateful.high_water(subscribers, rows).collect()] == [("y", 1101)]


def brute(signals, settle, idle, end):
    """Change sets by looking at every millisecond's state, signals of a moment first."""
    out = []
    by = {}
    for w, kind, path, at in signals:
        by.setdefault(w, []).append((at, kind, path or ""))
    for w, rows in by.items():
        pending, full, change, activity, work = set(), False, None, None, None
        rows.sort()
        times = sorted({t for t, _, _ in rows} | {t + d for t, _, _ in rows for d in (settle, idle)})
        for now in [t for t in times if t <= end]:
            for _, kind, path in [r for r in rows if r[0] == now]:
                if kind == "changed":
                    pending.add(path.replace("\\", "/"))
                    change = now
                elif kind == "activity":
                    activity = now
                elif kind == "fault":
                    full, change = True, now
                elif work is not None:
                    if kind == "failed":
                        pending, full, change = pending | work[0], full or work[1], now
                    work = None
            # a timer is set when work ends or something is pending; it is due at once if both windows are over
            if work is None and (pending or full) and now >= change + settle and (activity is None or now >= activity + idle):
                out.append((w, now, sorted(pending), full))
                work, pending, full = (pending, full), set(), False
    return sorted(out)


SETTLE, IDLE = 500, 2000


def signals(seed, n=120):
    g = random.Random(seed)
    out, at = [], 0
    for _ in range(n):
        at += g.choice([0, 1, 50, 200, 499, 500, 501, 900, 1500, 2500])
        kind = g.choices(["changed", "activity", "fault", "failed", "done"], [6, 2, 1, 2, 4])[0]
        out.append((g.choice("ab"), kind, g.choice(["x.cs", "y\\z.cs", "w.cs"]) if kind == "changed" else None, at))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_controller_as_brute_force(seed):
    rows = signals(seed)
    got = []
    for w in "ab":
        c = stateful.Controller(SETTLE, IDLE)
        c.m["waiting"] = sorted([[at, kind, path] for x, kind, path, at in rows if x == w], key=lambda s: (s[0], s[1], s[2] or ""))
        got += [(w, *s) for s in c.until(10**9)]
    assert sorted(got) == brute(rows, SETTLE, IDLE, 10**9)


def test_change_sets_over_batches_and_orders(spark, tmp_path):
    """The same sets from signals out of order within the watermark, in five batches; the last one only moves the watermark."""
    rows = signals(7)
    ms = lambda t: T0 + datetime.timedelta(milliseconds=t)
    g = random.Random(3)
    end = max(r[3] for r in rows) + 1_000_000
    mixed = sorted(rows, key=lambda r: r[3] + g.randrange(4000))
    sent = [(w, kind, path, ms(at)) for w, kind, path, at in mixed]
    stream = staged(spark, tmp_path / "in", [*sent, *[("clock", "activity", None, ms(end))] * 2], stateful.SIGNALS, 5)
    got = stateful.run(stateful.change_sets(stream, SETTLE, IDLE, "20 seconds"), str(tmp_path / "state")).collect()
    zero = lambda t: round((t - T0).total_seconds() * 1000)
    assert sorted((r.workspace_id, zero(r.dispatched_at), list(r.paths), r.full_inventory) for r in got) == brute(rows, SETTLE, IDLE, end)
    assert any(r.full_inventory for r in got)


def requests(n, seed):
    g = random.Random(seed)
    out, sent = [], []
    for i in range(n):
        at = T0 + datetime.timedelta(milliseconds=700 * i)
        kind = g.choices(["reserve", "complete", "rate_limited"], [10, 5, 0.3])[0]
        gov = g.choice("ab")
        if kind == "reserve":
            lease = g.choice(sent) if sent and g.random() < 0.1 else (gov, f"{gov}{g.randrange(4)}", f"q{i}")
            sent.append(lease)
        else:
            lease = g.choice(sent) if sent else (gov, f"{gov}0", "q")
        out.append((*lease, kind, at, g.choice([0, 10, 300, 900, 2500]), g.choice([0.1, 0.7, 2.0]), g.choice([None, 1000, 9000])))
    return out


def plain_governor(rows, limits):
    out, leases, used, cooldown = [], set(), {}, {}
    for gov, run, request, kind, at, tokens, cost, retry in rows:
        now = round((at - T0).total_seconds() * 1000)
        if kind == "rate_limited":
            cooldown[gov] = max(cooldown.get(gov, -1), now + max(limits.cooldown_ms, retry or 0))
        elif kind == "complete":
            leases.discard((gov, run, request))
        else:
            n, t, c = used.get((gov, run), (0, 0, 0.0))
            denial = None
            if not 1 <= tokens <= 10_000_000:
                denial = "InvalidEstimate"
            elif cooldown.get(gov, -1) > now:
                denial = "CooldownActive"
            elif (gov, run, request) in leases:
                pass
            elif sum(x[0] == gov for x in leases) >= limits.concurrent:
                denial = "ConcurrencyLimitReached"
            elif n >= limits.requests:
                denial = "RequestQuotaExhausted"
            elif t > limits.tokens - tokens:
                denial = "TokenQuotaExhausted"
            elif c > limits.cost - cost:
                denial = "CostQuotaExhausted"
            else:
                leases.add((gov, run, request))
                used[gov, run] = (n + 1, t + tokens, c + cost)
            out.append((gov, run, request, denial, cooldown[gov] - now if denial == "CooldownActive" else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 4])
def test_governor_as_a_loop(spark, tmp_path, batches):
    rows, limits = requests(400, 5), stateful.Limits(6, 20, 5_000, 16.0, 5000)
    stream = staged(spark, tmp_path / "in", rows, stateful.REQUESTS, batches)
    got = stateful.run(stateful.governed(stream, limits), str(tmp_path / "state")).collect()
    want = plain_governor(rows, limits)
    assert sorted(((r.governor_id, r.run_id, r.request_id, r.denial, r.retry_after_ms) for r in got), key=str) == want
    assert {w[3] for w in want} >= {None, "InvalidEstimate", "CooldownActive", "ConcurrencyLimitReached", "TokenQuotaExhausted"}


def test_sessions_replay_limits(spark):
    with pytest.raises(ValueError):
        sessions.replay(spark.createDataFrame([], "session_id string, sequence_number long"), 0, 1001)
