"""Streams: rows out of order and late, sinks that hold each batch once, tails per trigger, no reserved keys."""

import os
import sys

import pandas as pd
import pytest
from conftest import ev_rows
from pyspark.sql import functions as F

from parley.operators import segments, telemetry, text, turns
from parley.params import DEFAULT, EVENTS, HOUR_US
from parley.streaming import ordered, twins
from parley.streaming.runner import Progress
from parley.streaming.sinks import BatchSink, UpsertSink
from parley.session import state_path

US, UE, AS, AE = "user_started_speaking", "user_stopped_speaking", "agent_started_speaking", "agent_stopped_speaking"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=str)


def session_events(spark):
    """Sessions -1 and null among others, gaps of more than a year, edges at the same time."""
    out, i = [], 0
    for session in (-1, 0, 5, None):
        t = 0
        for k in range(40):
            t += [1, 7, 0, 3, 10_000][(k * 3 + (session or 0)) % 5] * HOUR_US
            out.append((session, i, t, [US, UE, AS, AE, "vad_inference_done"][(k * 7 + i) % 5]))
            i += 1
    return ev_rows(spark, out)


def test_in_order_equals_batch_with_any_key_and_gap(spark):
    ev = session_events(spark)
    assert rows(twins.run_debounce(spark, ev, EVENTS)) == rows(turns.endpoint_debounce(ev, EVENTS), "session_id", "end_event_id", "end_us", "fire_us")
    batch = turns.agent_state_timeline(ev, EVENTS)
    assert rows(twins.run_agent_state(spark, ev, EVENTS), *batch.columns) == rows(batch)


def test_throttle_keeps_any_key_and_gap(spark):
    ck = spark.createDataFrame([("__sentinel__", 1, 0, "a"), ("__sentinel__", 2, 5_000_000, " b"), ("x", 1, 0, "c"), ("x", 2, 100, " d"), ("x", 3, 90_000_000, " e")],
                               "stream_id string, seq int, t_us long, delta string")
    assert rows(twins.run_throttle(spark, ck, DEFAULT)) == rows(text.throttle_stream(ck, DEFAULT))


def test_late_rows_are_counted_and_the_rest_equals_batch(spark):
    delay = 24 * HOUR_US
    base = [(s, k, k * 2 * HOUR_US, [US, UE][(k * 5 + s) % 3 % 2]) for s in (1, 2) for k in range(s, 400, 2)]
    ev = ev_rows(spark, base)
    arrive = ev.withColumn("arrival_us", F.col("t_us") + (F.col("event_id") * 7919 % 24) * HOUR_US
                           + F.when(F.col("event_id") % 10 == 0, 300 * HOUR_US).otherwise(0))
    at = [200 * HOUR_US, 400 * HOUR_US, 600 * HOUR_US]
    seen = Progress()
    got = rows(twins.run_debounce(spark, arrive, EVENTS, delay, "arrival_us", at, seen))
    step = sum([F.when(F.col("arrival_us") >= b, 1).otherwise(0) for b in at], F.lit(0))
    all_rows = arrive.withColumn("step", step).collect()
    newest = {k: max((r.t_us for r in all_rows if r.step < k), default=None) for k in range(4)}
    late = {r.event_id for r in all_rows if newest[r.step] is not None and r.t_us <= newest[r.step] - delay}
    assert late and seen.late == len(late) and seen.rows == len(all_rows)
    in_time = ev.where(~F.col("event_id").isin(*late))
    assert got == rows(turns.endpoint_debounce(in_time, EVENTS), "session_id", "end_event_id", "end_us", "fire_us")


def test_shuffled_within_the_delay_equals_batch(spark):
    delay = 24 * HOUR_US
    ev = ev_rows(spark, [(s, 1000 * s + k, (k * 37 % 900) * HOUR_US, [US, UE, AS, AE][(k * 7) % 4]) for s in (1, 2, 3) for k in range(100)])
    arrive = ev.withColumn("arrival_us", F.col("t_us") + (F.col("event_id") * 7919 % 24) * HOUR_US)
    seen = Progress()
    assert rows(twins.run_segments(spark, arrive, delay, "arrival_us", progress=seen)) == rows(
        segments.speech_segments(ev, EVENTS), "session_id", "party", "start_event_id", "end_event_id", "start_us", "end_us")
    assert seen.late == 0 and seen.rows == 300
    batch = turns.agent_state_timeline(ev, EVENTS)
    assert rows(twins.run_agent_state(spark, arrive, EVENTS, delay, "arrival_us"), *batch.columns) == rows(batch)


def test_tail_after_every_slice(spark):
    ev = ev_rows(spark, [(s, 100 * s + k, (k * 31 % 60) * HOUR_US, "vad_inference_done" if k % 3 else US, float(k)) for s in (-1, 2) for k in range(60)])
    p = EVENTS.with_(telemetry_points=5, telemetry_retention=10.0)
    tel = telemetry.telemetry_source(ev, p)
    at = [20 * HOUR_US, 40 * HOUR_US]
    cols = ["session_id", "event_id", "which", "t_us", "kind"]
    seen = []
    last = twins.run_telemetry_tail(spark, tel, p, lambda k, table: seen.append(rows(table, *cols)), at)
    for k, end in enumerate([*at, 1 << 60]):
        upto = tel.where(F.col("t_us") < end)
        tail = telemetry.series_tail(upto.where("kind = 'value'"), 5).select(*cols)
        marks = telemetry.event_retention(upto, p.us(10.0)).withColumn("kind", F.lit("event")).select(*cols)
        assert seen[k] == rows(tail.unionByName(marks))
    assert rows(last, *cols) == seen[-1]


class Held:
    """State of one key as the function sees it."""

    exists, get = False, None

    def update(self, s):
        self.exists, self.get = True, s

    def remove(self):
        self.exists, self.get = False, None

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, ms):
        pass


def test_keys_without_rows_give_no_frame_and_tails_are_cheap():
    """What a key costs in a micro-batch: no frame where the rule gives nothing, and no tables of its own for a tail."""
    run, state = ordered.reordered(ordered.Segments(), True), Held()
    edge = lambda t, kind: iter([pd.DataFrame({"t_us": [t], "event_id": [t], "kind": [kind]})])
    assert list(run((1, "user"), edge(5, "start"), state)) == []
    (got,) = run((1, "user"), edge(9, "end"), state)
    assert got.to_dict("records") == [dict(session_id=1, party="user", start_event_id=5, end_event_id=9, start_us=5, end_us=9)]
    tail, state, calls = twins._tail_fn(2, 10), Held(), []
    rows_of = lambda *r: iter([pd.DataFrame(r, columns=["kind", "which", "event_id", "t_us", "y"])])
    sys.setprofile(lambda frame, what, arg: calls.append(what))
    out = list(tail((7,), rows_of(("value", "b", 1, 3, .5), ("value", "a", 2, 4, .25), ("value", "b", 3, 3, 1.0), ("value", "b", 4, 1, 0.0), ("event", "e", 5, 0, None)), state))
    sys.setprofile(None)
    assert [tuple(r)[1:4] + tuple(r)[5:] for r in out[0].astype(object).where(out[0].notna(), None).values] == [
        (2, "a", 4, "value", 1), (3, "b", 3, "value", 1), (1, "b", 3, "value", 2), (5, "e", 0, "event", None)]
    (out,) = tail((7,), rows_of(("value", "a", 6, 11, .0)), state)
    assert out["event_id"].tolist() == [6, 2, 3, 1] and state.get[6] == [] and state.get[7] == 11
    assert len(calls) < 8000, len(calls)


def test_each_batch_once(spark):
    s = BatchSink(spark, state_path(spark, "test-sink-once"))
    a, b = spark.range(3), spark.range(10, 12)
    s.write(a, 0)
    s.write(b, 0)                                        # the same batch again: nothing changes
    assert rows(s.read(), "id") == [(0,), (1,), (2,)]
    commit, s.ledger.commit = s.ledger.commit, lambda batch_id: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        s.write(b, 1)                                    # written, but the driver is lost before the entry
    assert rows(s.read(), "id") == [(0,), (1,), (2,)]
    s.ledger.commit = commit
    s.write(b, 1)                                        # the retry replaces what was left
    assert rows(s.read(), "id") == [(0,), (1,), (10,), (11,), (2,)]
    assert BatchSink(spark, state_path(spark, "test-sink-none")).read("id long").count() == 0


def test_upsert_and_snapshots(spark):
    s = UpsertSink(spark, state_path(spark, "test-sink-upsert"), ["k"])
    make = lambda *r: spark.createDataFrame(r, "k string, v long")
    s.write(make(("a", 1), ("a", 2), ("b", 1), (None, 1)), 0)
    s.write(make(("a", 9)), 1)
    want = [("a", 9), ("b", 1), (None, 1)]
    assert rows(s.current()) == sorted(want, key=str)
    s.compact()
    s.compact()
    assert rows(s.current()) == sorted(want, key=str)
    s.write(make((None, 7), ("c", 1)), 2)
    assert rows(s.current()) == sorted([("a", 9), ("b", 1), (None, 7), ("c", 1)], key=str)
    commit, s.folded.commit = s.folded.commit, lambda batch_id: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        s.compact()
    s.folded.commit = commit
    assert s.current().count() == 4 and s.read().count() == 7


class Marked(Held):
    """``Held`` with a watermark that moves."""

    mark = -ordered.SHIFT_US

    def getCurrentWatermarkMs(self):
        return (self.mark + ordered.SHIFT_US) // 1000


def test_a_bucket_of_keys_costs_one_call():
    """Shuffled segments of 3,000 keys in one group: rows wait for the watermark, all keys go through in one step."""
    run, state, calls = ordered.reordered(ordered.Segments(), False), Marked(), []
    keys = [(s, p) for s in range(1499) for p in ("user", "agent")] + [(None, "user"), (0, None)]
    rows = [(s or 0, p, (s is None) + 2 * (p is None), t, 10 * k + t // 1000, kind)
            for k, (s, p) in enumerate(keys) for t, kind in ((3000, "end"), (1000, "start"), (2000, "start"), (9000, "end"))]
    frame = pd.DataFrame(rows, columns=["session_id", "party", ordered.NULLS, "t_us", "event_id", "kind"])
    sys.setprofile(lambda f, what, arg: calls.append(what))
    assert list(run((7,), iter([frame[:5000], frame[5000:]]), state)) == []
    state.mark = 5000
    (got,) = run((7,), iter([]), state)
    sys.setprofile(None)
    assert len(calls) < 60_000, len(calls)                       # 20 a key
    out = {tuple(r) for r in got.astype(object).where(got.notna(), None).values.tolist()}
    assert len(got) == len(keys) and out == {(s, p, 10 * k + 2, 10 * k + 3, 2000, 3000) for k, (s, p) in enumerate(keys)}
    state.mark = 20_000
    assert list(run((7,), iter([]), state)) == [] and state.exists


def plain_states(events, p, gap_us, marks):
    """Agent states row by row: released rows behind each mark, then sessions whose time is over."""
    names = {UE: ("thinking", p.us(p.thinking_delay)), AS: ("speaking", 0), AE: ("listening", 0)}
    out, held, done = [], {}, -1 << 60
    for mark in marks:
        for t, i, session, kind in sorted(e for e in events if done < e[0] <= mark):
            asked = [] if session in held else [("initializing", -1, 0)]
            s = held.setdefault(session, {"c": None, "o": None})
            for state, ident, delay in asked + ([(names[kind][0], i, names[kind][1])] if kind in names else []):
                if s["c"] is not None and t >= s["c"][3]:
                    out += [(session, *s["o"], s["c"][3])] if s["o"] else []
                    s["o"] = s["c"]
                s["c"] = (ident, state, t, t + delay)
            s["last"] = t
        done = mark
        for session, s in list(held.items()):
            if (ordered.END_US if gap_us is None else s["last"] + gap_us) <= mark:
                out += [(session, *s["o"], s["c"][3])] if s["o"] else []
                out.append((session, *s["c"], None))
                del held[session]
    return sorted(out, key=str)


@pytest.mark.parametrize("gap_us", [None, 5 * HOUR_US])
def test_agent_states_of_a_bucket_equal_the_plain_rule(gap_us):
    events = [((k * 7919 % 4001) * HOUR_US // 50, k, k * 31 % 9, [US, UE, AS, AE, "vad_inference_done"][k * 13 % 5]) for k in range(1200)]
    marks = [10 * HOUR_US, 11 * HOUR_US, 30 * HOUR_US, 55 * HOUR_US, 100 * HOUR_US, ordered.END_US + 1000]
    run, state, out, done = ordered.reordered(ordered.AgentState(EVENTS, gap_us), False), Marked(), [], -1
    for mark in marks:                       # the rows come in one call, the watermark in the next one
        new = pd.DataFrame([(e[2], 0, e[0], e[1], e[3]) for e in events if done < e[0] <= mark],
                           columns=["session_id", ordered.NULLS, "t_us", "event_id", "kind"])
        for frames, at in (([new], done), ([], mark)):
            state.mark = at
            for got in run((0,), iter(frames), state):
                out += got.astype(object).where(got.notna(), None).values.tolist()
        done = mark
    assert sorted(map(tuple, out), key=str) == plain_states(events, EVENTS, gap_us, marks) and not state.exists
    assert len(out) > 700


def test_input_is_staged_in_one_pass(spark):
    """A step reads its own folder; no step goes over the whole input again."""
    from parley.streaming.runner import run_available_now

    ev = ev_rows(spark, [(1, k, k * HOUR_US, US) for k in range(40)] + [(1, 99, None, US)])
    seen, folders = [], []

    def start(stream, out):
        folders.append(sorted(f for f in os.listdir(out.removesuffix("out") + "src") if "=" in f))
        return stream.writeStream.foreachBatch(lambda batch, b: seen.append(sorted(r.event_id for r in batch.collect())))

    run_available_now(spark, "staged", ev, start, slices=4, order_col="t_us", at=[10 * HOUR_US, 10 * HOUR_US, 20 * HOUR_US, 900 * HOUR_US],
                      read_result=lambda out: None)
    assert [s for s in seen if s] == [[*range(10), 99], [*range(10, 20)], [*range(20, 40)]] and len(folders) == 4
    assert folders[0] == [f"_step={k}" for k in range(3)]         # all there before the first step; none for what has no rows


@pytest.mark.parametrize("gap_us", [None, 1_000_000])
def test_throttle_of_a_bucket_of_streams(gap_us):
    """1,500 streams in one group, their chunks over several triggers: one call a trigger, each stream by the plain rule."""
    run, state, calls, out = twins._throttle_fn(200, gap_us), Marked(), [], []
    chunk = [(f"s{k}" if k else None, n, 100 * n * (k % 5 + 1), f"{n},") for k in range(1500) for n in range(1, 9)]
    marks = [0, 350, 1200, 5000, ordered.END_US + 1000]
    for lo, hi in zip(marks[:-1], marks[1:]):
        rows_ = [c for c in chunk if lo < c[2] <= hi]
        sys.setprofile(lambda f, what, arg: calls.append(what) if what == "call" else None)
        state.mark = lo
        for got in run((0,), iter([pd.DataFrame(rows_[::-1], columns=["stream_id", "seq", "t_us", "delta"])] if rows_ else []), state):
            out += got.values.tolist()
        state.mark = hi
        for got in run((0,), iter([]), state):
            out += got.values.tolist()
        sys.setprofile(None)
    want = []
    for k in range(1500):
        mine, last, n, buf = [c for c in chunk[8 * k:8 * k + 8]], None, 0, ""
        for name, seq, t, delta in mine:
            buf += delta
            if last is None or t - last >= 200:
                n, last = n + 1, t
                want.append([name, n, seq, t, False, buf])
                buf = ""
        want.append([name, n + 1, seq, t, True, buf])
    assert sorted(out, key=str) == sorted(want, key=str) and not state.exists
    assert len(calls) < 45_000, len(calls)                        # 4 triggers, 1,500 streams, 12,000 chunks
