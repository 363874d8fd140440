"""Streaming forms of the order-dependent operators (``applyInPandasWithState``).

Each keeps the smallest state the rule needs per key, fires pending work with
event-time timeouts and emits final rows in append mode (the telemetry tail and usage: the changed keys of every trigger, in
update mode, to a table of newest versions); each equals its batch twin when run by ``runner.run_available_now``. Rows may come
out of order by up to the watermark's delay, where the rule has one; see ``ordered``.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import audio as au
from parley.operators import segments as seg
from parley.operators import text as tx
from parley.operators import turns
from parley.operators.segments import USER_END, USER_START
from parley.params import Params
from parley.session import state_path
from parley.streaming.ordered import (END_US, NEVER, SHIFT_US, AgentState, Debounce, Segments, apply_rule, bucket, pack, stacked, unpack,
                                      watermarked)
from parley.streaming.runner import Progress, cheap_local_logs, run_available_now
from parley.streaming.sinks import BatchSink, UpsertSink

SLICES = 4  # time-ordered input files, one per micro-batch


# --- rules over events in time order ----------------------------------------------------
SEG_SCHEMA = "session_id long, party string, start_event_id long, end_event_id long, start_us long, end_us long"
DEB_SCHEMA = "session_id long, end_event_id long, end_us long, fire_us long"
STATE_SCHEMA = "session_id long, event_id long, state string, t_us long, eff_us long, end_us long"


def stream_speech_segments(stream: DataFrame, delay_us: int = 0) -> DataFrame:
    """State per (session, party): the last edge. Emits a segment at the END after a START. ``stream`` is ``watermarked``."""
    edges = seg.edges(stream, "ts").withColumnRenamed("edge", "kind")
    return apply_rule(edges, Segments(), SEG_SCHEMA, delay_us)


def stream_debounce(stream: DataFrame, p: Params, delay_us: int = 0) -> DataFrame:
    """State per session: the pending END. Any START/END cancels it; the event-time
    timeout at END + delay emits the fire. ``stream`` is ``watermarked``."""
    e = stream.where(F.col("event_type").isin(USER_START, USER_END)).withColumnRenamed("event_type", "kind")
    return apply_rule(e, Debounce(p.us(p.final_transcript_timeout)), DEB_SCHEMA, delay_us)


def stream_agent_state(stream: DataFrame, p: Params, gap_us: int | None = None, delay_us: int = 0) -> DataFrame:
    """State per session: the newest request (not yet known to be kept) and the last kept
    state (waiting for its end). With ``gap_us`` a session idle for so long is closed and starts anew; without, sessions close when the
    stream ends. ``stream`` is ``watermarked``."""
    return apply_rule(stream.withColumnRenamed("event_type", "kind"), AgentState(p, gap_us), STATE_SCHEMA, delay_us)


# --- throttle ----------------------------------------------------------------------------
def _throttle_fn(interval: int, gap_us: int | None):
    """The greedy rule for a bucket of streams; its state is a packed table with a row for each of them."""
    cols = ["stream_id", "emit_idx", "seq", "t_us", "is_tail", "delta"]
    held = ["stream_id", "last_emit", "n", "buf", "last_seq", "last_t"]

    def fn(key, pdfs, state):
        rows = stacked(list(pdfs), ["stream_id", "seq", "t_us", "delta"])
        states = stacked(unpack(state.get[0]) if state.exists else [], held)
        number = pd.factorize(pd.concat([states["stream_id"], rows["stream_id"]], ignore_index=True), use_na_sentinel=False)[0]
        s = {g: list(v) for g, v in zip(number[:len(states)].tolist(), zip(*(states[c].tolist() for c in held)))}
        g, seq, t = number[len(states):], rows["seq"].to_numpy("int64"), rows["t_us"].to_numpy("int64")
        order = np.lexsort((seq, g))
        g, seq, t = (c[order].tolist() for c in (g, seq, t))
        name, delta = (rows[c].to_numpy()[order].tolist() for c in ("stream_id", "delta"))
        out, i = [], 0
        while i < len(g):
            who = g[i]
            _, last, n, buf, *_ = s.get(who, (None, NEVER, 0, "", 0, 0))
            first, end = i, bisect_right(g, who, i)
            for i in range(first, end):                          # sequential by definition
                if last == NEVER or t[i] - last >= interval:
                    n, last = n + 1, t[i]
                    out.append((name[i], n, seq[i], last, False, buf + "".join(delta[first:i + 1])))
                    buf, first = "", i + 1
            i = end
            s[who] = [name[end - 1], last, n, buf + "".join(delta[first:end]), seq[end - 1], t[end - 1]]
        mark_ms = state.getCurrentWatermarkMs()
        ends = {who: ((END_US if gap_us is None else v[5] + gap_us) + SHIFT_US) // 1000 for who, v in s.items()}
        for who, end in ends.items():
            if end < mark_ms:
                _, _, n, buf, last_seq, last_t = v = s.pop(who)
                out.append((v[0], n + 1, last_seq, last_t, True, buf))
        if s:
            state.update((pack(pd.DataFrame(list(s.values()), columns=held)),))
            state.setTimeoutTimestamp(max(mark_ms, min(end for who, end in ends.items() if who in s)))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=cols)

    return fn


def stream_throttle(stream: DataFrame, p: Params, gap_us: int | None = None) -> DataFrame:
    """State per reply stream (dealt to buckets, see ``ordered``): last emit time, emitted count, text since the last emit; the
    tail is flushed when the stream has been idle for ``gap_us`` (a chunk after that starts the reply anew), without it at the end of all streams.
    ``stream`` is ``watermarked``."""
    iv = p.us(p.throttle_interval)
    rows = stream.select(bucket(["stream_id"]).alias("_bucket"), "stream_id", "seq", "t_us", "delta", "ts")
    return rows.groupBy("_bucket").applyInPandasWithState(
        _throttle_fn(iv, gap_us), tx.THROTTLE_SCHEMA, "streams binary", "append", "EventTimeTimeout")


# --- telemetry tail -----------------------------------------------------------------------
TAIL_SCHEMA = "session_id long, event_id long, which string, t_us long, y double, kind string, rank long"
TAIL_STATE = ("v_which array<string>, v_id array<long>, v_t array<long>, v_y array<double>, "
              "m_which array<string>, m_id array<long>, m_t array<long>, max_vt long")


def _tail_fn(n: int, retention: int):
    names = ["session_id", "event_id", "which", "t_us", "y", "kind", "rank"]

    def fn(key, pdfs, state):
        g = state.get if state.exists else ([], [], [], [], [], [], [], None)
        vals, marks, max_vt = list(zip(*g[:4])), list(zip(*g[4:7])), g[7]     # (which, event_id, t_us, y), (which, event_id, t_us)
        for pdf in pdfs:
            for kind, which, i, t, y in zip(*(pdf[c].tolist() for c in ("kind", "which", "event_id", "t_us", "y"))):
                if kind == "value":
                    vals.append((which, int(i), int(t), float("nan") if y is None else float(y)))
                    max_vt = int(t) if max_vt is None else max(max_vt, int(t))
                elif kind == "event":
                    marks.append((which, int(i), int(t)))
        vals.sort(key=lambda v: (v[0] is None, v[0] or "", -v[2], -v[1]))
        kept, out, rank, last = [], [], 0, ()
        for v in vals:
            rank, last = (rank + 1 if last == v[0] else 1), v[0]
            if rank <= n:                                                    # bounded
                kept.append(v)
                out.append((key[0], v[1], v[0], v[2], v[3], "value", rank))
        if max_vt is not None:
            marks = [m for m in marks if m[2] >= max_vt - retention]         # strict <: exactly `retention` stays
        out += [(key[0], m[1], m[0], m[2], float("nan"), "event", None) for m in marks]
        state.update((*(list(c) for c in list(zip(*kept)) or [()] * 4), *(list(c) for c in list(zip(*marks)) or [()] * 3), max_vt))
        if out:
            cols = dict(zip(names, map(list, zip(*out))))
            cols["rank"] = pd.array(cols["rank"], "Int64")
            yield pd.DataFrame(cols)

    return fn


def stream_telemetry_tail(stream: DataFrame, p: Params) -> DataFrame:
    """State per session: newest ``telemetry_points`` values per series and the markers inside the retention window (both
    bounded). In update mode: every trigger gives the whole current tail of each session that got rows. Rows may come in any order."""
    return stream.groupBy("session_id").applyInPandasWithState(
        _tail_fn(p.telemetry_points, p.us(p.telemetry_retention)), TAIL_SCHEMA, TAIL_STATE, "update", "NoTimeout")


# --- drivers: stage, stream, read back ----------------------------------------------------------
def _run_rule(spark: SparkSession, name: str, events: DataFrame, rule, delay_us: int, order_col: str, at: list[int] | None,
              progress: Progress | None) -> DataFrame:
    def start(stream, out):
        return rule(watermarked(stream, delay_us)).writeStream.format("parquet").option("path", out).outputMode("append")

    return run_available_now(spark, name, events, start, sentinel={"event_type": USER_START}, slices=SLICES, order_col=order_col,
                             at=at, progress=progress)


def run_segments(spark: SparkSession, events: DataFrame, delay_us: int = 0, order_col: str = "t_us", at: list[int] | None = None,
                 progress: Progress | None = None) -> DataFrame:
    """``order_col``: the order in which rows arrive; with a delay it may differ from their times by that much."""
    return _run_rule(spark, "speech_segments", events, lambda s: stream_speech_segments(s, delay_us), delay_us, order_col, at, progress)


def run_debounce(spark: SparkSession, events: DataFrame, p: Params, delay_us: int = 0, order_col: str = "t_us",
                 at: list[int] | None = None, progress: Progress | None = None) -> DataFrame:
    return _run_rule(spark, "debounce", events, lambda s: stream_debounce(s, p, delay_us), delay_us, order_col, at, progress)


def run_agent_state(spark: SparkSession, events: DataFrame, p: Params, delay_us: int = 0, order_col: str = "t_us",
                    at: list[int] | None = None, progress: Progress | None = None) -> DataFrame:
    return _run_rule(spark, "agent_state", events, lambda s: stream_agent_state(s, p, None, delay_us), delay_us, order_col, at, progress)


def run_throttle(spark: SparkSession, chunks: DataFrame, p: Params) -> DataFrame:
    def start(stream, out):
        return stream_throttle(watermarked(stream), p).writeStream.format("parquet").option("path", out).outputMode("append")

    return run_available_now(spark, "throttle", chunks, start, sentinel={}, slices=SLICES, order_col="t_us")


def run_telemetry_tail(spark: SparkSession, telemetry: DataFrame, p: Params, after_slice=None, at: list[int] | None = None) -> DataFrame:
    """The tail table after the last slice; ``after_slice(k, table)`` sees it behind every one."""
    def sink(out: str) -> UpsertSink:
        return UpsertSink(spark, out, ["session_id"])

    def start(stream, out):
        return stream_telemetry_tail(stream, p).writeStream.outputMode("update").foreachBatch(sink(out).foreach())

    seen = None if after_slice is None else lambda k, out: after_slice(k, sink(out).current(TAIL_SCHEMA))
    return run_available_now(spark, "telemetry_tail", telemetry, start, slices=SLICES, order_col="t_us", at=at, after_slice=seen,
                             read_result=lambda out: sink(out).current(TAIL_SCHEMA))


def run_usage(spark: SparkSession, metrics_df: DataFrame) -> DataFrame:
    """Running usage per session: a streaming aggregation in update mode; every trigger brings the sessions that
    changed, and their rows replace the older ones."""
    schema = turns.usage_summary(metrics_df).schema
    keys = ["session_id"]

    def start(stream, out):
        return turns.usage_summary(stream).writeStream.outputMode("update").foreachBatch(UpsertSink(spark, out, keys).foreach())

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return run_available_now(spark, "usage", metrics_df, start, slices=SLICES, order_col="t_us",
                             read_result=lambda out: UpsertSink(spark, out, keys).current(ddl))


def run_asset_dedupe(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """Content-addressed store fed by a stream: each micro-batch writes only fingerprints
    not already stored (once, also when it is tried again; the store never expires)."""

    def start(stream, out):
        return stream.writeStream.foreachBatch(lambda batch, batch_id: au.AssetStore(spark, out).add(batch, batch_id))

    r = run_available_now(spark, "assets", vectors, start, slices=SLICES, order_col="vec_id",
                          read_result=lambda out: au.asset_source(au.AssetStore(spark, out)))
    return r.select("fp", "vec_id", "path", "prefix", F.md5("wav").alias("wav_md5"))


LOG_SCHEMA = "session_id long, event_id long, t_us long, event string"


def run_event_log(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Fan-out of the live event log: every micro-batch is written exactly once, partitioned by
    event name, so each subscriber reads its own directory (``BatchSink``)."""
    from parley.operators.telemetry import event_log

    def sink(out: str) -> BatchSink:
        return BatchSink(spark, out, ("event",))

    def start(stream, out):
        return stream.writeStream.foreachBatch(sink(out).foreach(event_log))

    return run_available_now(spark, "event_log", events, start, slices=SLICES, order_col="t_us",
                             read_result=lambda out: sink(out).read(LOG_SCHEMA).drop("batch"))


def replay(spark: SparkSession, rows: DataFrame, key: str, order: list[str], rows_per_trigger: int, batches: int = 3) -> BatchSink:
    """``rows`` appended to a live log in some batches, read from it as a stream with back pressure, as its sink holds
    them (with the number of the micro-batch)."""
    from parley.sources.live import Log, live_stream

    base = state_path(spark, f"live/{uuid.uuid4().hex}")
    log, sink = Log(spark, f"{base}/log", key, order), BatchSink(spark, f"{base}/out")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    query = None
    try:
        for k in range(batches):
            log.append(rows.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k))      # a stream's rows come in one batch
            if query is None:
                stream = live_stream(spark, log.path, columns, f"{base}/ckpt", rows_per_trigger)
                with cheap_local_logs(spark, base):
                    query = stream.writeStream.option("checkpointLocation", f"{base}/ckpt").foreachBatch(sink.foreach()).start()
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
    return sink
