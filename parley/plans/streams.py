"""Streaming twins: each runs availableNow over staged input and equals its batch query,
so the batch query's oracle statement is reused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import turns
from parley.params import DEFAULT, EVENTS as P
from parley.plans import audio as qa, speech as qs, telemetry as qt, text as qx
from parley.plans.oracle_base import sql
from parley.plans.registry import ORACLES, query
from parley.sources import agent_events, audio_vectors, chat_messages, chunks
from parley.session import written
from parley.streaming import twins
from parley.streaming.runner import Progress

TAIL_SQL = sql(f"""
SELECT session_id, event_id, which, t_us, y, kind, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY session_id, which ORDER BY t_us DESC, event_id DESC) AS BIGINT) AS rank
  FROM tel WHERE kind = 'value') WHERE rank <= {P.telemetry_points}
UNION ALL
SELECT e.session_id, e.event_id, e.which, e.t_us, CAST(NULL AS DOUBLE), 'event', CAST(NULL AS BIGINT)
FROM tel e LEFT JOIN (SELECT session_id, max(t_us) AS mx FROM tel WHERE kind = 'value' GROUP BY session_id) m
  USING (session_id)
WHERE e.kind = 'event' AND (m.mx IS NULL OR e.t_us >= m.mx - {P.us(P.telemetry_retention)})
""", qt.TEL)


@query("stream_speech_segments", ORACLES["speech_segments"])
def q_stream_speech_segments(spark, d):
    return twins.run_segments(spark, agent_events(spark, d, qs.SPEECH_EDGES))


@query("stream_debounce", ORACLES["endpoint_debounce"])
def q_stream_debounce(spark, d):
    return twins.run_debounce(spark, agent_events(spark, d, qs.USER_EDGES), P)


@query("stream_agent_state", ORACLES["agent_state_timeline"])
def q_stream_agent_state(spark, d):
    return twins.run_agent_state(spark, agent_events(spark, d), P)


@query("stream_throttle", ORACLES["throttle_stream"])
def q_stream_throttle(spark, d):
    return twins.run_throttle(spark, chunks(spark, d), DEFAULT)


@query("stream_telemetry_tail", TAIL_SQL)
def q_stream_telemetry_tail(spark, d):
    return twins.run_telemetry_tail(spark, qt.tel(spark, d), P)


@query("stream_usage", ORACLES["usage_summary"])
def q_stream_usage(spark, d):
    return twins.run_usage(spark, turns.metrics(agent_events(spark, d, qs.AGENT_VAD), P))


@query("stream_asset_dedupe", ORACLES["asset_sink"])
def q_stream_asset_dedupe(spark, d):
    return twins.run_asset_dedupe(spark, audio_vectors(spark, d))


@query("stream_event_log", ORACLES["event_log"])
def q_stream_event_log(spark, d):
    return twins.run_event_log(spark, agent_events(spark, d))


# --- rows out of order: they arrive up to a day of the test tables late, the watermark's delay ----
DELAY_US = P.us(24.0)


def arriving(events, late_every: int = 0, late_us: int = 0):
    """Events with the time at which they arrive: up to the delay late, each ``late_every``-th one ``late_us`` more."""
    at = F.col("t_us") + F.expr(f"event_id * 7919 % 1000 * {DELAY_US // 1000}")
    if late_every:
        at = at + F.when(F.col("event_id") % late_every == 0, F.lit(late_us)).otherwise(F.lit(0))
    return events.withColumn("arrival_us", at.cast("bigint"))


@query("stream_speech_segments_shuffled", ORACLES["speech_segments"])
def q_stream_speech_segments_shuffled(spark, d):
    return twins.run_segments(spark, arriving(agent_events(spark, d, qs.SPEECH_EDGES)), DELAY_US, "arrival_us")


@query("stream_debounce_shuffled", ORACLES["endpoint_debounce"])
def q_stream_debounce_shuffled(spark, d):
    return twins.run_debounce(spark, arriving(agent_events(spark, d, qs.USER_EDGES)), P, DELAY_US, "arrival_us")


@query("stream_agent_state_shuffled", ORACLES["agent_state_timeline"])
def q_stream_agent_state_shuffled(spark, d):
    return twins.run_agent_state(spark, arriving(agent_events(spark, d)), P, DELAY_US, "arrival_us")


LATE_US = 20 * DELAY_US
LATE_STEPS = 5


def steps(df, col: str, n: int) -> list[int]:
    """``n - 1`` equally spaced values between the least and the greatest value of ``col``."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    return [] if lo is None else [lo + (hi - lo) // n * k for k in range(1, n)]


@query("stream_late_rows", sql(f"""
SELECT k AS step, count(*) AS n_rows, count(*) FILTER (WHERE t_us <= (w // 1000 - {DELAY_US // 1000}) * 1000) AS n_late
FROM s LEFT JOIN (SELECT k, max(max(t_us)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM s GROUP BY k) USING (k)
GROUP BY k
""", f"""
a AS (SELECT t_us, t_us + event_id * 7919 % 1000 * {DELAY_US // 1000} + CASE WHEN event_id % 20 = 0 THEN {LATE_US} ELSE 0 END AS arrival_us
      FROM agent_events WHERE event_type IN ('user_started_speaking', 'user_stopped_speaking')),
s AS (SELECT t_us, least((arrival_us - lo) // ((hi - lo) // {LATE_STEPS}), {LATE_STEPS - 1}) AS k
      FROM a, (SELECT min(arrival_us) AS lo, max(arrival_us) AS hi FROM a))
"""))
def q_stream_late_rows(spark, d):
    """Rows that came behind the watermark, counted per step of the stream."""
    events, seen = arriving(agent_events(spark, d, qs.USER_EDGES), 20, LATE_US), Progress()
    at = steps(events, "arrival_us", LATE_STEPS)
    twins.run_debounce(spark, events, P, DELAY_US, "arrival_us", at, seen)
    rows = [(k, sum(b["rows"] for b in seen.batches if b["run"] == k), sum(b["late"] for b in seen.batches if b["run"] == k))
            for k in range(len(at) + 1)]
    return spark.createDataFrame([r for r in rows if r[1]], "step long, n_rows long, n_late long")


TAIL_STEPS = 3


@query("stream_telemetry_steps", sql(f"""
SELECT k AS step, session_id, which, kind, count(*) AS n_points, min(t_us) AS oldest_us, max(t_us) AS newest_us FROM (
  SELECT k, session_id, which, t_us, kind FROM (
    SELECT k, t.*, row_number() OVER (PARTITION BY k, session_id, which ORDER BY t_us DESC, event_id DESC) AS r
    FROM upto AS t WHERE kind = 'value') WHERE r <= {P.telemetry_points}
  UNION ALL
  SELECT e.k, e.session_id, e.which, e.t_us, 'event' FROM upto AS e LEFT JOIN
    (SELECT k, session_id, max(t_us) AS mx FROM upto WHERE kind = 'value' GROUP BY ALL) AS m USING (k, session_id)
  WHERE e.kind = 'event' AND (m.mx IS NULL OR e.t_us >= m.mx - {P.us(P.telemetry_retention)}))
GROUP BY ALL
""", qt.TEL + f""",
upto AS (SELECT k, tel.* FROM tel, (SELECT min(t_us) AS lo, max(t_us) AS hi FROM tel), (SELECT unnest(range({TAIL_STEPS})) AS k)
         WHERE k = {TAIL_STEPS - 1} OR t_us < lo + (hi - lo) // {TAIL_STEPS} * (k + 1))
"""))
def q_stream_telemetry_steps(spark, d):
    """The tail table as it stands behind every step of the stream: points and their time span per session and series."""
    tel = qt.tel(spark, d)
    seen = []

    def look(k, table):
        seen.append(written(table.groupBy("session_id", "which", "kind").agg(
            F.count("*").alias("n_points"), F.min("t_us").alias("oldest_us"), F.max("t_us").alias("newest_us")).withColumn("step", F.lit(k).cast("long")), "tail-step"))

    twins.run_telemetry_tail(spark, tel, P, look, steps(tel, "t_us", TAIL_STEPS))
    return reduce(DataFrame.unionByName, seen)


@query("chunk_source_live", sql("SELECT stream_id, seq, t_us, delta FROM chunks"))
def q_chunk_source_live(spark, d):
    """The reply chunks as a live stream: replayed through a log, at most 20,000 rows a trigger."""
    return twins.replay(spark, chunks(spark, d), "stream_id", ["stream_id", "seq"], 20_000).read().drop("batch")


@query("chat_source_live", sql("SELECT session_id, turn, role, text FROM chat_messages"))
def q_chat_source_live(spark, d):
    """The chat messages as a live stream, in the order of their sessions."""
    rows = chat_messages(spark, d).drop("audio")
    return twins.replay(spark, rows, "session_id", ["session_id", "turn"], 20_000).read().drop("batch")


_ = (qs, qa, qx)  # the twins reuse oracles registered by these modules
