"""Telemetry (values and markers), event log, tracks and participants.

Per-session limits (newest N points, retention) are computed without putting a
session into one task: counts per time bucket decide which buckets can hold the
newest N, and only those rows are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.segments import AGENT_END, AGENT_START, USER_END, USER_START, VAD_DONE
from parley.params import DAY_US, Params

VALUE_SERIES = ("raw_vol", "smoothed_vol", "vad_probability")
MARKERS = (USER_START, USER_END, AGENT_START, AGENT_END)


def telemetry_source(events: DataFrame, p: Params) -> DataFrame:
    """Value points (which, t, y) at each VAD inference and markers (which, t, y null) at
    each speech edge, in one table told apart by ``y is null``."""
    tv = F.greatest(F.lit(0.0), 1.0 - F.col("probability")) if p.allow_interruptions else F.lit(1.0)
    vad = events.where(F.col("event_type") == VAD_DONE)
    vals = vad.select("session_id", "event_id", "t_us", F.explode(F.array(
        F.struct(F.lit("raw_vol").alias("which"), tv.alias("y")),
        F.struct(F.lit("smoothed_vol").alias("which"), tv.alias("y")),
        F.struct(F.lit("vad_probability").alias("which"), F.col("probability").alias("y")),
    )).alias("v")).select("session_id", "event_id", "t_us", "v.which", "v.y")
    marks = events.where(F.col("event_type").isin(*MARKERS)).select(
        "session_id", "event_id", "t_us", F.col("event_type").alias("which"), F.lit(None).cast("double").alias("y"))
    return vals.unionByName(marks).withColumn("kind", F.when(F.col("y").isNull(), "event").otherwise("value"))


def relative_time(telemetry: DataFrame) -> DataFrame:
    """x = t - session start (first record of the session)."""
    start = telemetry.groupBy("session_id").agg(F.min("t_us").alias("_start"))
    return telemetry.join(start, "session_id").withColumn("x_us", F.col("t_us") - F.col("_start")).drop("_start")


def session_gate(events: DataFrame, telemetry: DataFrame, close_after_us: int = 20 * DAY_US) -> DataFrame:
    """Keep records from the session start (first user START) until close (start + 20 days,
    exclusive); x is relative to the start."""
    start = events.where(F.col("event_type") == USER_START).groupBy("session_id").agg(F.min("t_us").alias("_start"))
    t = telemetry.join(start, "session_id")
    return t.where((F.col("t_us") >= F.col("_start")) & (F.col("t_us") < F.col("_start") + F.lit(close_after_us))) \
        .select("session_id", "event_id", "which", "kind", (F.col("t_us") - F.col("_start")).alias("x_us"), "y")


def series_tail(values: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` points per (session, series). Spark limits each map task to n rows per key before
    the exchange (WindowGroupLimit), so a hot series is no skew."""
    w = Window.partitionBy("session_id", "which").orderBy(F.col("t_us").desc(), F.col("event_id").desc())
    return values.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n) \
        .withColumn("rank", F.col("_rank").cast("bigint")).drop("_rank")


def event_retention(telemetry: DataFrame, retention_us: int) -> DataFrame:
    """Markers older than ``retention`` before the newest value point are dropped (strict <,
    so exactly ``retention`` is kept); markers alone never trigger trimming."""
    newest = telemetry.where(F.col("kind") == "value").groupBy("session_id").agg(F.max("t_us").alias("_max_x"))
    ev = telemetry.where(F.col("kind") == "event").join(newest, "session_id", "left")
    return ev.where(F.col("_max_x").isNull() | (F.col("t_us") >= F.col("_max_x") - F.lit(retention_us))) \
        .select("session_id", "event_id", "which", "t_us")


# Reference event names: VAD inference results are published as metrics.
EVENT_NAMES = {VAD_DONE: "metrics_collected"}


def event_log(events: DataFrame, subscriber: str | None = None) -> DataFrame:
    """Named agent events in one long table; a subscriber is a filter on the name."""
    name = F.when(F.col("event_type") == VAD_DONE, F.lit("metrics_collected")).otherwise(F.col("event_type"))
    out = events.select("session_id", "event_id", "t_us", name.alias("event"))
    return out if subscriber is None else out.where(F.col("event") == subscriber)


# --- tracks and participants (test derivation: room = user_id % 10, participant =
# user_id, track id = event_id, source = MICROPHONE for 'click' rows) -----------------
def tracks(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("session_id") % 10).alias("room"), F.col("session_id").alias("participant"),
        F.col("event_id").alias("track_id"), "t_us",
        F.when(F.col("event_type") == USER_END, "MICROPHONE").otherwise("OTHER").alias("source"))


def track_filter(events: DataFrame) -> DataFrame:
    """Only microphone tracks are subscribed."""
    return tracks(events).where(F.col("source") == "MICROPHONE").drop("source")


def first_track(events: DataFrame, p: Params) -> DataFrame:
    """Subscription history per participant: each new microphone track (different from the
    current one) replaces the previous subscription; the first one is flagged."""
    from parley.operators.scan import prev, scan

    t = track_filter(events)
    s = scan(t, ["participant"], ["t_us", "track_id"], {"replaced_track_id": prev(F.col("track_id"))}, p.bucket_us)
    return s.select("participant", "track_id", "t_us", "replaced_track_id",
                    F.col("replaced_track_id").isNull().alias("is_first"))


def first_participant_link(events: DataFrame) -> DataFrame:
    """Per room: the requested participant (room + 10 in even rooms) if present, else the
    first to join (by first event time, then id). One aggregation per room."""
    joined = tracks(events).groupBy("room", "participant").agg(F.min("t_us").alias("joined_us"))
    requested = F.when(F.col("room") % 2 == 0, F.col("room") + 10)
    g = joined.groupBy("room").agg(
        F.min_by("participant", F.struct("joined_us", "participant")).alias("first_participant"),
        F.max(F.when(F.col("participant") == requested, F.col("participant"))).alias("requested_present"))
    return g.select("room", F.coalesce("requested_present", "first_participant").alias("participant"),
                    F.when(F.col("requested_present").isNotNull(), "requested").otherwise("first").alias("reason"))
