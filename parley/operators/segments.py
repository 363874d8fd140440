"""Speech segments from START/END events, and user/agent overlap (barge-in).

All operators are ordered scans per (session, party) through ``scan.scan``; none
needs a whole session in one task and none uses a theta join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.scan import prev, run_last, scan
from parley.params import Params

USER_START, USER_END = "user_started_speaking", "user_stopped_speaking"
AGENT_START, AGENT_END = "agent_started_speaking", "agent_stopped_speaking"
VAD_DONE = "vad_inference_done"
SPEECH_EDGES = [USER_START, USER_END, AGENT_START, AGENT_END]


def edges(events: DataFrame, *more: str) -> DataFrame:
    """START/END rows with party (user/agent) and edge (start/end), and the columns ``more``."""
    return events.where(F.col("event_type").isin(*SPEECH_EDGES)).select(
        "session_id",
        "event_id",
        "t_us",
        F.when(F.col("event_type").startswith("user"), "user").otherwise("agent").alias("party"),
        F.when(F.col("event_type").endswith("started_speaking"), "start").otherwise("end").alias("edge"),
        *more,
    )


def speech_segments(events: DataFrame, p: Params, with_orphans: bool = False) -> DataFrame:
    """START then the next END of the same party is a segment [start, end).

    A repeated START restarts the segment (the END pairs with the latest START); an END
    whose previous edge is not a START is an orphan and forms no segment.
    """
    e = scan(
        edges(events),
        ["session_id", "party"],
        ["t_us", "event_id"],
        {"p_edge": prev(F.col("edge")), "p_t": prev(F.col("t_us")), "p_id": prev(F.col("event_id"))},
        p.bucket_us,
    ).where(F.col("edge") == "end")
    is_seg = F.col("p_edge") == "start"
    out = e.select(
        "session_id",
        "party",
        F.when(is_seg, F.col("p_id")).alias("start_event_id"),
        F.col("event_id").alias("end_event_id"),
        F.when(is_seg, F.col("p_t")).alias("start_us"),
        F.col("t_us").alias("end_us"),
        F.when(is_seg, F.lit("segment")).otherwise(F.lit("orphan")).alias("status"),
    )
    if not with_orphans:
        out = out.where(F.col("status") == "segment").drop("status")
    return out


def barge_in_overlap(segments: DataFrame, p: Params) -> DataFrame:
    """Pairs of overlapping user and agent segments with their overlap [max start, min end).

    Segments of one party are disjoint, so every overlapping pair is found by an as-of
    look-up: (1) the user segment open at an agent start (u.start <= a.start < u.end),
    (2) the agent segment open at a user start (a.start < u.start < a.end). With user
    rows ordered before agent rows at equal start times, both are last-non-null specs
    of one scan over the merged starts; no range join.
    """
    seg = segments.select(
        "session_id", "party", "start_event_id", "start_us",
        F.when(F.col("party") == "user", F.lit(0)).otherwise(F.lit(1)).alias("prio"),
        F.struct(F.col("start_event_id").alias("id"), F.col("start_us").alias("st"),
                 F.col("end_us").alias("en")).alias("me"),
    )
    s = scan(seg, ["session_id"], ["start_us", "prio", "start_event_id"], {
        "open_user": run_last(F.when(F.col("party") == "user", F.col("me"))),
        "open_agent": run_last(F.when(F.col("party") == "agent", F.col("me"))),
    }, p.bucket_us)
    is_agent = F.col("party") == "agent"
    other = F.when(is_agent, F.col("open_user")).otherwise(F.col("open_agent"))
    hit = s.withColumn("_o", other).where(F.col("_o.en") > F.col("me.st"))
    u = F.when(is_agent, F.col("_o")).otherwise(F.col("me"))
    a = F.when(is_agent, F.col("me")).otherwise(F.col("_o"))
    pairs = hit.select(
        "session_id",
        u["id"].alias("user_start_event_id"),
        a["id"].alias("agent_start_event_id"),
        F.greatest(u["st"], a["st"]).alias("overlap_start_us"),
        F.least(u["en"], a["en"]).alias("overlap_end_us"),
    )
    return pairs.withColumn("overlap_us", F.col("overlap_end_us") - F.col("overlap_start_us"))


def barge_in_summary(events: DataFrame, p: Params) -> DataFrame:
    """Flagship: per session, number of barge-ins and total overlap (us and reference seconds)."""
    pairs = barge_in_overlap(speech_segments(events, p), p)
    return pairs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_barge_in"),
        F.sum("overlap_us").cast("bigint").alias("barge_in_us"),
    ).withColumn("barge_in_s", F.col("barge_in_us") / F.lit(float(p.unit_us)))
