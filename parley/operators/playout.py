"""Playout of agent speeches: queue, truncation, frame aggregates, lifecycle, outcome.

Speech-level results are aggregations over frames (partial aggregation, skew-safe);
order-dependent results (queue, truncation, running sums) use the bucketed scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.scan import next_, prev, run_max, run_sum, scan
from parley.params import DAY_US, Params

# Frame positions are bucketed for the per-speech scans.
FRAME_BUCKET = 1024


def frame_stats(frames: DataFrame) -> DataFrame:
    """Per speech: frame count, pushed samples, lifecycle flags and interrupt position.

    Test derivations (FIXTURES.md): initialized = any flag 'A'; user_committed = any 'N';
    speech_committed = any 'R'; interrupt position = smallest frame_idx with flag 'R' and
    status 'F' (that frame and later ones are not played).
    """
    int_pos = F.min(F.when((F.col("flag") == "R") & (F.col("status") == "F"), F.col("frame_idx")))
    return frames.groupBy("speech_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.sum("samples_per_channel").cast("bigint").alias("pushed_samples"),
        F.first("sample_rate").alias("sample_rate"),
        F.max(F.col("flag") == "A").alias("initialized"),
        F.max(F.col("flag") == "N").alias("user_committed"),
        F.max(F.col("flag") == "R").alias("speech_committed"),
        F.min(F.when(F.col("flag") == "A", F.col("frame_idx"))).alias("init_pos"),
        F.max(F.when(F.col("flag") == "R", F.col("frame_idx"))).alias("last_commit_pos"),
        int_pos.alias("interrupt_pos"),
    )


def played_frames(frames: DataFrame) -> DataFrame:
    """Frames actually played: those before the interrupt position."""
    ip = frames.groupBy("speech_id").agg(
        F.min(F.when((F.col("flag") == "R") & (F.col("status") == "F"), F.col("frame_idx"))).alias("_ip"))
    return frames.join(ip, "speech_id").where(F.col("_ip").isNull() | (F.col("frame_idx") < F.col("_ip"))).drop("_ip")


def pushed_duration(frames: DataFrame) -> DataFrame:
    """Sum of samples_per_channel / sample_rate per speech (integers summed first)."""
    g = frames.groupBy("speech_id", "sample_rate").agg(F.sum("samples_per_channel").cast("bigint").alias("pushed_samples"))
    return g.withColumn("pushed_duration", F.col("pushed_samples") / F.col("sample_rate"))


def time_played(frames: DataFrame) -> DataFrame:
    """Pushed minus still-queued; frozen at the end: frame time before the interrupt."""
    st = frame_stats(frames)
    pl = played_frames(frames).groupBy("speech_id").agg(F.sum("samples_per_channel").cast("bigint").alias("played_samples"))
    out = st.join(pl, "speech_id", "left").select(
        "speech_id", "pushed_samples", F.coalesce(F.col("played_samples"), F.lit(0)).cast("bigint").alias("played_samples"),
        "sample_rate", F.col("interrupt_pos").isNotNull().alias("interrupted"))
    return out.withColumn("time_played", F.col("played_samples") / F.col("sample_rate"))


def speech_durations(speeches: DataFrame, frames: DataFrame, played_only: bool = False) -> DataFrame:
    """Speeches with playout duration = sum(samples) units x 1 day (0 without frames).
    With ``played_only`` only frames before the interrupt count (an interrupted speech
    leaves the queue early)."""
    src = played_frames(frames) if played_only else frames
    d = src.groupBy("speech_id").agg(F.sum("samples_per_channel").cast("bigint").alias("units"))
    return speeches.join(d, "speech_id", "left").withColumn(
        "dur_us", (F.coalesce(F.col("units"), F.lit(0)) * F.lit(DAY_US)).cast("bigint"))


def playout_queue(speeches: DataFrame, frames: DataFrame, p: Params, interrupted: bool = False) -> DataFrame:
    """FIFO per session, one speech at a time: start = max(arrival, previous end).

    Lindley closed form with S = durations before the row:
    start = S + max over earlier-or-equal rows of (arrival - S). Two exact scans.
    ``interrupted=True`` uses played durations: the interrupt positions come from the
    frames (recorded), not from the schedule, so the closed form still holds.
    """
    s = speech_durations(speeches, frames, played_only=interrupted).select("speech_id", "session_id", "t_us", "dur_us")
    s = scan(s, ["session_id"], ["t_us", "speech_id"], {"c_incl": run_sum(F.col("dur_us"))}, p.bucket_us,
             keep_bucket=True)  # the second scan reuses the partitioning
    s = s.withColumn("s_excl", F.col("c_incl") - F.col("dur_us"))
    s = scan(s, ["session_id"], ["t_us", "speech_id"], {"m": run_max(F.col("t_us") - F.col("s_excl"))}, p.bucket_us)
    start = (F.col("s_excl") + F.col("m")).cast("bigint")
    return s.select("speech_id", "session_id", F.col("t_us").alias("arrival_us"), start.alias("start_us"),
                    (start + F.col("dur_us")).alias("end_us"), (start - F.col("t_us")).alias("wait_us"))


def queue_head(speeches: DataFrame) -> DataFrame:
    """Next speech to play = oldest in queue: min by (arrival, id) per session."""
    return speeches.groupBy("session_id").agg(
        F.min_by("speech_id", F.struct("t_us", "speech_id")).alias("head_speech_id"),
        F.min("t_us").alias("head_arrival_us"))


def playout_schedule(speeches: DataFrame, frames: DataFrame) -> DataFrame:
    """Recorded playouts (test derivation): start = order date + (key % 5) days,
    duration = sum(l_quantity) days; only speeches with frames are played."""
    s = speech_durations(speeches, frames).where(F.col("units").isNotNull())
    start = F.col("t_us") + (F.col("speech_id") % 5) * F.lit(DAY_US)
    return s.select("speech_id", "session_id", "t_us", start.alias("start_us"), (start + F.col("dur_us")).alias("full_end_us"))


def playout_truncate(speeches: DataFrame, frames: DataFrame, p: Params) -> DataFrame:
    """Starting a playout cancels the one still running: end = least(end, next start)."""
    s = scan(playout_schedule(speeches, frames), ["session_id"], ["start_us", "speech_id"],
             {"next_start": next_(F.col("start_us"))}, p.bucket_us)
    end = F.when(F.col("next_start").isNotNull(), F.least(F.col("full_end_us"), F.col("next_start"))).otherwise(F.col("full_end_us"))
    return s.select("speech_id", "session_id", "start_us", end.alias("end_us"),
                    (end < F.col("full_end_us")).alias("truncated"))


def playout_overlap_warning(speeches: DataFrame, frames: DataFrame, p: Params) -> DataFrame:
    """A new playout starting while audio is still queued: remaining = previous end - start."""
    s = scan(playout_schedule(speeches, frames), ["session_id"], ["start_us", "speech_id"],
             {"prev_end": prev(F.col("full_end_us")), "prev_id": prev(F.col("speech_id"))}, p.bucket_us)
    return s.where(F.col("prev_end") > F.col("start_us")).select(
        "speech_id", "session_id", F.col("prev_id").alias("prev_speech_id"), "start_us",
        (F.col("prev_end") - F.col("start_us")).alias("queued_us"))


def first_frame_latency(speeches: DataFrame, frames: DataFrame) -> DataFrame:
    """Request to first frame (playout start), for speeches that played a frame."""
    s = playout_schedule(speeches, frames)
    pf = played_frames(frames).select("speech_id").distinct()
    return s.join(pf, "speech_id", "left_semi").select(
        "speech_id", "session_id", (F.col("start_us") - F.col("t_us")).alias("first_frame_latency_us"))


def speech_lifecycle(speeches: DataFrame, frames: DataFrame) -> DataFrame:
    """Per speech: initialized, interrupted, user/speech committed, done (long -> wide)."""
    st = frame_stats(frames)
    s = speeches.select("speech_id", "session_id").join(st, "speech_id", "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    interrupted = F.col("interrupt_pos").isNotNull()
    played_any = F.coalesce(F.col("interrupt_pos"), F.lit(1 << 30)) > 1
    done = interrupted | (f("initialized") & F.col("n_frames").isNotNull() & played_any)
    return s.select("speech_id", "session_id", f("initialized").alias("initialized"), interrupted.alias("interrupted"),
                    f("user_committed").alias("user_committed"), f("speech_committed").alias("speech_committed"),
                    done.alias("done"))


def playout_outcome(speeches: DataFrame, frames: DataFrame) -> DataFrame:
    """started (>=1 frame played), stopped emitted only when started, interrupted,
    transcript segment finished only when started and not interrupted. Frame indexes are
    dense (1..n), so the frames played are interrupt position - 1, else all of them."""
    st = frame_stats(frames).select("speech_id", "n_frames", "interrupt_pos")
    s = speeches.select("speech_id", "session_id").join(st, "speech_id", "left")
    n = F.coalesce(F.col("interrupt_pos") - 1, F.col("n_frames"), F.lit(0)).cast("bigint")
    started = n >= 1
    interrupted = F.col("interrupt_pos").isNotNull()
    return s.select("speech_id", "session_id", n.alias("n_played"), started.alias("started"),
                    started.alias("stopped_emitted"), interrupted.alias("interrupted"),
                    (started & ~interrupted).alias("segment_finished"))


def speech_kind(speeches: DataFrame) -> DataFrame:
    """Constructor fields: is_reply, user_question ('' unless reply), nesting depth (0 unless tool)."""
    return speeches.select(
        "speech_id", "kind", (F.col("kind") == "reply").alias("is_reply"),
        F.when(F.col("kind") == "reply", F.col("text")).otherwise(F.lit("")).alias("user_question"),
        F.when(F.col("kind") == "tool", F.lit(1)).otherwise(F.lit(0)).alias("fnc_nested_depth"))


def speech_kind_counts(speeches: DataFrame) -> DataFrame:
    """Number of speeches per kind (reply / speech / tool)."""
    return speeches.groupBy("kind").agg(F.count(F.lit(1)).alias("n_speeches"))


def pending_supersede(speeches: DataFrame, p: Params) -> DataFrame:
    """Among pending replies of a turn (floor(t / 365 days)), the newest by (t, id) survives.

    The newest per turn is an aggregate (partial aggregation, skew-safe), joined back.
    """
    r = speeches.where(F.col("kind") == "reply").withColumn("turn", F.floor(F.col("t_us") / F.lit(365 * DAY_US)).cast("bigint"))
    newest = r.groupBy("session_id", "turn").agg(F.max(F.struct("t_us", "speech_id")).alias("_n"))
    return r.join(newest, ["session_id", "turn"]).select(
        "speech_id", "session_id", "turn",
        F.when(F.col("_n.speech_id") == F.col("speech_id"), "active").otherwise("superseded").alias("status"))


def min_played_commit(frames: DataFrame, p: Params) -> DataFrame:
    """Speeches heard long enough: played units (1 unit = 1 reference second) >= 1.5 s."""
    pl = played_frames(frames).groupBy("speech_id").agg(F.sum("samples_per_channel").cast("bigint").alias("played_units"))
    return pl.where(F.col("played_units") >= F.lit(p.min_time_played_for_commit))


def poll_quantize(speeches: DataFrame, frames: DataFrame, p: Params) -> DataFrame:
    """Completion is noticed on the poll grid from play start: ceil(d / poll) * poll."""
    poll = int(round(p.playout_poll * DAY_US))
    pl = played_frames(frames).groupBy("speech_id").agg(
        (F.sum("samples_per_channel") * F.lit(DAY_US)).cast("bigint").alias("played_us"))
    return pl.select("speech_id", "played_us",
                     (F.expr(f"(played_us + {poll - 1}) div {poll}") * F.lit(poll)).cast("bigint").alias("noticed_us"))


def interrupted_suffix(speeches: DataFrame, frames: DataFrame) -> DataFrame:
    """Committed agent text: played text + '...' when interrupted; event name by outcome;
    only for non-empty text of speeches added to the chat context (evaluated at playout end)."""
    o = playout_outcome(speeches, frames).where("started").select("speech_id", "interrupted")
    s = speeches.join(o, "speech_id").where(F.col("add_to_chat_ctx") & (F.length("text") > 0))
    return s.select(
        "speech_id", "session_id",
        F.when(F.col("interrupted"), F.concat(F.col("text"), F.lit("..."))).otherwise(F.col("text")).alias("committed_text"),
        F.when(F.col("interrupted"), "agent_speech_interrupted").otherwise("agent_speech_committed").alias("event"))


def lifecycle_rules(speeches: DataFrame, frames: DataFrame) -> DataFrame:
    """Illegal transitions as data-quality rules, one row per (speech_id, rule) violation."""
    st = frame_stats(frames)
    s = speeches.select("speech_id", "allow_interruptions").join(st, "speech_id")
    ip = F.col("interrupt_pos")
    rules = F.array(
        F.when(ip.isNotNull() & (F.col("init_pos") > ip), F.lit("initialize_after_interrupt")),
        F.when(~F.col("initialized"), F.lit("access_before_initialize")),
        F.when(ip.isNotNull() & ~F.col("allow_interruptions"), F.lit("interrupt_not_allowed")),
        F.when(ip.isNotNull() & (F.col("last_commit_pos") > ip), F.lit("play_after_interrupt")),
    )
    return s.select("speech_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def audio_buffer_cap(frames: DataFrame, cap: int) -> DataFrame:
    """Frames are appended until the first one that would exceed ``cap`` samples; it and all
    later frames of the utterance are dropped. Exact as a running sum (it never decreases)."""
    s = scan(frames.select("speech_id", "frame_idx", "samples_per_channel"), ["speech_id"], ["frame_idx"],
             {"cum_samples": run_sum(F.col("samples_per_channel"))}, FRAME_BUCKET)
    return s.where(F.col("cum_samples") <= F.lit(cap)).select(
        "speech_id", "frame_idx", "samples_per_channel", F.col("cum_samples").cast("bigint"))


def buffer_overflow_flag(frames: DataFrame, cap: int) -> DataFrame:
    """Once per utterance whose frames exceed the cap, with the first overflowing frame."""
    s = scan(frames.select("speech_id", "frame_idx", "samples_per_channel"), ["speech_id"], ["frame_idx"],
             {"cum": run_sum(F.col("samples_per_channel"))}, FRAME_BUCKET)
    return s.groupBy("speech_id").agg(
        F.max("cum").cast("bigint").alias("total_samples"),
        F.min(F.when(F.col("cum") > F.lit(cap), F.col("frame_idx"))).alias("first_overflow_idx"),
    ).where(F.col("total_samples") > F.lit(cap))


def nonempty_utterance(frames: DataFrame) -> DataFrame:
    """The model is called only for utterances with > 0 samples."""
    return frames.groupBy("speech_id").agg(F.sum("samples_per_channel").cast("bigint").alias("n_samples")) \
        .where(F.col("n_samples") > 0)


def structured_log(speeches: DataFrame, frames: DataFrame, p: Params) -> DataFrame:
    """Log records (level, msg, speech_id, JSON extra): playout finished (interrupted),
    committed agent speech (agent_response, interrupted) and the warning for a playout
    that starts while audio is still queued (queued_duration in microseconds)."""
    o = playout_outcome(speeches, frames)
    finished = o.select(F.lit("DEBUG").alias("level"), F.lit("speech playout finished").alias("msg"), "speech_id",
                        F.to_json(F.struct("speech_id", "interrupted")).alias("extra"))
    c = interrupted_suffix(speeches, frames).join(o.select("speech_id", "interrupted"), "speech_id")
    committed = c.select(F.lit("DEBUG").alias("level"), F.lit("committed agent speech").alias("msg"), "speech_id",
                         F.to_json(F.struct(F.col("committed_text").alias("agent_response"), "interrupted",
                                            "speech_id")).alias("extra"))
    w = playout_overlap_warning(speeches, frames, p)
    warn = w.select(F.lit("WARNING").alias("level"), F.lit("new playout while the source is still playing").alias("msg"),
                    "speech_id", F.to_json(F.struct("speech_id", F.col("queued_us").alias("queued_duration_us"))).alias("extra"))
    return finished.unionByName(committed).unionByName(warn)


def playout_events(speeches: DataFrame, frames: DataFrame) -> DataFrame:
    """The outcome as emitted events: playout_started and playout_stopped (with the
    interrupted flag) when a frame played, segment_playout_finished when not interrupted."""
    o = playout_outcome(speeches, frames)
    ev = F.array(
        F.when(F.col("started"), F.lit("playout_started")),
        F.when(F.col("stopped_emitted"), F.lit("playout_stopped")),
        F.when(F.col("segment_finished"), F.lit("segment_playout_finished")),
    )
    return o.select("speech_id", "session_id", "interrupted",
                    F.explode(F.filter(ev, lambda x: x.isNotNull())).alias("event"))
