"""Turn-taking over agent events: endpointing, debounce, interrupts, states, metrics.

Every operator is a composition of filters, projections and the bucketed ordered
scans of ``scan.py``; a probe at a time that is not an event time (a debounce fire,
say) is an as-of look-up via ``scan.asof``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import ends_with_punct, strip, word_count
from parley.operators.scan import asof_many, first_after, next_, run_last, run_sum, scan
from parley.operators.segments import AGENT_END, AGENT_START, USER_END, USER_START, VAD_DONE
from parley.params import Params

K = ["session_id"]
O = ["t_us", "event_id"]
TURN_BUCKET = 1024  # turns per scan bucket for message-ordered scans


# --- derived fields of the test tables (FIXTURES.md "Derivations") -------------
def raw_accumulated_speech(event_id: Column) -> Column:
    return (event_id % 3).cast("double")


def raw_accumulated_silence_us(event_id: Column, p: Params) -> Column:
    return (event_id % 5) * F.lit(p.us(1.0))


def segment_allows_interruptions(start_event_id: Column) -> Column:
    return (start_event_id % 3) != 0


def interim_text(event_id: Column) -> Column:
    return F.when(event_id % 4 == 0, F.lit("")).otherwise(F.lit("a b c"))


# --- operators -----------------------------------------------------------------
def event_type_split(events: DataFrame) -> DataFrame:
    """START / INFERENCE_DONE / END take their own branch; other types pass as 'other'."""
    return events.select(
        "session_id",
        "event_id",
        "t_us",
        F.when(F.col("event_type") == USER_START, "start_of_speech")
        .when(F.col("event_type") == VAD_DONE, "vad_inference_done")
        .when(F.col("event_type") == USER_END, "end_of_speech")
        .otherwise("other")
        .alias("branch"),
    )


def latest_probability(events: DataFrame, p: Params) -> DataFrame:
    """Speech probability in effect at each event: last INFERENCE_DONE value, initially 0.0."""
    s = scan(events, K, O, {"_p": run_last(F.when(F.col("event_type") == VAD_DONE, F.col("probability")))},
             p.bucket_us)
    return s.select("session_id", "event_id", "t_us", F.coalesce(F.col("_p"), F.lit(0.0)).alias("speech_probability"))


def last_speech_time(events: DataFrame, p: Params) -> DataFrame:
    """On inference rows: now - raw_accumulated_silence when raw_accumulated_speech > 0, else carried."""
    vad = events.where(F.col("event_type") == VAD_DONE).select("session_id", "event_id", "t_us")
    cand = F.when(raw_accumulated_speech(F.col("event_id")) > 0,
                  F.col("t_us") - raw_accumulated_silence_us(F.col("event_id"), p))
    s = scan(vad, K, O, {"last_speech_us": run_last(cand)}, p.bucket_us)
    return s.select("session_id", "event_id", "t_us", F.col("last_speech_us").cast("bigint"))


def endpoint_debounce(events: DataFrame, p: Params, delay_us: int | None = None) -> DataFrame:
    """Every user END schedules validation after ``delay``; the next START/END cancels it.

    Fires iff the next user edge is absent or strictly later than t + delay
    (an edge exactly at t + delay cancels). Default delay: the final-transcript timeout.
    """
    d = p.us(p.final_transcript_timeout) if delay_us is None else delay_us
    e = events.where(F.col("event_type").isin(USER_START, USER_END)).select("session_id", "event_id", "t_us", "event_type")
    s = scan(e, K, O, {"next_t": next_(F.col("t_us"))}, p.bucket_us).where(F.col("event_type") == USER_END)
    fired = F.col("next_t").isNull() | (F.col("next_t") > F.col("t_us") + F.lit(d))
    return s.where(fired).select(
        "session_id", F.col("event_id").alias("end_event_id"), F.col("t_us").alias("end_us"),
        (F.col("t_us") + F.lit(d)).alias("fire_us"),
    )


def _user_ends(events: DataFrame, p: Params) -> DataFrame:
    """User END rows with: k (1-based END number), next user edge time, the last user START
    and last VAD inference before it, fired (debounce) and turn_id (fires before the row).

    One scan over START/END/VAD rows gives k, the next edge and the last times; one more
    scan (same partitioning, bucket reused) counts the fires.
    """
    d = p.us(p.final_transcript_timeout)
    e = events.where(F.col("event_type").isin(USER_START, USER_END, VAD_DONE)).select(
        "session_id", "event_id", "t_us", "event_type")
    is_user = F.col("event_type").isin(USER_START, USER_END)
    s = scan(e, K, O, {
        "next_t": first_after(F.when(is_user, F.col("t_us"))),
        "k": run_sum(F.when(F.col("event_type") == USER_END, F.lit(1)).otherwise(F.lit(0)).cast("bigint")),
        "last_start": run_last(F.when(F.col("event_type") == USER_START, F.col("t_us"))),
        "last_vad": run_last(F.when(F.col("event_type") == VAD_DONE, F.col("t_us"))),
    }, p.bucket_us, keep_bucket=True).where(F.col("event_type") == USER_END)
    s = s.withColumn("fired", F.col("next_t").isNull() | (F.col("next_t") > F.col("t_us") + F.lit(d)))
    s = scan(s, K, O, {"fires_incl": run_sum(F.col("fired").cast("bigint"))}, p.bucket_us)
    return s.withColumn("turn_id", (F.col("fires_incl") - F.col("fired").cast("bigint")).cast("bigint"))


def _with_transcripts(ends: DataFrame, chat: DataFrame) -> DataFrame:
    """k-th user END of session s takes the k-th user message of conversation s mod n_conv."""
    users = chat.where(F.col("role") == "user").select("session_id", "turn", "text")
    users = scan(users, K, ["turn"], {"k": run_sum(F.lit(1).cast("bigint"))}, TURN_BUCKET)
    n_conv = chat.agg(F.countDistinct("session_id").alias("n_conv"))
    ends = ends.crossJoin(F.broadcast(n_conv))  # one-row constant: the number of conversations
    ends = ends.withColumn("conv_id", F.pmod(F.col("session_id"), F.col("n_conv")))
    u = users.select(F.col("session_id").alias("conv_id"), "k", F.col("text").alias("transcript"))
    return ends.join(u, ["conv_id", "k"], "left").drop("conv_id", "n_conv")


def _piece(transcript: Column) -> Column:
    return F.when(transcript.isNotNull(), F.concat(F.lit(" "), strip(transcript)))


def transcript_accumulate(events: DataFrame, chat: DataFrame, p: Params) -> DataFrame:
    """' ' + strip(transcript) appended per final transcript; reset when validation fires.
    The running text is re-emitted per END, so it is collected within one turn."""
    x = _with_transcripts(_user_ends(events, p).select("session_id", "event_id", "t_us", "k", "turn_id"), chat)
    from pyspark.sql import Window
    w = Window.partitionBy("session_id", "turn_id").orderBy("t_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return x.select(
        "session_id", "event_id", "t_us", "turn_id",
        F.array_join(F.collect_list(_piece(F.col("transcript"))).over(w), "").alias("accumulated"),
    )


def endpoint_delay(events: DataFrame, chat: DataFrame, p: Params) -> DataFrame:
    """Delay computed at each user END (not speaking there).

    No final transcript in the turn -> final-transcript timeout; else d = min delay
    (x 0.75 when the accumulated transcript ends in . ! ?); base = transcript time when
    start < transcript < end, else end; delay = max(0, d - (end - base)).
    Transcript time = last inference event inside the user segment (test derivation).
    The accumulated transcript's emptiness and final character come from its last
    non-empty piece: a last-non-null scan of (turn, piece), valid while the turn matches.
    """
    ends = _user_ends(events, p).select("session_id", "event_id", "t_us", "k", "turn_id", "last_start", "last_vad")
    x = _with_transcripts(ends, chat).withColumn("_piece", _piece(F.col("transcript")))
    x = scan(x, K, O, {"_lp": run_last(F.when(F.col("_piece").isNotNull(),
                                                F.struct(F.col("turn_id").alias("turn"), F.col("_piece").alias("piece"))))},
             p.bucket_us)
    last_piece = F.when(F.col("_lp.turn") == F.col("turn_id"), F.col("_lp.piece"))
    has_tr = last_piece.isNotNull()
    d = F.when(ends_with_punct(last_piece), F.lit(p.us(p.min_endpointing_delay * p.punctuation_reduce_factor))) \
        .otherwise(F.lit(p.us(p.min_endpointing_delay)))
    tt = F.col("last_vad")
    base = F.when((tt > 0) & (tt > F.coalesce(F.col("last_start"), F.lit(0))) & (tt < F.col("t_us")), tt).otherwise(F.col("t_us"))
    delay = F.when(~has_tr, F.lit(p.us(p.final_transcript_timeout))).otherwise(
        F.greatest(F.lit(0), d - (F.col("t_us") - base)))
    return x.select("session_id", "event_id", "t_us", has_tr.alias("has_transcript"), delay.cast("bigint").alias("delay_us"))


def agent_state_requests(events: DataFrame, p: Params) -> DataFrame:
    """State update requests: initializing at the first event of a session (delay 0),
    thinking at user END (reply synthesis starts, user silent; delay 0.2 s),
    speaking at agent START, listening at agent END."""
    first = events.groupBy("session_id").agg(F.min("t_us").alias("t_us")).select(
        "session_id", "t_us", F.lit(-1).cast("bigint").alias("event_id"), F.lit("initializing").alias("state"),
        F.lit(0).cast("bigint").alias("delay_us"))
    st = (F.when(F.col("event_type") == USER_END, "thinking").when(F.col("event_type") == AGENT_START, "speaking")
          .when(F.col("event_type") == AGENT_END, "listening"))
    rest = events.select("session_id", "t_us", "event_id", st.alias("state"),
                         F.when(F.col("event_type") == USER_END, F.lit(p.us(p.thinking_delay))).otherwise(F.lit(0)).cast("bigint").alias("delay_us")
                         ).where(F.col("state").isNotNull())
    return first.unionByName(rest)


def agent_state_timeline(events: DataFrame, p: Params) -> DataFrame:
    """A request takes effect at t + delay unless a newer request comes before that.

    Kept iff the next request time is null or >= effective time; the state lasts until
    the next kept state's effective time.
    """
    r = agent_state_requests(events, p).withColumn("eff_us", F.col("t_us") + F.col("delay_us"))
    r = scan(r, K, O, {"next_t": next_(F.col("t_us"))}, p.bucket_us)
    kept = r.where(F.col("next_t").isNull() | (F.col("next_t") >= F.col("eff_us"))).drop("next_t")
    kept = scan(kept, K, O, {"end_us": next_(F.col("eff_us"))}, p.bucket_us)
    return kept.select("session_id", "event_id", "state", "t_us", "eff_us", F.col("end_us").cast("bigint"))


def playing_at_events(events: DataFrame, p: Params) -> DataFrame:
    """Per event: the agent speech playing (open agent START, id = its event_id), or null."""
    edge = F.when(F.col("event_type").isin(AGENT_START, AGENT_END),
                  F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id"), F.col("t_us").alias("t")))
    s = scan(events, K, O, {"_agent": run_last(edge)}, p.bucket_us)
    return s.withColumn("playing_id", F.when(F.col("_agent.type") == AGENT_START, F.col("_agent.id"))) \
            .withColumn("playing_since", F.when(F.col("_agent.type") == AGENT_START, F.col("_agent.t"))).drop("_agent")


def interrupt_trigger(events: DataFrame, p: Params) -> DataFrame:
    """VAD rows with speech_duration >= threshold, with the speech playing at that time."""
    s = playing_at_events(events, p).where(
        (F.col("event_type") == VAD_DONE) & (F.col("speech_duration") >= F.lit(p.interrupt_speech_duration)))
    return s.select("session_id", "event_id", "t_us", "speech_duration", F.col("playing_id").alias("playing_speech_id"))


def interrupt_match(events: DataFrame, p: Params) -> DataFrame:
    """Per playing agent speech: the first interrupt attempt that hits it.

    Attempts on a speech that does not allow interruptions are no-ops; after the first
    hit the speech is interrupted and later attempts are no-ops.
    """
    t = interrupt_trigger(events, p).where(F.col("playing_speech_id").isNotNull())
    t = t.where(segment_allows_interruptions(F.col("playing_speech_id")))
    return t.groupBy("session_id", F.col("playing_speech_id").alias("speech_id")).agg(
        F.min_by("event_id", F.struct("t_us", "event_id")).alias("interrupt_event_id"),
        F.min("t_us").alias("interrupt_us"),
        F.count(F.lit(1)).alias("n_attempts"),
    )


def should_interrupt_col(playing_id: Column, allow: Column, interrupted: Column, interim: Column, p: Params) -> Column:
    """Nothing playing -> true; not allowed or already interrupted -> false;
    min_words != 0 and fewer interim words -> false; else true."""
    c = F.when(playing_id.isNull(), F.lit(True)).when(~allow | interrupted, F.lit(False))
    if p.interrupt_min_words != 0:
        c = c.when(word_count(interim) < p.interrupt_min_words, F.lit(False))
    return c.otherwise(F.lit(True))


def _left_by_speech(rows: DataFrame, speech: str, row_id: str, right: DataFrame) -> DataFrame:
    """Left join on the speech. Rows with none (nothing playing: about half of them) match nothing, so
    they are dealt by their own id (below any speech id) and not to the one partition of null."""
    key = F.coalesce(F.col(speech), -1 - F.col(row_id))
    return rows.withColumn("_speech", key).join(right.withColumnRenamed(speech, "_speech"), "_speech", "left").drop("_speech")


def should_interrupt(events: DataFrame, p: Params) -> DataFrame:
    """Decision at each VAD inference row."""
    s = playing_at_events(events, p).where(F.col("event_type") == VAD_DONE)
    im = interrupt_match(events, p).select(F.col("speech_id").alias("playing_id"), "interrupt_us")
    s = _left_by_speech(s, "playing_id", "event_id", im)
    interrupted = F.coalesce(F.col("interrupt_us") < F.col("t_us"), F.lit(False))
    return s.select("session_id", "event_id", "t_us", F.col("playing_id").alias("playing_speech_id"),
                    should_interrupt_col(F.col("playing_id"), segment_allows_interruptions(F.col("playing_id")),
                                         interrupted, interim_text(F.col("event_id")), p).alias("should_interrupt"))


def _validations(events: DataFrame, p: Params, with_metrics: bool = False) -> DataFrame:
    """Debounce fires with, as of the fire time, the playing agent speech and (for the
    EOU metrics) the last speech time and last final response: one union, one scan."""
    fires = endpoint_debounce(events, p)
    markers = {"_agent": (events.where(F.col("event_type").isin(AGENT_START, AGENT_END)).select(
        "session_id", "event_id", "t_us", "event_type"), "t_us", "event_id")}
    if with_metrics:
        cand = F.when(raw_accumulated_speech(F.col("event_id")) > 0,
                      F.col("t_us") - raw_accumulated_silence_us(F.col("event_id"), p))
        markers["_ls"] = (events.where(F.col("event_type") == VAD_DONE).select(
            "session_id", "event_id", "t_us", cand.alias("val")).where(F.col("val").isNotNull()), "t_us", "event_id")
        markers["_fr"] = (events.where(F.col("event_type") == AGENT_START).select(
            "session_id", "event_id", "t_us"), "t_us", "event_id")
    v = asof_many(fires, K, "fire_us", markers, p.bucket_us)
    return v.withColumn("playing_speech_id", F.when(F.col("_agent.event_type") == AGENT_START, F.col("_agent.event_id"))).drop("_agent")


def _decide(v: DataFrame, events: DataFrame, p: Params) -> DataFrame:
    im = interrupt_match(events, p).select(F.col("speech_id").alias("playing_speech_id"), "interrupt_us")
    v = _left_by_speech(v, "playing_speech_id", "end_event_id", im)
    playing = F.col("playing_speech_id").isNotNull()
    allow = segment_allows_interruptions(F.col("playing_speech_id"))
    interrupted = F.coalesce(F.col("interrupt_us") <= F.col("fire_us"), F.lit(False))
    text = interim_text(F.col("end_event_id"))
    should = should_interrupt_col(F.col("playing_speech_id"), allow, interrupted, text, p)
    decision = (F.when(playing & ~allow, "ignored_not_allowed")
                .when(playing & ~should, "ignored_threshold")
                .when(F.length(text) == 0, "nothing_pending")
                .otherwise("validated"))
    return v.withColumn("decision", decision)


def reply_validation(events: DataFrame, p: Params) -> DataFrame:
    """Decision at validation (debounce fire) time, in the reference's order."""
    v = _decide(_validations(events, p), events, p)
    return v.select("session_id", "end_event_id", "fire_us", "playing_speech_id", "decision")


def eou_metrics(events: DataFrame, p: Params) -> DataFrame:
    """At validated replies: end_of_utterance_delay = fire - last_speech_time;
    transcription_delay = max(last final response (or 0) - last_speech_time, 0);
    only when last_speech_time is known."""
    a = _decide(_validations(events, p, with_metrics=True), events, p)
    a = a.where((F.col("decision") == "validated") & F.col("_ls").isNotNull())
    ls = F.col("_ls.val")
    return a.select(
        "session_id", "end_event_id", "fire_us",
        (F.col("fire_us") - ls).alias("end_of_utterance_delay_us"),
        F.greatest(F.coalesce(F.col("_fr.t_us"), F.lit(0)) - ls, F.lit(0)).cast("bigint").alias("transcription_delay_us"),
    )


def target_volume(events: DataFrame, p: Params) -> DataFrame:
    """Per VAD row: interruptible agent -> max(0, 1 - p); else 1.0. Smoothing is the identity."""
    tv = F.greatest(F.lit(0.0), 1.0 - F.col("probability")) if p.allow_interruptions else F.lit(1.0)
    return events.where(F.col("event_type") == VAD_DONE).select(
        "session_id", "event_id", tv.alias("target_volume"), tv.alias("smoothed_volume"))


def metrics(events: DataFrame, p: Params) -> DataFrame:
    """Metrics table: TTS metrics enriched as-of with the open agent speech (unmatched dropped)
    unioned with VAD metrics passed through with a null sequence id."""
    pl = playing_at_events(events, p).where(F.col("event_type") == VAD_DONE)
    tts = pl.where(F.col("playing_id").isNotNull()).select(
        F.lit("tts").alias("kind"), "session_id", "event_id", "t_us", F.col("playing_id").alias("sequence_id"),
        F.col("value").alias("amount"))
    vad = events.where(F.col("event_type") == VAD_DONE).select(
        F.lit("vad").alias("kind"), "session_id", "event_id", "t_us", F.lit(None).cast("bigint").alias("sequence_id"),
        F.col("value").alias("amount"))
    return tts.unionByName(vad)


def usage_summary(metrics_df: DataFrame) -> DataFrame:
    """Fold all metrics of a session: counts and amounts per kind (amount summed as cents)."""
    cents = F.round(F.col("amount") * 100).cast("bigint")
    return metrics_df.groupBy("session_id").agg(
        F.count(F.when(F.col("kind") == "tts", 1)).alias("n_tts"),
        F.count(F.when(F.col("kind") == "vad", 1)).alias("n_vad"),
        (F.coalesce(F.sum(F.when(F.col("kind") == "tts", cents)), F.lit(0)) / 100.0).alias("tts_amount"),
        (F.coalesce(F.sum(F.when(F.col("kind") == "vad", cents)), F.lit(0)) / 100.0).alias("vad_amount"),
    )


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id", "event_type").agg(F.count(F.lit(1)).alias("n_events"))


# The agent event types published by the reference's pipeline on EV data.
EVENT_TYPES = [USER_START, USER_END, AGENT_START, AGENT_END, VAD_DONE]


def event_counts_wide(events: DataFrame) -> DataFrame:
    """Pivot form: one row per session, one count column per event type (explicit pivot
    values, so no extra job to discover them)."""
    w = events.groupBy("session_id").pivot("event_type", EVENT_TYPES).agg(F.count(F.lit(1)))
    return w.select("session_id", *[F.coalesce(F.col(t), F.lit(0)).cast("bigint").alias(t) for t in EVENT_TYPES])


def latest_interim(events: DataFrame, p: Params) -> DataFrame:
    """Interim reply at each user END (the model's lazy reply) overwrites the previous one;
    with preemptive synthesis it starts a reply at once when nothing plays or the playing
    speech is interruptible."""
    s = playing_at_events(events, p).where(F.col("event_type") == USER_END)
    start = (F.lit(p.preemptive_synthesis)
             & (F.col("playing_id").isNull() | segment_allows_interruptions(F.col("playing_id"))))
    return s.select("session_id", "event_id", "t_us", interim_text(F.col("event_id")).alias("response_text"),
                    F.col("playing_id").alias("playing_speech_id"), start.alias("starts_reply"))


def say_routing(events: DataFrame, p: Params) -> DataFrame:
    """A say request (test derivation: VAD rows) during a playing speech whose nesting is
    unfinished becomes a nested child of it; otherwise it is enqueued. Uses the recorded
    playing speech (as-of), so it is not sequential."""
    s = playing_at_events(events, p).where(F.col("event_type") == VAD_DONE)
    nested = F.col("playing_id").isNotNull()
    return s.select(
        F.col("event_id").alias("speech_id"), "session_id", "t_us",
        F.when(nested, F.col("playing_id")).alias("parent_id"),
        F.when(nested, F.lit("nested")).otherwise(F.lit("enqueue")).alias("route"),
        F.when(nested, F.lit(1)).otherwise(F.lit(0)).alias("depth"))


def nested_rollup(events: DataFrame, p: Params) -> DataFrame:
    """Children per parent speech (sorted ids), their count and depth, and whether the
    parent finished (its agent segment closed)."""
    from parley.operators.segments import speech_segments

    r = say_routing(events, p).where(F.col("route") == "nested")
    g = r.groupBy("session_id", F.col("parent_id")).agg(
        F.sort_array(F.collect_list("speech_id")).alias("children"),
        F.count(F.lit(1)).alias("n_children"), F.max("depth").alias("max_depth"))
    closed = speech_segments(events, p).where(F.col("party") == "agent").select(
        F.col("start_event_id").alias("parent_id"), F.lit(True).alias("_closed"))
    return g.join(closed, "parent_id", "left").select(
        "session_id", "parent_id", "children", "n_children", "max_depth",
        F.coalesce(F.col("_closed"), F.lit(False)).alias("finished"))


def conversation_commit(events: DataFrame, p: Params) -> DataFrame:
    """Chat context in time order: user audio turns (at user END), final agent replies
    (non-empty, at agent START) and played agent speech (at agent END; '...' appended when
    interrupted). Turn numbers come from a running count (skew-safe row_number)."""
    from parley.operators.segments import speech_segments

    user = events.where(F.col("event_type") == USER_END).select(
        "session_id", "event_id", "t_us", F.lit("user").alias("role"), F.lit("user_audio").alias("source"),
        F.lit(None).cast("string").alias("text"))
    final = events.where(F.col("event_type") == AGENT_START).select(
        "session_id", "event_id", "t_us", F.lit("assistant").alias("role"), F.lit("final_reply").alias("source"),
        interim_text(F.col("event_id")).alias("text")).where(F.length("text") > 0)
    seg = speech_segments(events, p).where(F.col("party") == "agent").select(
        F.col("end_event_id").alias("event_id"), "start_event_id")
    im = interrupt_match(events, p).select(F.col("speech_id").alias("start_event_id"), "interrupt_us")
    ends = events.where(F.col("event_type") == AGENT_END).join(seg, "event_id").join(im, "start_event_id", "left")
    txt = interim_text(F.col("start_event_id"))
    played = ends.select(
        "session_id", "event_id", "t_us", F.lit("assistant").alias("role"), F.lit("played_speech").alias("source"),
        F.when(F.col("interrupt_us").isNotNull(), F.concat(txt, F.lit("..."))).otherwise(txt).alias("text"),
    ).where(F.length(txt) > 0)
    allrows = user.unionByName(final).unionByName(played)
    s = scan(allrows, K, O, {"turn": run_sum(F.lit(1).cast("bigint"))}, p.bucket_us)
    return s.select("session_id", F.col("turn").cast("bigint"), "role", "source", "event_id", "text")
