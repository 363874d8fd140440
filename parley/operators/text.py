"""Text operators over chat messages (CH), response chunks (CK) and transcripts (DX).

Per-message functions are built-in expressions; per-stream aggregates collect one
reply (bounded by the model's output length) and never a whole session.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import audio as fa
from parley.functions.text import SENTENCE_RE, WORD_RE, ends_with_punct, word_count
from parley.operators.scan import run_sum, scan
from parley.params import Params

ROLES = ("user", "assistant", "system")

# Fixed value: the system prompt every new conversation starts with.
SYSTEM_PROMPT = (
    "You are a voice assistant. Your interface with users will be voice. You should tailor your response "
    "style to speech using spelled out numbers and avoiding all formatting except for periods, commas, "
    "exclamation marks, and question marks."
)
# Supported languages of the test turn detector.
SUPPORTED_LANGUAGES = ("en", "de")


# --- messages ------------------------------------------------------------------
def message_status(text: Column, audio: Column, role: Column) -> Column:
    """Reason a message is rejected, or 'ok'. Both set is the reference's assertion;
    both null is also rejected here (it would break the request builder)."""
    return (F.when(text.isNotNull() & audio.isNotNull(), "both")
            .when(text.isNull() & audio.isNull(), "empty")
            .when(~role.isin(*ROLES), "bad_role")
            .otherwise("ok"))


def validate_message(chat: DataFrame) -> DataFrame:
    return chat.select("session_id", "turn", message_status(F.col("text"), F.col("audio"), F.col("role")).alias("status"))


def nonempty_reply(chat: DataFrame) -> DataFrame:
    """Final assistant responses that are non-empty (null dropped too)."""
    return chat.where((F.col("role") == "assistant") & (F.length("text") > 0)).select("session_id", "turn", "text")


def nonempty_chat(chat: DataFrame) -> DataFrame:
    """Typed user chat becomes a say request only when non-empty."""
    return chat.where((F.col("role") == "user") & (F.length("text") > 0)).select("session_id", "turn", "text")


def nonempty_history(chat: DataFrame, p: Params) -> DataFrame:
    """At each user message the model gets the history before it; an empty one is an error row."""
    s = scan(chat.select("session_id", "turn", "role"), ["session_id"], ["turn"],
             {"n_incl": run_sum(F.lit(1).cast("bigint"))}, p.turn_bucket)
    s = s.where(F.col("role") == "user").withColumn("n_history", (F.col("n_incl") - 1).cast("bigint"))
    return s.select("session_id", "turn", "n_history",
                    F.when(F.col("n_history") > 0, "ok").otherwise("empty_history").alias("status"))


def single_turn(chat: DataFrame) -> DataFrame:
    """Keep only the first message of each conversation (aggregate, skew-safe)."""
    g = chat.groupBy("session_id").agg(F.min_by(F.struct("turn", "role", "text"), F.col("turn")).alias("m"))
    return g.select("session_id", "m.turn", "m.role", "m.text")


def chat_context_snapshot(chat: DataFrame, p: Params) -> DataFrame:
    """Context visible at each turn, cut by the caller to the last ``context_last_n`` messages.

    The whole history of every turn is quadratic, so it has no such table: ``context_sizes`` measures
    it, and ``hooks.reply_in_order`` hands it to a model message by message. Skew-safe and exact: messages get a dense rank per session (bucketed scan); ranks
    are cut into blocks of ``n`` and every message is also copied into the next block as
    look-back, so each window (partitioned by session and block) sees the n - 1 messages
    before any of its own rows.
    """
    n = p.context_last_n
    if n is None:
        raise ValueError("a table of contexts needs context_last_n")
    r = scan(chat.select("session_id", "turn", "role", "text"), ["session_id"], ["turn"],
             {"_rank": run_sum(F.lit(1).cast("bigint"))}, p.turn_bucket)
    r = r.withColumn("_blk", F.expr(f"(_rank - 1) div {n}"))
    halo = r.select("*", F.explode(F.array(F.struct(F.col("_blk").alias("b"), F.lit(True).alias("own")),
                                           F.struct((F.col("_blk") + 1).alias("b"), F.lit(False).alias("own")))).alias("_h"))
    w = Window.partitionBy("session_id", "_h.b").orderBy("_rank").rowsBetween(-(n - 1), 0)
    out = halo.select("session_id", "turn", F.col("_h.own").alias("_own"),
                      F.collect_list(F.struct("turn", "role", "text")).over(w).alias("context"))
    return out.where("_own").drop("_own")


def context_sizes(chat: DataFrame, p: Params) -> DataFrame:
    """Size of the whole context visible at each turn: messages and characters up to this one
    (null text counts as a message without characters). Two running sums, nothing is collected."""
    r = scan(chat.select("session_id", "turn", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("_chars")), ["session_id"], ["turn"],
             {"n_messages": run_sum(F.lit(1).cast("bigint")), "context_chars": run_sum(F.col("_chars"))}, p.turn_bucket)
    return r.select("session_id", "turn", F.col("n_messages").cast("int").alias("n_messages"), "context_chars")


def system_prompt_union(chat: DataFrame) -> DataFrame:
    """Every conversation starts with a system message: add one at turn -1 where missing."""
    has = chat.where(F.col("role") == "system").select("session_id").distinct()
    sessions = chat.select("session_id").distinct().join(has, "session_id", "left_anti")
    added = sessions.select("session_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"),
                            F.lit(SYSTEM_PROMPT).alias("text"))
    return chat.select("session_id", "turn", "role", "text").unionByName(added)


def ends_with_punct_q(chat: DataFrame) -> DataFrame:
    return chat.select("session_id", "turn", ends_with_punct(F.col("text")).alias("ends_with_punct"))


def word_count_q(chat: DataFrame) -> DataFrame:
    return chat.select("session_id", "turn", word_count(F.col("text")).alias("n_words"))


def response_event(text: Column, kind: str = "final_response") -> Column:
    """{type, alternatives: [{text, language: 'en'}]}."""
    return F.struct(F.lit(kind).alias("type"),
                    F.array(F.struct(text.alias("text"), F.lit("en").alias("language"))).alias("alternatives"))


def response_event_struct(chat: DataFrame) -> DataFrame:
    ev = chat.where(F.col("role") == "assistant").select("session_id", "turn", response_event(F.col("text")).alias("ev"))
    return ev.select("session_id", "turn", F.col("ev.type").alias("event_type"),
                     F.col("ev.alternatives")[0]["text"].alias("text"), F.col("ev.alternatives")[0]["language"].alias("language"))


def chat_request_json(chat: DataFrame) -> DataFrame:
    """Request body over a conversation's whole history: [{role, content: [{type, text}]}]
    (text preferred; audio -> [{type, audio_url}], a WAV data URL; silence stays silence). Quarantined
    (both null or both set) messages are left out."""
    ok = chat.where(message_status(F.col("text"), F.col("audio"), F.col("role")) == "ok")
    url = fa.data_url(fa.wav_bytes(fa.pcm16(F.coalesce(fa.normalize(F.col("audio")), F.col("audio")))))
    # to_json leaves null fields out, so a part has its own field only
    content = F.array(F.struct(F.when(F.col("text").isNotNull(), "text").otherwise("audio").alias("type"),
                               F.col("text"), F.when(F.col("text").isNull(), url).alias("audio_url")))
    msg = F.struct(F.col("turn"), F.struct(F.col("role").alias("role"), content.alias("content")).alias("m"))
    g = ok.groupBy("session_id").agg(F.sort_array(F.collect_list(msg)).alias("ms"))
    return g.select("session_id", F.size("ms").cast("bigint").alias("n_messages"),
                    F.to_json(F.transform("ms", lambda x: x["m"])).alias("request_json"))


# --- chunks --------------------------------------------------------------------
def cumulative_response(chunks: DataFrame) -> DataFrame:
    """Each chunk re-emits the whole text so far (per reply stream)."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.select("stream_id", "seq", "t_us", F.array_join(F.collect_list("delta").over(w), "").alias("text"))


def response_delta(cumulative: DataFrame) -> DataFrame:
    """delta = current[len(previous):], previous of the first = '' (by length only)."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    prev_len = F.length(F.lag("text", 1, "").over(w))
    return cumulative.select("stream_id", "seq", "text", prev_len.alias("_pl")) \
        .select("stream_id", "seq", F.expr("substring(text, _pl + 1)").alias("delta"))


def stream_concat(chunks: DataFrame) -> DataFrame:
    """Total text of a stream = its deltas in order."""
    g = chunks.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("parts"))
    return g.select("stream_id", F.size("parts").cast("bigint").alias("n_chunks"),
                    F.array_join(F.transform("parts", lambda x: x["delta"]), "").alias("text"))


def reply_streams(chat: DataFrame) -> DataFrame:
    """All assistant replies as stream ids (including ones with no chunks)."""
    return chat.where(F.col("role") == "assistant").select(
        F.concat_ws("-", F.col("session_id").cast("string"), F.col("turn").cast("string")).alias("stream_id"))


def stream_last(chat: DataFrame, chunks: DataFrame) -> DataFrame:
    """Last element of each stream; an empty stream gives ''."""
    last = chunks.groupBy("stream_id").agg(F.max_by("delta", "seq").alias("_last"))
    return reply_streams(chat).join(last, "stream_id", "left").select(
        "stream_id", F.coalesce(F.col("_last"), F.lit("")).alias("last_delta"))


def source_routing(chat: DataFrame, chunks: DataFrame) -> DataFrame:
    """A one-chunk reply is synthesized as a complete string, longer ones as a stream."""
    n = chunks.groupBy("stream_id").agg(F.count(F.lit(1)).alias("_n"))
    s = reply_streams(chat).join(n, "stream_id", "left").select(
        "stream_id", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("n_chunks"))
    return s.withColumn("source", F.when(F.col("n_chunks") == 1, "string").otherwise("stream"))


def stream_interrupts(chunks: DataFrame) -> DataFrame:
    """Test derivation: a stream is interrupted when (conv_id + turn) % 3 = 0, at 3/5 of its
    last chunk time."""
    g = chunks.groupBy("stream_id").agg(F.max("t_us").alias("_max_t"), F.count(F.lit(1)).alias("n_chunks"))
    parts = F.split(F.col("stream_id"), "-")
    hit = (parts[0].cast("bigint") + parts[1].cast("bigint")) % 3 == 0
    return g.select("stream_id", "n_chunks", F.when(hit, F.expr("(_max_t * 3) div 5")).alias("interrupt_us"))


def played_text_asof(chunks: DataFrame) -> DataFrame:
    """Text pushed before the interrupt is what was played; later chunks are discarded. A reply of
    one chunk is a complete string (``source_routing``): it counts as played whole, interrupted or not."""
    it = stream_interrupts(chunks)
    played = F.col("interrupt_us").isNull() | (F.col("t_us") < F.col("interrupt_us")) | (F.col("n_chunks") == 1)
    c = chunks.join(it, "stream_id").where(played)
    g = c.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("parts"))
    return it.join(g, "stream_id", "left").select(
        "stream_id", F.col("interrupt_us").isNotNull().alias("interrupted"),
        F.coalesce(F.array_join(F.transform("parts", lambda x: x["delta"]), ""), F.lit("")).alias("played_text"))


def _throttle_group(pdf: pd.DataFrame, interval: int) -> pd.DataFrame:
    """Greedy throttle of one reply stream: emit the first element, then each element at
    least ``interval`` after the last emitted one; at the end always emit the final
    element (again, if it was just emitted). Each emission carries the text added since
    the previous emission (the delta of the throttled cumulative stream)."""
    pdf = pdf.sort_values("seq", kind="stable")
    sid = pdf["stream_id"].iloc[0]
    t = pdf["t_us"].to_numpy(np.int64)
    seq = pdf["seq"].to_numpy(np.int32)
    d = pdf["delta"].tolist()
    rows, buf, last = [], [], None
    for i in range(len(t)):  # sequential by definition: one O(n) pass per stream
        buf.append(d[i])
        if last is None or t[i] - last >= interval:
            last = t[i]
            rows.append((sid, len(rows) + 1, int(seq[i]), int(t[i]), False, "".join(buf)))
            buf = []
    rows.append((sid, len(rows) + 1, int(seq[-1]), int(t[-1]), True, "".join(buf)))
    return pd.DataFrame(rows, columns=["stream_id", "emit_idx", "seq", "t_us", "is_tail", "delta"])


THROTTLE_SCHEMA = "stream_id string, emit_idx int, seq int, t_us bigint, is_tail boolean, delta string"


def throttle_stream(chunks: DataFrame, p: Params, interval_us: int | None = None) -> DataFrame:
    """Model stream -> greedy throttle -> deltas, per reply stream. The greedy rule is
    sequential (a lag test is wrong), so each stream is one Arrow batch in applyInPandas;
    a stream is one reply, bounded by the model's output length."""
    interval = p.us(p.throttle_interval) if interval_us is None else interval_us
    return chunks.select("stream_id", "seq", "t_us", "delta").groupBy("stream_id").applyInPandas(
        lambda pdf: _throttle_group(pdf, interval), schema=THROTTLE_SCHEMA)


# --- transcripts -----------------------------------------------------------------
def sentence_split(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(SENTENCE_RE), 0)).alias("idx", "sentence")) \
        .withColumn("idx", F.col("idx").cast("int"))


def word_tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(WORD_RE), 0)).alias("idx", "word")) \
        .withColumn("idx", F.col("idx").cast("int"))


def transcript_pacing(chat: DataFrame, p: Params) -> DataFrame:
    """Words of a reply are released in proportion to its audio: release time =
    running characters x 10 ms / speed (the test audio runs 10 ms per character)."""
    words = word_tokens(chat.where(F.col("role") == "assistant").select(
        F.struct("session_id", "turn").alias("k"), "text"), "k")
    w = Window.partitionBy("k").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    per_char = int(round(10_000 / p.transcription_speed))
    return words.select(F.col("k.session_id"), F.col("k.turn"), "idx", "word",
                        (F.sum(F.length("word")).over(w) * F.lit(per_char)).cast("bigint").alias("release_us"))


def transcription_toggle(chat: DataFrame, enabled: bool) -> DataFrame:
    """Forward transcript segments only when enabled, else empty segments."""
    segs = F.regexp_extract_all(F.col("text"), F.lit(SENTENCE_RE), 0)
    out = segs if enabled else F.array().cast("array<string>")
    return chat.where(F.col("role") == "assistant").select("session_id", "turn", F.size(out).alias("n_segments"))


def language_semi(docs: DataFrame, spark) -> DataFrame:
    """Transcripts whose language the turn detector supports and that have text."""
    langs = spark.createDataFrame([(x,) for x in SUPPORTED_LANGUAGES], "lang string")
    return docs.where(F.length("text") > 0).join(F.broadcast(langs), "lang", "left_semi").select("doc_id", "lang")


def turn_probability(n_chars: Column) -> Column:
    """Test turn detector: p(end of turn) = (n_chars % 100) / 100."""
    return (n_chars % 100) / 100.0


def turn_detector_delay(docs: DataFrame, p: Params, threshold: float = 0.5, detector_s: float = 0.05) -> DataFrame:
    """Base delay (punctuation-reduced; timeout when no text); when the detector is
    eligible (supported language, text) and p < threshold the delay becomes 6 s; then
    minus detector time, floored at 0 (only when the detector ran)."""
    has_text = F.length("text") > 0
    base = (F.when(~has_text | F.col("text").isNull(), F.lit(p.us(p.final_transcript_timeout)))
            .when(ends_with_punct(F.col("text")), F.lit(p.us(p.min_endpointing_delay * p.punctuation_reduce_factor)))
            .otherwise(F.lit(p.us(p.min_endpointing_delay))))
    eligible = F.coalesce(has_text, F.lit(False)) & F.col("lang").isin(*SUPPORTED_LANGUAGES)
    prob = turn_probability(F.col("n_chars"))
    ran = F.when(prob < threshold, F.lit(p.us(p.unlikely_endpoint_delay))).otherwise(base)
    delay = F.when(eligible, F.greatest(F.lit(0), ran - F.lit(p.us(detector_s)))).otherwise(base)
    return docs.select("doc_id", "lang", eligible.alias("eligible"), prob.alias("p_end_of_turn"), delay.cast("bigint").alias("delay_us"))
