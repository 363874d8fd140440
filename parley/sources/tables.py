"""Canonical tables (FIXTURES.md) derived from the driver's parquet tables.

Every adapter selects only the columns it needs, so Catalyst prunes the parquet
scan (``ReadSchema``) and pushes filters below the projection.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Source event type -> agent event type (FIXTURES.md, EV adapter).
# view -> user_started_speaking, click -> user_stopped_speaking,
# signup -> agent_started_speaking, purchase -> agent_stopped_speaking,
# error -> vad_inference_done
EV_TYPE_MAP = {
    "view": "user_started_speaking",
    "click": "user_stopped_speaking",
    "signup": "agent_started_speaking",
    "purchase": "agent_stopped_speaking",
    "error": "vad_inference_done",
}

# Token pattern for splitting text on whitespace; same character class in DuckDB.
WORD_RE = r"[^ \t\n\r\f]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def t_us(col: str | Column) -> Column:
    """timestamp_ntz -> microseconds since epoch, independent of the session time zone
    (built from the wall-clock fields; a diff would cast through the session zone)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.unix_date(F.to_date(c)).cast("bigint") * F.lit(86_400_000_000)
            + F.hour(c).cast("bigint") * F.lit(3_600_000_000)
            + F.minute(c).cast("bigint") * F.lit(60_000_000)
            + (F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint"))


def _map_type(col: str) -> Column:
    pairs = [F.lit(x) for kv in EV_TYPE_MAP.items() for x in kv]
    return F.create_map(*pairs)[F.col(col)]


def agent_events(spark: SparkSession, sf_dir: str, types: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """EV: session_id, event_id, t_us, event_type, value, probability, speech_duration.

    ``types`` keeps only those agent event types; the filter is stated on the source
    column, so it reaches the parquet scan (``PushedFilters``).
    """
    ev = read(spark, sf_dir, "events")
    if types is not None:
        inverse = {v: k for k, v in EV_TYPE_MAP.items()}
        ev = ev.where(F.col("event_type").isin(*[inverse[t] for t in types]))
    return ev.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id"),
        t_us("ts").alias("t_us"),
        _map_type("event_type").alias("event_type"),
        F.col("value"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("probability"),
        (F.col("value") / 100.0).alias("speech_duration"),
    )


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH: session_id, turn, role, text, audio (null array<float>)."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn"),
        F.col("role"),
        F.col("text"),
        F.lit(None).cast("array<float>").alias("audio"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CK: assistant replies as ordered word deltas.

    stream_id = conv_id-turn, seq = 1-based word position, delta = word with a
    leading space from the second word on, t_us = running sum of 10,000 x length(word).
    A reply is one stream, so the window is bounded by the reply length.
    """
    c = read(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    words = c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream_id"),
        F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(WORD_RE), 0)).alias("pos", "word"),
    )
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        words.select(
            "stream_id",
            (F.col("pos") + 1).cast("int").alias("seq"),
            F.when(F.col("pos") == 0, F.col("word")).otherwise(F.concat(F.lit(" "), F.col("word"))).alias("delta"),
            (F.length("word") * 10000).cast("bigint").alias("_dt"),
        )
        .withColumn("t_us", F.sum("_dt").over(w).cast("bigint"))
        .select("stream_id", "seq", "t_us", "delta")
    )


# Order priority -> speech kind (FIXTURES.md, SP adapter); others are 'speech'.
KIND_PRIORITIES = {"reply": ("1-URGENT", "2-HIGH"), "tool": ("5-LOW",)}


def speeches(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    """SP: speech_id, session_id, t_us, kind, allow_interruptions, add_to_chat_ctx (+ text).

    ``kinds`` ('reply' / 'tool') keeps only those kinds with a filter on the source
    column, so it reaches the parquet scan.
    """
    o = read(spark, sf_dir, "orders")
    if kinds is not None:
        if "speech" in kinds:
            raise ValueError("kind 'speech' is the complement; filter after the adapter")
        o = o.where(F.col("o_orderpriority").isin(*[x for k in kinds for x in KIND_PRIORITIES[k]]))
    return o.select(
        F.col("o_orderkey").alias("speech_id"),
        F.col("o_custkey").alias("session_id"),
        t_us("o_orderdate").alias("t_us"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "reply")
        .when(F.col("o_orderpriority") == "5-LOW", "tool")
        .otherwise("speech")
        .alias("kind"),
        (F.col("o_orderstatus") != "F").alias("allow_interruptions"),
        (F.col("o_orderstatus") != "P").alias("add_to_chat_ctx"),
        F.col("o_orderpriority").alias("text"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR: speech_id, frame_idx, samples_per_channel, sample_rate (+ flag, status).

    frame_idx needs tie-breakers because (l_orderkey, l_linenumber) is not unique. It is
    a running count (bucketed scan), so even a speech with a huge number of frames is
    numbered by many tasks.
    """
    from parley.operators.scan import run_sum, scan

    li = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("speech_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_shipdate", F.round(F.col("l_quantity")).cast("bigint").alias("samples_per_channel"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    # Buckets follow the sort order lexicographically: (line number, block of part keys),
    # so the lines of even a huge order spread over many buckets.
    bucket = F.col("l_linenumber").cast("bigint") * F.lit(1 << 32) + F.expr(f"l_partkey div {FRAME_BUCKET}")
    s = scan(li, ["speech_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"],
             {"frame_idx": run_sum(F.lit(1))}, FRAME_BUCKET, bucket=bucket)
    return s.select("speech_id", F.col("frame_idx").cast("int"), "samples_per_channel",
                    F.lit(16000).cast("int").alias("sample_rate"), "flag", "status")


FRAME_BUCKET = 1024  # part keys per scan bucket (within a line number)


def audio_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AV: vec_id, session_id (= label), samples array<float>(64)."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id"),
        F.col("label").cast("int").alias("session_id"),
        F.col("embedding").alias("samples"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX: doc_id, text, lang, n_chars."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "lang", "n_chars")


# The model configuration literal rows (FIXTURES.md model_config).
DEFAULT_MODELS = [
    ("model-0", "http://model-0.invalid/v1", "empty"),
    ("model-1", "http://model-1.invalid/v1", "empty"),
    ("model-2", "http://model-2.invalid/v1", "empty"),
    ("model-3", "http://model-3.invalid/v1", None),
]


def model_config(spark: SparkSession, override_json: str | None = None) -> DataFrame:
    """model_id, base_url, api_key. A JSON override *replaces* the defaults (not merged)."""
    if override_json:
        parsed = json.loads(override_json)
        rows = [(k, v.get("base_url"), v.get("api_key")) for k, v in parsed.items()]
    else:
        rows = DEFAULT_MODELS
    return spark.createDataFrame(rows, "model_id string, base_url string, api_key string")
