"""Model configuration: endpoint per model id, attached with a broadcast join.

The dimension has one row per configured model (a handful), so broadcasting it is
bounded by configuration, not by data. API keys never reach a result: only
``has_key`` is exposed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_MODELS = 5  # test derivation: session n uses model n mod 5 (model-4 is not configured)


def session_models(chat: DataFrame) -> DataFrame:
    return chat.select("session_id").distinct().select(
        "session_id", F.concat(F.lit("model-"), (F.col("session_id") % N_MODELS).cast("string")).alias("model_id"))


def model_config_join(sessions: DataFrame, config: DataFrame) -> DataFrame:
    """Attach the endpoint; unknown model ids get status 'unknown_model' (the reference raises)."""
    dim = config.select("model_id", "base_url", F.col("api_key").isNotNull().alias("has_key"))
    return sessions.join(F.broadcast(dim), "model_id", "left").select(
        "session_id", "model_id", "base_url", F.coalesce(F.col("has_key"), F.lit(False)).alias("has_key"),
        F.when(F.col("base_url").isNull(), "unknown_model").otherwise("ok").alias("status"))


def unknown_models(sessions: DataFrame, config: DataFrame) -> DataFrame:
    """Error side output: sessions whose model has no configuration."""
    return sessions.join(F.broadcast(config.select("model_id")), "model_id", "left_anti")


def models_in_use(sessions: DataFrame, config: DataFrame) -> DataFrame:
    """Resolved configuration of every model the data uses (inner: configured ones)."""
    used = sessions.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_sessions"))
    dim = config.select("model_id", "base_url", F.col("api_key").isNotNull().alias("has_key"))
    return used.join(F.broadcast(dim), "model_id")
