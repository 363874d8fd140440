"""Audio-vector queries (AV adapter)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.functions.audio import wav_pcm
from parley.operators import audio as au
from parley.plans.oracle_base import sql
from parley.plans.registry import query
from parley.session import state_path
from parley.sources import audio_vectors

PEAK = "list_max(list_transform(samples, lambda x: abs(CAST(x AS DOUBLE))))"
NORM = f"CASE WHEN {PEAK} <> 0 THEN list_transform(samples, lambda x: CAST(CAST(x AS DOUBLE) / {PEAK} AS FLOAT)) END"
PCM = f"list_transform({NORM}, lambda x: CAST(round(CAST(x AS DOUBLE) * 32767.0) AS INTEGER))"
FP = f"md5(array_to_string(list_transform({PCM}, lambda v: CAST(v AS VARCHAR)), ','))"


def _le32(n: str) -> str:
    """Hex of a number's 4 bytes, lowest first."""
    h = f"lpad(hex({n}), 8, '0')"
    return " || ".join(f"substring({h}, {at}, 2)" for at in (7, 5, 3, 1))


N_BYTES = "2 * len(arg_min(pcm16, vec_id))"
ASSETS = f"""
fps AS (SELECT vec_id, session_id, {PCM} AS pcm16, {FP} AS fp FROM audio_vectors),
assets AS (
  SELECT fp, min(vec_id) AS vec_id, 'tmp_' || fp || '.wav' AS path, substring(fp, 1, 2) AS prefix,
         unhex('52494646' || {_le32('36 + ' + N_BYTES)} || '57415645666D74201000000001000100803E0000007D00000200100064617461' ||
               {_le32(N_BYTES)} || array_to_string(list_transform(arg_min(pcm16, vec_id), lambda v:
               substring(lpad(hex(((v % 65536) + 65536) % 65536), 4, '0'), 3, 2) ||
               substring(lpad(hex(((v % 65536) + 65536) % 65536), 4, '0'), 1, 2)), '')) AS wav
  FROM fps WHERE fp IS NOT NULL GROUP BY fp)
"""


def _new_store(spark) -> str:
    return state_path(spark, f"assets-{uuid.uuid4().hex}")


@query("audio_peak", sql(f"SELECT vec_id, session_id, {PEAK} AS peak FROM audio_vectors"))
def q_audio_peak(spark, d):
    return au.audio_peak(audio_vectors(spark, d))


@query("peak_normalize", sql(f"SELECT vec_id, ({NORM}) IS NULL AS silent, {NORM} AS normalized FROM audio_vectors"))
def q_peak_normalize(spark, d):
    return au.peak_normalize(audio_vectors(spark, d))


@query("pcm16_quantize", sql(f"SELECT vec_id, {PCM} AS pcm16 FROM audio_vectors"))
def q_pcm16_quantize(spark, d):
    return au.pcm16_quantize(audio_vectors(spark, d))


@query("audio_fingerprint", sql(f"SELECT vec_id, {FP} AS fp FROM audio_vectors"))
def q_audio_fingerprint(spark, d):
    return au.audio_fingerprint(audio_vectors(spark, d))


@query("asset_sink", sql("SELECT fp, vec_id, path, prefix, md5(wav) AS wav_md5 FROM assets", ASSETS))
def q_asset_sink(spark, d):
    """Audio files written to a new store below the checkpoint folder, as the folder holds them afterwards."""
    store = au.AssetStore(spark, _new_store(spark))
    store.add(audio_vectors(spark, d))
    return au.asset_source(store).select("fp", "vec_id", "path", "prefix", F.md5("wav").alias("wav_md5"))


@query("asset_cache_anti", sql("""
SELECT a.fp, a.vec_id FROM assets a WHERE a.fp NOT IN (SELECT fp FROM fps WHERE vec_id % 2 = 0 AND fp IS NOT NULL)
""", ASSETS))
def q_asset_cache_anti(spark, d):
    """Only assets not yet stored; the store here holds the even vec_ids' assets."""
    f = au.fingerprints(audio_vectors(spark, d))
    stored = f.where((F.col("vec_id") % 2 == 0) & F.col("fp").isNotNull()).select("fp")
    return au.assets_to_write(audio_vectors(spark, d), stored).select("fp", "vec_id")


@query("audio_data_url", sql("""
SELECT fp, vec_id, 'data:audio/wav;base64,' || to_base64(wav) AS audio_url FROM assets
""", ASSETS))
def q_audio_data_url(spark, d):
    return au.audio_data_url(au.asset_rows(audio_vectors(spark, d)))


@query("asset_source", sql("""
SELECT fp, path, octet_length(wav) AS n_bytes, md5(wav) AS wav_md5 FROM assets
""", ASSETS))
def q_asset_source(spark, d):
    """Files written to a fresh store below the checkpoint folder in two overlapping batches, read back."""
    store = au.AssetStore(spark, _new_store(spark))
    v = audio_vectors(spark, d)
    store.add(v.where(F.col("vec_id") % 3 == 0))
    store.add(v)
    return au.asset_source(store).select("fp", "path", F.length("wav").alias("n_bytes"), F.md5("wav").alias("wav_md5"))


@query("asset_pcm", sql("SELECT a.fp, p.pcm16 FROM assets a JOIN (SELECT vec_id, " + PCM + " AS pcm16 FROM audio_vectors) p USING (vec_id)", ASSETS))
def q_asset_pcm(spark, d):
    """Samples decoded from the stored files."""
    store = au.AssetStore(spark, _new_store(spark))
    store.add(audio_vectors(spark, d))
    return store.files().select("fp", wav_pcm(F.col("wav")).alias("pcm16"))


@query("utterance_concat", sql("""
SELECT session_id, vec_id // 16 AS utterance_id, CAST(count(*) AS INTEGER) AS n_frames,
       flatten(list(samples ORDER BY vec_id)) AS audio
FROM audio_vectors GROUP BY session_id, vec_id // 16
"""))
def q_utterance_concat(spark, d):
    return au.utterance_concat(audio_vectors(spark, d))
