"""Audio fingerprints and asset store; telemetry tail and retention; config join."""

import os
import random
import tempfile
import wave

import pytest
from pyspark.sql import functions as F

from parley.functions.audio import wav_pcm
from parley.operators import audio as au
from parley.operators import config as cfg
from parley.operators import telemetry as tm
from parley.sources import model_config
from parley.sources.wav import WavFiles

AV = "vec_id long, session_id int, samples array<float>"


def test_scaled_copies_share_fingerprint_and_silent_is_null(spark):
    base = [0.1, -0.5, 0.25, 0.0]
    v = spark.createDataFrame([(1, 0, base), (2, 0, [2 * x for x in base]), (3, 0, [0.0] * 4)], AV)
    fp = {r.vec_id: r.fp for r in au.audio_fingerprint(v).collect()}
    assert fp[1] == fp[2] and fp[3] is None
    n = {r.vec_id: (r.silent, r.normalized) for r in au.peak_normalize(v).collect()}
    assert n[3] == (True, None) and n[1][1][1] == -1.0


def on_disk(store):
    return sorted(os.path.relpath(os.path.join(d, f), store) for d, _, names in os.walk(f"{store}/files") for f in names if not f.endswith(".crc"))


def new_store(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="parley-assets-"), "store")
    return au.AssetStore(spark, path), path


def test_asset_store_write_once(spark):
    v = spark.createDataFrame([(1, 0, [0.1, 0.2]), (2, 0, [0.2, 0.4]), (3, 1, [0.3, -0.1]), (4, 1, [0.0, 0.0])], AV)
    store, path = new_store(spark)
    assert au.asset_source(store).count() == 0
    store.add(v)
    first = on_disk(path)
    assert len(first) == 2 and all(f.startswith("files/0/") and f.endswith(".wav") for f in first)
    for f in first:   # a real file: Python's own reader takes it
        with wave.open(os.path.join(path, f)) as w:
            assert (w.getnchannels(), w.getframerate(), w.getsampwidth(), w.getnframes()) == (1, 16000, 2, 2)
    store.add(v)                                       # a second run writes no file
    store.add(v, 0)                                    # nor does a batch that is there
    assert on_disk(path) == first and store.index.ledger.committed() == [0, 1]
    back = au.asset_source(store).collect()
    assert sorted(r.vec_id for r in back) == [1, 3]
    want = {r.fp: r.pcm16 for r in au.fingerprints(v).collect()}
    assert {r.fp: r.pcm16 for r in store.files().select("fp", wav_pcm(F.col("wav")).alias("pcm16")).collect()} == {k: x for k, x in want.items() if k}
    assert au.assets_to_write(v, store.stored()).count() == 0


def test_failed_job_leaves_no_file(spark):
    v = spark.range(200).select(F.col("id").alias("vec_id"), F.lit(0).alias("session_id"), F.array(F.lit(1.0), (F.col("id") / 999).cast("float")).cast("array<float>").alias("samples"))
    store, path = new_store(spark)
    bad = au.fresh_assets(v).select(F.concat(F.lit("x/tmp_"), "fp", F.lit(".wav")).alias("name"), F.when(F.col("vec_id") != 150, F.col("pcm16")).alias("pcm16"))
    spark.dataSource.register(WavFiles)
    with pytest.raises(Exception):
        bad.write.format("parley_wav").option("path", f"{path}/files/0").mode("append").save()
    assert on_disk(path) == [] and au.asset_source(store).count() == 0
    # files are written, but the batch never got its entry: nobody sees it, and the retry replaces it
    write, store.index.write = store.index.write, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.add(v.limit(50), 0)
    assert len(on_disk(path)) == 50 and au.asset_source(store).count() == 0
    store.index.write = write
    store.add(v, 0)
    assert len(on_disk(path)) == 200 and au.asset_source(store).count() == 200


def test_batch_of_another_session(spark):
    """A micro-batch's rows are of a session of their own, which doesn't know what was registered in the store's."""
    other = spark.newSession()
    store, path = new_store(spark)
    store.add(other.createDataFrame([(1, 0, [0.1, 0.2]), (2, 1, [0.3, -0.1])], AV), 0)
    assert len(on_disk(path)) == 2 and sorted(r.vec_id for r in au.asset_source(store).collect()) == [1, 2]


def test_twenty_batches_and_pruned_look_up(spark):
    v = spark.range(60).select(F.col("id").alias("vec_id"), F.lit(0).alias("session_id"), F.array(F.lit(1.0), (F.col("id") % 40 / 99).cast("float")).cast("array<float>").alias("samples"))
    store, _ = new_store(spark)
    for k in range(20):
        store.add(v.where(F.col("vec_id").between(3 * k, 3 * k + 2)), k)
    assert sorted(r.vec_id for r in au.asset_source(store).collect()) == list(range(40))
    plan = store.stored(["a"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan and "PushedFilters: []" in plan


def _tel(spark, rows):
    return spark.createDataFrame(rows, "session_id long, event_id long, t_us long, which string, y double, kind string")


def test_retention_boundary_kept(spark):
    rows = [(1, 1, 0, "user_started_speaking", None, "event"), (1, 2, 1, "user_stopped_speaking", None, "event"),
            (1, 3, 76, "vad_probability", 0.5, "value"), (2, 4, 0, "user_started_speaking", None, "event")]
    kept = sorted(r.event_id for r in tm.event_retention(_tel(spark, rows), 75).collect())
    assert kept == [2, 4]  # exactly 75 before the newest value is kept; value-less sessions keep all


def test_series_tail_brute_force(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(3), i, rnd.randint(0, 5000), rnd.choice(["raw_vol", "vad_probability"]), 0.5, "value")
            for i in range(900)]
    got = sorted((r.session_id, r.which, r.event_id, r.rank)
                 for r in tm.series_tail(_tel(spark, rows), 25).collect())
    want = []
    for s in range(3):
        for w in ["raw_vol", "vad_probability"]:
            pts = sorted((r for r in rows if r[0] == s and r[3] == w), key=lambda r: (r[2], r[1]), reverse=True)[:25]
            want += [(s, w, r[1], k + 1) for k, r in enumerate(pts)]
    assert got == sorted(want)


def test_unknown_model_is_error_status(spark):
    ch = spark.createDataFrame([(k, 0, "user", "x", None) for k in range(6)],
                               "session_id long, turn long, role string, text string, audio array<float>")
    out = {r.session_id: r.status for r in cfg.model_config_join(cfg.session_models(ch), model_config(spark)).collect()}
    assert out[4] == "unknown_model" and out[0] == "ok"
    assert cfg.unknown_models(cfg.session_models(ch), model_config(spark)).count() == 1
    over = model_config(spark, '{"model-4": {"base_url": "u", "api_key": null}}')
    out2 = {r.session_id: r.status for r in cfg.model_config_join(cfg.session_models(ch), over).collect()}
    assert out2[4] == "ok" and out2[0] == "unknown_model"  # the override replaces the defaults
