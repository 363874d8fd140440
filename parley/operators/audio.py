"""Audio vectors: normalize, quantize, fingerprint, content-addressed asset store.

Everything is a per-row higher-order expression except the de-duplication, which is
an aggregation on the fingerprint (partial aggregation: a hot fingerprint collapses
map-side) and an anti join against the store's index; the files are written by a data source (``sources.wav``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import audio as fa
from parley.session import drop_written, written
from parley.sources.wav import WavFiles
from parley.streaming.sinks import BatchSink

UTTERANCE_FRAMES = 16  # test derivation: an utterance = 16 consecutive vectors of a session


def audio_peak(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", "session_id", fa.peak(F.col("samples")).alias("peak"))


def peak_normalize(vectors: DataFrame) -> DataFrame:
    n = fa.normalize(F.col("samples"))
    return vectors.select("vec_id", n.isNull().alias("silent"), n.alias("normalized"))


def pcm16_quantize(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", fa.pcm16(fa.normalize(F.col("samples"))).alias("pcm16"))


def fingerprints(vectors: DataFrame) -> DataFrame:
    """vec_id, session_id, pcm16, fp (null for silent vectors)."""
    pcm = fa.pcm16(fa.normalize(F.col("samples")))
    return vectors.select("vec_id", "session_id", pcm.alias("pcm16")).withColumn("fp", fa.fingerprint(F.col("pcm16")))


def audio_fingerprint(vectors: DataFrame) -> DataFrame:
    return fingerprints(vectors).select("vec_id", "fp")


def asset_rows(vectors: DataFrame) -> DataFrame:
    """One asset per distinct fingerprint (first vec_id), with its path and bytes."""
    g = fresh_assets(vectors)
    return g.select("fp", "vec_id", F.concat(F.lit("tmp_"), F.col("fp"), F.lit(".wav")).alias("path"),
                    F.substring("fp", 1, 2).alias("prefix"), fa.wav_bytes(F.col("pcm16")).alias("wav"))


class AssetStore:
    """Write-once store of audio files: ``files/<batch>/<prefix>/tmp_<fp>.wav``, and an index of them (fp, vec_id, path, prefix).

    A batch's files are written first, then its part of the index, then its entry in the ledger; only that makes it count. So a
    batch that fails anywhere leaves nothing that a reader sees, and trying it again replaces what is left. The index is
    partitioned by the fingerprint's first digits; a look-up reads only the partitions that the new fingerprints touch.
    One writer at a time.
    """

    SCHEMA = "fp string, vec_id long, path string, prefix string"

    def __init__(self, spark: SparkSession, path: str, digits: int = 1):
        self.spark, self.path, self.digits = spark, path, digits
        self.index = BatchSink(spark, f"{path}/index", ("prefix",))

    def stored(self, prefixes: list[str] | None = None) -> DataFrame:
        rows = self.index.read(self.SCHEMA)
        return rows if prefixes is None else rows.where(F.col("prefix").isin(prefixes))

    def add(self, vectors: DataFrame, batch_id: int | None = None) -> None:
        """Stores the assets of ``vectors`` that aren't there yet, as one batch (the next one, unless its id is given)."""
        done = self.index.ledger.committed()
        if batch_id is None:
            batch_id = max(done, default=-1) + 1
        if batch_id in done:
            return
        job = f"files/{batch_id}"
        prefix = F.substring("fp", 1, self.digits)
        new, tables = fresh_assets(vectors).withColumn("prefix", prefix), []
        if done:
            new = written(new, "assets")
            tables.append(new)
            touched = [r[0] for r in new.select("prefix").distinct().collect()]       # at most 16 ** digits
            new = new.join(self.stored(touched).select("fp"), "fp", "left_anti")
        new = written(new.withColumn("name", F.concat("prefix", F.lit("/tmp_"), "fp", F.lit(".wav"))), "assets-new")
        tables.append(new)
        if batch_id in self._left():
            self._fs.delete(self._hadoop(f"{self.path}/{job}"), True)
        new.sparkSession.dataSource.register(WavFiles)      # a micro-batch has a session of its own
        new.select("name", "pcm16").write.format("parley_wav").option("path", f"{self.path}/{job}").mode("append").save()
        rows = new.select("fp", "vec_id", F.concat(F.lit(job + "/"), "name").alias("path"), "prefix")
        self.index.write(rows.repartition("prefix"), batch_id)
        drop_written(*tables)

    def files(self) -> DataFrame:
        """(fp, wav) of the files of all committed batches, read from the files themselves."""
        paths = [f"{self.path}/files/{b}" for b in self.index.ledger.committed() if b in self._left()]
        if not paths:
            return self.spark.createDataFrame([], "fp string, wav binary")
        got = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(paths)
        return got.select(F.regexp_extract("path", "tmp_([0-9a-f]+)[.]wav$", 1).alias("fp"), F.col("content").alias("wav"))

    @property
    def _hadoop(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path

    @property
    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _left(self) -> set[int]:
        """Batches that have files, committed or not."""
        folder = self._hadoop(f"{self.path}/files")
        return {int(s.getPath().getName()) for s in self._fs.listStatus(folder)} if self._fs.exists(folder) else set()


def fresh_assets(vectors: DataFrame) -> DataFrame:
    """One row per distinct fingerprint: fp, vec_id (the first) and its samples."""
    f = fingerprints(vectors).where(F.col("fp").isNotNull())
    return f.groupBy("fp").agg(F.min_by("pcm16", "vec_id").alias("pcm16"), F.min("vec_id").alias("vec_id"))


def assets_to_write(vectors: DataFrame, stored: DataFrame) -> DataFrame:
    """Write-once: distinct new fingerprints not already stored (anti join)."""
    return asset_rows(vectors).join(stored.select("fp").distinct(), "fp", "left_anti")


def asset_source(store: AssetStore) -> DataFrame:
    """Stored files with their index: fp, vec_id, path (the file's name), prefix (2 digits), wav."""
    return store.files().join(store.stored().select("fp", "vec_id"), "fp").select(
        "fp", "vec_id", F.concat(F.lit("tmp_"), "fp", F.lit(".wav")).alias("path"), F.substring("fp", 1, 2).alias("prefix"), "wav")


def audio_data_url(assets: DataFrame) -> DataFrame:
    return assets.select("fp", "vec_id", fa.data_url(F.col("wav")).alias("audio_url"))


def utterance_concat(vectors: DataFrame) -> DataFrame:
    """Samples of an utterance's frames concatenated in order (float32, uncapped)."""
    u = vectors.withColumn("utterance_id", F.expr(f"vec_id div {UTTERANCE_FRAMES}"))
    g = u.groupBy("session_id", "utterance_id").agg(
        F.sort_array(F.collect_list(F.struct("vec_id", "samples"))).alias("frames"))
    audio = F.flatten(F.transform("frames", lambda x: x["samples"]))
    return g.select("session_id", "utterance_id", F.size("frames").alias("n_frames"), audio.alias("audio"))
