"""Session helpers: a tuned local session for tests/bench and the shared folder for state."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on: UTC session time, AQE (coalescing, skew join),
# Arrow for the few Pandas steps.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "parley") -> SparkSession:
    """Local session for tests and the bench; on a cluster the job's own session is used."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", "16g")
    # Tests only: a scratch checkpoint folder when none is configured.
    b = b.config("spark.checkpoint.dir", os.environ.get("PARLEY_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="parley-ckpt-"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests) without one gets a scratch folder; on a cluster a
    machine-local folder would break state and staged tables, so it is an error.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        d = tempfile.mkdtemp(prefix="parley-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def state_path(spark: SparkSession, name: str) -> str:
    """Path of a named table or stream checkpoint below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), name)


_written: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that what lies before it runs once and
    survives lost executors. The table goes with ``drop_written``, or when the driver's Python ends."""
    spark = df.sparkSession
    path = state_path(spark, f"tables/{name}-{uuid.uuid4().hex}")
    _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parley_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that no plan needs any more."""
    for t in tables:
        _remove(t._parley_path, _written.pop(t._parley_path))


def _remove(path: str, spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_written() -> None:
    for path, spark in _written.items():
        _remove(path, spark)
