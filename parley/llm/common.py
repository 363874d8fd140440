"""Helpers shared by the operators: input tables, shared-folder tables, text expressions."""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.session import state_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# White space of the word contracts: \x20 and \x09-\x0D.
SPACES = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder; removed when the driver's Python ends."""
    path = state_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here,
    the plan above it runs once, and a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_with(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """``materialize`` and aggregates over the rows, taken as they are written: no query of their own. A figure of
    no rows may be missing."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(k) for k, c in figures.items()]), name)
    return out, seen.get


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Lowers the session's Arrow batch size in bytes: a batch of whole texts is held several times over
    (JVM, Arrow buffers, Python). It changes memory only, no result."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= megabytes << 20:
        spark.conf.set(key, f"{megabytes}m")


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of the driver's rows, passed as Arrow: rows of Python objects are an RDD, whose Python workers are not those of
    the Arrow functions and stay in the executors' memory beside them."""
    names = StructType.fromDDL(ddl).names
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table([pa.array(list(c)) for c in columns], names), ddl)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that by itself on pure ASCII and is much faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACES), lambda w: w != "")), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is 1 modulo 3 (null id: learned from never)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def smallest_hashes(rows: DataFrame, by: str, classes: list[tuple[object, int]], most: int, seed: int) -> DataFrame:
    """``rows`` of a few ids per class of ``by``: a superset of the ``most`` ids of smallest seeded hash, some twice as many.

    ``classes``: each class with its number of distinct ids, estimated or exact. A hash below a class's threshold decides by
    row, so nothing is sorted or brought together. Null ids are left out; all rows of a chosen id are kept.
    """
    if not classes:
        return rows.where(F.lit(False))
    share = small_table(rows.sparkSession, [(c, min(2.0, (2.0 * most + 32) / max(1, n))) for c, n in classes],
                        f"{by} {rows.schema[by].dataType.simpleString()}, _share double")
    chosen = rows.join(F.broadcast(share), by).where(id_hash(seed) / 2.0 ** 64 + 0.5 < F.col("_share"))
    return chosen.select(*rows.columns)


def id_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id")
