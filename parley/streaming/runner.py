"""Run a Structured Streaming job to completion over a staged table.

The input is written once to the shared checkpoint folder (``spark.checkpoint.dir``),
read with ``readStream`` and processed with ``trigger(availableNow=True)``. Event-time
timers fire only once the watermark passes them, and the watermark only moves with
data; so after the data, two runs each add one far-future sentinel row, marked by a column of
its own and taken out right behind the watermark (no key or time of a real row is reserved): the first moves the
watermark past every real timer, the second lets them fire. The streaming checkpoint makes
every run resumable after a lost executor or driver.

A ``Progress`` gathers, per micro-batch, what ``Dataset.observe`` saw of the input, the watermark, and the rows that came
behind it, which Spark drops.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from parley.session import state_path
from parley.streaming.ordered import FAR_US, SENTINEL


@dataclass
class Progress:
    """What the micro-batches of a stream reported."""

    batches: list[dict] = field(default_factory=list)
    runs: int = 0

    def add(self, query) -> None:
        for p in query.recentProgress:
            seen = p.observedMetrics.get("input")
            self.batches.append({"run": self.runs, "batch": p.batchId, "watermark": dict(p.eventTime).get("watermark"),
                                 "rows": seen["rows"] if seen else 0, "max_us": seen["max_us"] if seen else None,
                                 "late": sum(o.numRowsDroppedByWatermark for o in p.stateOperators)})
        self.runs += 1

    @property
    def rows(self) -> int:
        return sum(b["rows"] for b in self.batches)

    @property
    def late(self) -> int:
        return sum(b["late"] for b in self.batches)


MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
MANAGERS = ["org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
            "org.apache.spark.sql.execution.streaming.FileSystemBasedCheckpointFileManager"]


@contextmanager
def cheap_local_logs(spark: SparkSession, checkpoint: str) -> Iterator[None]:
    """A query started here keeps its logs by ``FileSystem`` if its checkpoint is a local folder: the default asks ``FileContext``, which without
    Hadoop's native library starts some processes for each file. Other file systems, and a manager that is set already, stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    local = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    known = [m for m in MANAGERS if spark._jvm.org.apache.spark.util.Utils.classIsLoadable(m)] if local and spark.conf.get(MANAGER, None) is None else []
    if known:
        spark.conf.set(MANAGER, known[0])
    try:
        yield
    finally:
        if known:
            spark.conf.unset(MANAGER)


STEP = "_step"          # folders of the staged input, one a step
SLICE_ROWS = 5_000_000  # rows of a slice; more data means more slices, not larger ones


def cuts(data: DataFrame, slices: int, order_col: str | None, at: list[int] | None = None) -> list[int]:
    """Where ``data`` is cut into slices: approximate quantiles of ``order_col`` (a distributed aggregate, a few numbers) for
    ``slices`` parts or more, or the values ``at``."""
    if order_col is None or (slices <= 1 and at is None):
        return []
    if at is None:
        slices = max(slices, data.count() // SLICE_ROWS)
        at = data.approxQuantile(order_col, [k / slices for k in range(1, slices)], 0.001)
    return sorted(set(at))


def slice_number(order_col: str | None, bounds: list[int]) -> Column:
    """The slice of a row between ``bounds``; rows without an order value come with the first one."""
    return sum((F.when(F.col(order_col) >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))


def slices_in_order(data: DataFrame, slices: int, order_col: str | None, at: list[int] | None = None) -> list[DataFrame]:
    """``data`` as its slices."""
    bounds = cuts(data, slices, order_col, at)
    return [data.where(slice_number(order_col, bounds) == k) for k in range(len(bounds) + 1)]


def sentinel_row(data: DataFrame, values: dict) -> DataFrame:
    """One row of nulls but for ``values``, the far-future time and the sentinel mark."""
    spark = data.sparkSession
    known = {**values, "t_us": FAR_US}
    cols = [F.lit(known.get(f.name)).cast(f.dataType).alias(f.name) for f in data.schema]
    return spark.range(1).select(*cols, F.lit(True).alias(SENTINEL))


def run_available_now(
    spark: SparkSession,
    name: str,
    data: DataFrame,
    start: Callable[[DataFrame, str], DataStreamWriter],
    sentinel: dict | None = None,
    read_result: Callable[[str], DataFrame] | None = None,
    slices: int = 1,
    order_col: str | None = None,
    at: list[int] | None = None,
    after_slice: Callable[[int, str], None] | None = None,
    progress: Progress | None = None,
) -> DataFrame:
    """Stage ``data``, stream it through ``start(stream_df, out_path)`` and return the result.

    ``start`` returns a configured ``DataStreamWriter`` (sink + output mode); checkpoint
    location and trigger are set here. With ``slices`` > 1 the input arrives in that many
    steps in the order of ``order_col`` (many files each, all written in one pass, a folder a step); the stream runs after every step with one
    folder more, so state is carried across runs and no order of files is relied on. ``after_slice(k, out)`` is called behind each. With a ``sentinel`` (values of the
    sentinel row that the rule's own filters let pass) the stream has the column of its mark: ``ordered.watermarked``.
    """
    base = state_path(spark, f"streams/{name}/{uuid.uuid4().hex}")
    src, out, ckpt = f"{base}/src", f"{base}/out", f"{base}/ckpt"
    if slices > 1 or at is not None:   # the input's plan runs once
        data.write.parquet(f"{base}/input")
        data = spark.read.schema(data.schema).parquet(f"{base}/input")
    bounds = cuts(data, slices, order_col, at)
    end = None
    if sentinel is not None:
        end = sentinel_row(data, sentinel)
        data = data.withColumn(SENTINEL, F.lit(None).cast("boolean"))
    schema = data.schema
    data.withColumn(STEP, slice_number(order_col, bounds)).write.partitionBy(STEP).parquet(src)
    steps = 0

    def run(rows: DataFrame) -> None:
        """The stream over the folders up to the next one, with ``rows`` if nothing is there."""
        nonlocal steps
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{src}/{STEP}={steps}")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            rows.write.parquet(folder.toString())
        steps += 1
        stream = spark.readStream.schema(schema).parquet(f"{src}/{STEP}={{{','.join(map(str, range(steps)))}}}")
        if progress is not None:
            real = ~F.coalesce(F.col(SENTINEL), F.lit(False)) if end is not None else F.lit(True)
            stream = stream.observe("input", F.count_if(real).alias("rows"), F.max(F.when(real, F.col("t_us"))).alias("max_us"))
        q = start(stream, out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception() is not None:  # pragma: no cover
            raise RuntimeError(str(q.exception()))
        if progress is not None:
            progress.add(q)

    for k in range(len(bounds) + 1):
        run(data.where(F.lit(False)))
        if after_slice is not None:
            after_slice(k, out)
    if end is not None:
        for _ in range(2):
            run(end)
    return read_result(out) if read_result else spark.read.parquet(out)
