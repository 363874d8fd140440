"""Sharding by sampled splitters.

1. Keys are drawn with probability proportional to the record size (the whole table takes part;
   the draw is a hash of seed, id and key, so reruns agree).
2. Quantiles of the drawn keys are the splitters of many fine key ranges. A key that fills
   two neighbouring quantiles gets a range of its own.
3. Every range is measured exactly. An overfull range is subdivided by a hash of the key, and of the row for
   a key whose group is above ``keep_share``.
4. A range's exact offsets and a running sum inside it give every record its position on the
   line of all bytes; shard = position * n_shards // total, so shard sizes differ by about one
   record, whatever the draw was.

Records with equal texts have one key, lie side by side, and stay in one shard while the group is
below ``keep_share`` of a shard; larger groups are cut between shards like other records.

Per-range figures are the only thing the driver sees: at most ``max_ranges`` ranges and
their subdivisions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parley.llm.common import materialize, small_table

OUT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


@dataclass(frozen=True)
class Sharding:
    n_shards: int = 40
    seed: int = 17
    range_bytes: int = 64 << 20     # aim for a range
    ranges_per_shard: int = 4       # at least
    max_ranges: int = 65_536        # at most: bounds what the driver holds
    draws_per_range: int = 32
    overfull: float = 2.0           # times the mean range, then it is subdivided
    keep_share: float = 0.02        # groups up to this share of a shard stay together


def _keyed(df: DataFrame) -> DataFrame:
    """Adds the private columns: key, size, crc and a tie-breaker over the plain columns."""
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    text = F.coalesce(F.col("text"), F.lit(""))
    return (df.withColumn("_sh_key", F.xxhash64(text))
              .withColumn("_sh_size", F.octet_length(text).cast("long") + 16)
              .withColumn("_sh_crc", F.crc32(text))
              .withColumn("_sh_tie", F.xxhash64(*[F.col(f"`{c}`") for c in plain])))


def _range_id(bounds: np.ndarray, heavy: np.ndarray):
    """key -> range number, increasing with the key; a heavy key has its own (odd) number."""
    @F.pandas_udf(T.IntegerType())
    def f(key: pd.Series) -> pd.Series:
        k = key.to_numpy()
        if not len(bounds):
            return pd.Series(np.zeros(len(k), dtype=np.int32))
        left = np.searchsorted(bounds, k, "left")
        right = np.searchsorted(bounds, k, "right")
        own = (left < right) & heavy[np.minimum(left, len(bounds) - 1)]
        return pd.Series(np.where(own, 2 * left + 1, 2 * right).astype(np.int32))

    # joins and filters on the range must not copy the call below the projection: each copy is a Python worker more in a task
    return f.asNondeterministic()


def _with_ranges(keyed: DataFrame, range_of, cuts: list[tuple[int, int]], cut_keys: list[int]) -> DataFrame:
    """Adds range and subdivision; ``cuts`` holds (range, parts) of the overfull ranges, ``cut_keys`` the keys
    in them whose group is too large to stay together."""
    df = keyed.withColumn("_sh_range", range_of(F.col("_sh_key")))
    if not cuts:
        return df.withColumn("_sh_sub", F.lit(0))
    spark = keyed.sparkSession
    parts = small_table(spark, cuts, "_sh_range int, _sh_parts int")
    by_row = small_table(spark, [(k, True) for k in cut_keys], "_sh_key long, _sh_cut boolean")
    # at most n_shards / keep_share rows
    df = df.join(F.broadcast(by_row), "_sh_key", "left")
    by = F.when(F.col("_sh_cut"), F.col("_sh_tie")).otherwise(F.col("_sh_key"))
    sub = F.pmod(F.xxhash64(F.lit("sub"), by), F.coalesce(F.col("_sh_parts"), F.lit(1)))
    # one row for each overfull range: at most a few times max_ranges / overfull
    return df.join(F.broadcast(parts), "_sh_range", "left").withColumn("_sh_sub", sub.cast("int")).drop("_sh_parts", "_sh_cut")


def _positions(df: DataFrame, p: Sharding, total: int, starts: list[tuple]) -> DataFrame:
    """Adds the shard. ``starts``: (range, sub, bytes before it), one row for each range."""
    spark = df.sparkSession
    at = small_table(spark, starts, "_sh_range int, _sh_sub int, _sh_from long")
    inside = Window.partitionBy("_sh_range", "_sh_sub")
    order = ["_sh_key", "doc_id", "_sh_tie"]
    upto = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("_sh_range", "_sh_sub", "_sh_key")
    df = (df.join(F.broadcast(at), ["_sh_range", "_sh_sub"])
            .withColumn("_sh_pos", F.coalesce(F.sum("_sh_size").over(upto), F.lit(0)) + F.col("_sh_from"))
            .withColumn("_sh_group", F.sum("_sh_size").over(group))
            .withColumn("_sh_first", F.min("_sh_pos").over(group)))
    together = F.col("_sh_group") <= F.lit(p.keep_share * total / p.n_shards)
    mid = F.when(together, F.col("_sh_first") + F.col("_sh_group") / 2).otherwise(F.col("_sh_pos") + F.col("_sh_size") / 2)
    return df.withColumn("shard", F.least(F.lit(p.n_shards - 1), F.floor(mid * p.n_shards / F.lit(max(total, 1)))).cast("int"))


def shard_records(docs: DataFrame, p: Sharding = Sharding()) -> DataFrame:
    """``docs`` (doc_id, text, any others) with size, text_crc32, law, shard, slot, grown_shard.

    size = UTF-8 bytes of the text + 16. Null text: no bytes, crc32 0. Empty table: no rows.
    Repeated rows: each is a record. Null ids sort first. Input columns with the names of results are
    replaced by them. The law is ``bytes``; ``grown_shard`` is null.
    """
    docs = docs.drop(*OUT)
    slim = materialize(_keyed(docs).select("doc_id", "_sh_key", "_sh_size", "_sh_tie"), "shard-keys")
    total, rows = slim.agg(F.coalesce(F.sum("_sh_size"), F.lit(0)), F.count("*")).first()

    n_ranges = int(min(p.max_ranges, max(p.n_shards * p.ranges_per_shard, total // p.range_bytes)))
    # Poisson draw, expectation draws_per_range * n_ranges: bounded by parameters
    u = (F.pmod(F.xxhash64(F.lit(p.seed), "_sh_tie"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    share = F.col("_sh_size") * float(n_ranges * p.draws_per_range) / max(total, 1)
    drawn = np.sort(slim.where(u < share).select("_sh_key").toPandas()["_sh_key"].to_numpy(dtype=np.int64))
    cuts = drawn[(np.arange(1, n_ranges) * len(drawn)) // n_ranges] if len(drawn) else drawn
    bounds, times = np.unique(cuts, return_counts=True)
    range_of = _range_id(bounds, times > 1)

    def measured(df: DataFrame, *more: str) -> list:
        keys = ["_sh_range", "_sh_sub", *more]
        return sorted(tuple(r) for r in df.groupBy(*keys).agg(F.sum("_sh_size"), F.count("*")).toLocalIterator())

    ranges = measured(_with_ranges(slim, range_of, [], []))
    mean = total / max(1, n_ranges)
    overfull = [(r, int(-(-b // mean))) for r, _, b, _ in ranges if b > p.overfull * mean]
    cut_keys = []
    if overfull:
        inside = _with_ranges(slim, range_of, [], []).where(F.col("_sh_range").isin([r for r, _ in overfull]))
        groups = inside.groupBy("_sh_key").agg(F.sum("_sh_size").alias("bytes")).where(F.col("bytes") > p.keep_share * total / p.n_shards)
        cut_keys = [r[0] for r in groups.select("_sh_key").toLocalIterator()]
    slim = _with_ranges(slim, range_of, overfull, cut_keys)
    if overfull:
        ranges = measured(slim)
    before = np.cumsum([0, *(b for _, _, b, _ in ranges)]).tolist()
    starts = [(r, s, at) for (r, s, _, _), at in zip(ranges, before)]

    # rows of each shard that lie in earlier ranges
    seen: dict[int, int] = {}
    slots = []
    for r, s, k, _, n in measured(_positions(slim, p, total, starts), "shard"):
        slots.append((r, s, k, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + n
    spark = docs.sparkSession
    slot_at = F.broadcast(small_table(spark, slots, "_sh_range int, _sh_sub int, shard int, _sh_slot long"))

    out = _positions(_with_ranges(_keyed(docs), range_of, overfull, cut_keys), p, total, starts)
    here = Window.partitionBy("_sh_range", "_sh_sub", "shard").orderBy("_sh_key", "doc_id", "_sh_tie")
    return (out.withColumn("_sh_row", F.row_number().over(here) - 1)
               .join(slot_at, ["_sh_range", "_sh_sub", "shard"])
               .select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_sh_size").alias("size"), F.col("_sh_crc").alias("text_crc32"),
                       F.lit("bytes").alias("law"), "shard", (F.col("_sh_slot") + F.col("_sh_row")).cast("long").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard")))
