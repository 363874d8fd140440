"""Greedy throttle of event streams: maps of stretches, their composition, hot sessions."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.operators import throttle


def loop(rows, interval):
    out = []
    for key in {r[0] for r in rows}:
        some = sorted(((r[2], r[1]) for r in rows if r[0] == key and r[2] is not None))
        last, before, n = None, -1, 0
        for i, (t, e) in enumerate(some):
            if last is None or t - last >= interval and (interval > 0 or t > last):
                n += 1
                out.append((key, n, e, t, False, i - before))
                last, before = t, i
        if some:
            out.append((key, n + 1, some[-1][1], some[-1][0], True, len(some) - 1 - before))
    return sorted(out, key=str)


def got(df, *args, **kw):
    return sorted((tuple(r) for r in throttle.throttle_events(df, *args, **kw).collect()), key=str)


@pytest.mark.parametrize("interval,width,fan", [(10, 25, 2), (100, 25, 3), (7, 1000, 64), (0, 50, 4), (1, 7, 2)])
def test_equals_loop(spark, interval, width, fan):
    rnd = random.Random(interval)
    rows = [(rnd.choice([1, 2, 3, None]), i, rnd.randint(-300, 700)) for i in range(500)]
    rows += [(9, 1000, 5), (10, 1001, None), (11, 1002, 5), (11, 1003, 5)]
    df = spark.createDataFrame(rows, "session_id long, event_id long, t_us long").repartition(4)
    assert got(df, interval, width, fan=fan) == loop(rows, interval)


def test_empty_and_string_keys(spark):
    assert got(spark.createDataFrame([], "session_id long, event_id long, t_us long"), 5, 10) == []
    rows = [("a", 1, 0), ("a", 2, 3), ("b", 3, 1)]
    assert got(spark.createDataFrame(rows, "session_id string, event_id long, t_us long"), 5, 10) == loop(rows, 5)


def test_maps_compose():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        t = np.sort(rnd.integers(0, 400, rnd.integers(2, 60)))
        interval, cuts = int(rnd.integers(1, 120)), np.unique(rnd.integers(1, 400, 3))
        parts = [x for x in np.split(t, np.searchsorted(t, cuts)) if len(x)]
        whole = throttle.bucket_steps(t, interval)
        made = throttle.bucket_steps(parts[0], interval)
        for x in parts[1:]:
            made = throttle.compose(made, throttle.bucket_steps(x, interval))
        for before in [throttle.NEVER, *range(-150, int(t[0]))]:
            assert whole.at(before) == made.at(before)


def test_hot_session_is_spread(spark):
    """A session with a third of all rows: every group is one bucket of it, a map has few pieces, and no level above has more maps than ``fan``."""
    n, width, fan, interval = 60_000, 1000, 16, 30
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).cast("long").alias("session_id"),
                               F.col("id").alias("event_id"), ((F.col("id") * 7919) % 200_000).alias("t_us"))
    groups = throttle.bucketed(df, "session_id", "t_us", "event_id", width).groupBy("session_id", "b").count()
    hot = [r["count"] for r in groups.where("session_id = -1").collect()]
    assert sum(hot) == n // 3 and max(hot) < n // 3 // 100
    rows = [tuple(r) for r in df.where("session_id = -1").collect()]
    assert got(df.where("session_id = -1"), interval, width, fan=fan) == loop(rows, interval)
    pieces = [len(throttle.bucket_steps(np.array(sorted(r[2] for r in rows if r[2] // width == b)), interval).upto) for b in range(20)]
    assert max(pieces) <= interval + 1
    whole = throttle.throttle_events(df, interval, width, fan=fan)
    assert whole.where("session_id <> -1 and not is_tail").count() == n - n // 3


def test_group_of_maps_holds_no_objects(spark):
    """Telling states to a group of maps takes memory of the order of the group's columns."""
    maps = [throttle.bucket_steps(np.sort(np.random.default_rng(k).integers(0, 400, 40)), 60) for k in range(3000)]
    key = pa.field("session_id", pa.int64())
    schema = pa.schema([key, ("b", pa.int64()), *throttle._MAP])
    made = throttle._table(schema, list(range(3000)), [0] * 3000, maps).append_column("up", pa.array([0] * 3000, pa.int64()))
    states = pa.table([[], [], [], [], [], []], schema=pa.schema([key, ("up", pa.int64()), *throttle._STATE]))
    tracemalloc.start()
    told = throttle._told(key)(made, states)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told.num_rows == 3000 and peak < 2 * made.nbytes


def test_any_size_of_groups(spark):
    df = spark.range(3000).select((F.col("id") % 40).alias("session_id"), F.col("id").alias("event_id"), (F.col("id") * 7919 % 5000).alias("t_us"))
    assert got(df, 30, 100, fan=4, group_rows=50) == loop([tuple(r) for r in df.collect()], 30)
