"""Greedy throttle of event streams of any length.

The rule is sequential: the first element is emitted, then each that comes at least ``interval`` after the last emitted one;
at the end the final element is emitted (again, if it just was). A session may hold a third of all rows, so no task
gets one. What a stretch of time does to the stream is a function of one number, the time of the last emission before it:
either the first element far enough from it starts a chain through the stretch, or none is. That is a piecewise
constant map (``Steps``): thresholds of the incoming time, and for each piece the last emission, the number of emissions
and the place of the last one.

1. each (session, time bucket) yields its map; only the bucket's first ``interval`` gives pieces;
2. maps of ``fan`` neighbouring buckets are composed to one, level by level, until one covers the session;
3. from the top down, each map's children are told the last emission before them;
4. each bucket, knowing it, walks its chain and emits.

Buckets, and maps, are dealt to groups by a hash of session and time, about ``group_rows`` rows each whatever the size of the
tables: small ones share a group, those of a long session are spread. A task runs many groups, one at a time, so its memory is a group's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from parley.session import written

NEVER = -(1 << 62)      # time of the last emission before the first


@dataclass
class Steps:
    """The map of a stretch: piece k holds for a last emission up to ``upto[k]`` (above the last threshold nothing is emitted)."""

    upto: np.ndarray       # thresholds, ascending
    last: np.ndarray       # time of the stretch's last emission
    count: np.ndarray      # emissions in the stretch
    place: np.ndarray      # row of the last emission within the stretch
    first_us: int
    rows: int

    def at(self, t: int) -> tuple[int, int, int]:
        """(last emission, emissions, place or -1) for a last emission at ``t`` before the stretch."""
        k = int(np.searchsorted(self.upto, t))
        if k == len(self.upto):
            return t, 0, -1
        return int(self.last[k]), int(self.count[k]), int(self.place[k])

    def tidy(self) -> "Steps":
        """Without pieces that can't be reached (the last emission is before the stretch) and with equal neighbours merged."""
        n = min(len(self.upto), int(np.searchsorted(self.upto, self.first_us - 1)) + 1)
        a = [x[:n] for x in (self.upto, self.last, self.count, self.place)]
        same = (a[1][1:] == a[1][:-1]) & (a[2][1:] == a[2][:-1]) & (a[3][1:] == a[3][:-1])
        keep = np.r_[~same, True] if n else np.zeros(0, bool)
        return Steps(*[x[keep] for x in a], self.first_us, self.rows)


def bucket_steps(t: np.ndarray, interval: int) -> Steps:
    """The map of a bucket with the (sorted) times ``t``."""
    times, row = np.unique(t, return_index=True)
    n = len(times)
    jump = np.searchsorted(times, times + interval) if interval > 0 else np.arange(1, n + 1)
    end, count = np.arange(n), np.ones(n, np.int64)
    while (go := np.flatnonzero(jump < n)).size:        # the end of every chain, by doubling
        to = jump[go]
        end_to, count_to, jump_to = end[to], count[to], jump[to]
        end[go], count[go], jump[go] = end_to, count[go] + count_to, jump_to
    return Steps(times - interval, times[end], count, row[end], int(times[0]), len(t)).tidy()


def compose(f: Steps, g: Steps) -> Steps:
    """The map of a stretch and the next one together."""
    through = [g.at(int(x)) for x in f.last]
    top = f.upto[-1] if len(f.upto) else NEVER
    more = g.upto > top                                 # f emits nothing: g sees the emission before f
    place = [p if q < 0 else f.rows + q for p, (_, _, q) in zip(f.place, through)]
    return Steps(np.r_[f.upto, g.upto[more]], np.r_[[x[0] for x in through], g.last[more]].astype(np.int64),
                 np.r_[[c + x[1] for c, x in zip(f.count, through)], g.count[more]].astype(np.int64),
                 np.r_[place, g.place[more] + f.rows].astype(np.int64), f.first_us, f.rows + g.rows).tidy()


_LONGS = pa.list_(pa.int64())
_MAP = [("upto", _LONGS), ("last", _LONGS), ("count", _LONGS), ("place", _LONGS), ("first_us", pa.int64()), ("rows", pa.int64())]
_MAP_DDL = "upto array<long>, last array<long>, count array<long>, place array<long>, first_us long, rows long"
_STATE = [("last_us", pa.int64()), ("emitted", pa.int64()), ("since", pa.int64()), ("is_end", pa.bool_())]
_STATE_DDL = "last_us long, emitted long, since long, is_end boolean"


def _table(schema: pa.Schema, keys: list, parts: list[int], maps: list[Steps]) -> pa.Table:
    """Maps as columns: the pieces of all of them end to end."""
    ends = np.cumsum([0, *[len(s.upto) for s in maps]]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *[getattr(s, c) for s in maps]]))) for c, _ in _MAP[:4]]
    return pa.table([pa.array(keys, schema.field(0).type), pa.array(parts, pa.int64()), *lists,
                     pa.array([s.first_us for s in maps], pa.int64()), pa.array([s.rows for s in maps], pa.int64())], schema=schema)


class _Maps:
    """The maps of a table, each made when it is asked for: views of the columns, no objects per row."""

    def __init__(self, table: pa.Table):
        lists = [table[c].combine_chunks() for c, _ in _MAP[:4]]
        self.lists = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in lists]
        self.part, self.first, self.rows = (table[c].to_numpy() for c in ("b", "first_us", "rows"))

    def __getitem__(self, i: int) -> Steps:
        return Steps(*[v[o[i]:o[i + 1]] for o, v in self.lists], int(self.first[i]), int(self.rows[i]))


def _stretches(table: pa.Table, key: str, part: str, *order: str):
    """(key, part, rows in order) of each stretch in a table that holds many, without a call per stretch from Spark."""
    codes = table[key].combine_chunks().dictionary_encode(null_encoding="encode")
    names, code, parts = codes.dictionary.to_pylist(), codes.indices.to_numpy(), table[part].to_numpy()
    at = np.lexsort([*[table[c].to_numpy() for c in reversed(order)], parts, code])
    code, parts = code[at], parts[at]
    cut = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (parts[1:] != parts[:-1])]) if len(at) else np.zeros(0, int)
    for lo, hi in zip(cut, np.r_[cut[1:], len(at)]):
        yield names[code[lo]], int(parts[lo]), at[lo:hi]


def _summary(key: pa.Field, interval: int):
    schema = pa.schema([key, ("b", pa.int64()), *_MAP])

    def run(rows: pa.Table) -> pa.Table:
        t, keys, parts, made = rows["t"].to_numpy(), [], [], []
        for k, b, at in _stretches(rows, key.name, "b", "t"):
            keys.append(k)
            parts.append(b)
            made.append(bucket_steps(t[at], interval))
        return _table(schema, keys, parts, made)
    return run


def _composed(key: pa.Field):
    schema = pa.schema([key, ("b", pa.int64()), *_MAP])

    def run(maps: pa.Table) -> pa.Table:
        given, keys, parts, made = _Maps(maps), [], [], []
        for k, b, at in _stretches(maps, key.name, "up", "b"):
            s = given[at[0]]
            for i in at[1:]:
                s = compose(s, given[i])
            keys.append(k)
            parts.append(b)
            made.append(s)
        return _table(schema, keys, parts, made)
    return run


def _told(key: pa.Field):
    """States of the children of each stretch, from the state before it."""
    schema = pa.schema([key, ("b", pa.int64()), *_STATE])

    def run(maps: pa.Table, states: pa.Table) -> pa.Table:
        given, keys, out = _Maps(maps), [], []
        known = _known(states, key.name, "up")
        for name, up, at in _stretches(maps, key.name, "up", "b"):
            state = known.get((name, up))
            last, emitted, since, end = state if state else (NEVER, 0, 0, True)
            keys += [name] * len(at)
            for i in at:
                s = given[i]
                out.append((int(given.part[i]), last, emitted, since, end and i == at[-1]))
                last, n, place = s.at(last)
                emitted += n
                since = since + s.rows if place < 0 else s.rows - 1 - place
        return pa.table([pa.array(keys, key.type), *[pa.array(list(c), f.type) for c, f in zip(list(zip(*out)) or [()] * 5, list(schema)[1:])]], schema=schema)
    return run


def _known(states: pa.Table, key: str, part: str) -> dict[tuple, tuple]:
    """(key, part) -> last_us, emitted, since, is_end. Spark gives a side without rows no columns."""
    if not states.num_rows:
        return {}
    cols = [states[c].to_pylist() for c in (key, part, "last_us", "emitted", "since", "is_end")]
    return {(k, b): rest for k, b, *rest in zip(*cols)}


def _emissions(key: pa.Field, interval: int):
    schema = pa.schema([key, ("emit_idx", pa.int64()), ("row", pa.int64()), ("t", pa.int64()), ("is_tail", pa.bool_()), ("n_rows", pa.int64())])

    def run(rows: pa.Table, states: pa.Table) -> pa.Table:
        all_t, all_ids = rows["t"].to_numpy(), rows["row"].to_numpy()
        known = _known(states, key.name, "b")
        keys, parts = [], []
        for name, b, some in _stretches(rows, key.name, "b", "t", "row"):
            last, emitted, since, end = known[name, b]
            t, ids = all_t[some], all_ids[some]
            if interval <= 0:
                places = np.unique(t, return_index=True)[1]
            else:
                at, k = [], int(np.searchsorted(t, last + interval))
                while k < len(t):
                    at.append(k)
                    k = int(np.searchsorted(t, t[k] + interval))
                places = np.array(at, np.int64)
            before, tail = np.r_[-1 - since, places], int(end)      # the final element is emitted always
            at = np.r_[places, [len(t) - 1] * tail].astype(np.int64)
            parts.append((emitted + 1 + np.arange(len(at)), ids[at], t[at], np.arange(len(at)) >= len(places),
                          np.r_[np.diff(before), [len(t) - 1 - before[-1]] * tail].astype(np.int64)))
            keys += [name] * len(at)
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [[]] * 5
        return pa.table([pa.array(keys, key.type), *cols], schema=schema)
    return run


def bucketed(events: DataFrame, key: str, t: str, row: str, width: int) -> DataFrame:
    """(key, b, t, row): the rows with their time bucket; what is grouped by (key, b) below."""
    return events.where(F.col(t).isNotNull()).select(F.col(key), F.expr(f"cast(floor(`{t}` / {width}) as bigint)").alias("b"),
                                                     F.col(t).cast("long").alias("t"), F.col(row).cast("long").alias("row"))


def throttle_events(events: DataFrame, interval: int, width: int, key: str = "session_id", t: str = "t_us", row: str = "event_id",
                    fan: int = 64, group_rows: int = 20_000) -> DataFrame:
    """Emissions of the greedy throttle per ``key``: key, emit_idx (from 1), the emitted row (``row``), its time ``t``, is_tail, and
    n_rows, the rows since the emission before (with it; 0 for a tail that was just emitted).

    Rows are ordered by (``t``, ``row``). Rows at one time are one step: the first of them is emitted, also when ``interval`` is 0. Rows
    without a time have no place in the order and are left out; a null key is a session of its own. Empty table: no rows.
    """
    base = bucketed(events, key, t, row, width)
    text = base.schema[key].dataType.simpleString() == "string"
    ddl, field = ("string", pa.field(key, pa.string())) if text else ("bigint", pa.field(key, pa.int64()))
    base = base.withColumn(key, F.col(key).cast(ddl))
    least = base.sparkSession.sparkContext.defaultParallelism

    def dealt(df: DataFrame, part: str, n: int) -> GroupedData:
        return df.withColumn("group", F.pmod(F.xxhash64(key, part), F.lit(n))).groupBy("group")

    def above(df: DataFrame) -> DataFrame:
        return df.withColumn("up", F.expr(f"cast(floor(b / {fan}) as bigint)"))

    n, lo, hi = base.agg(F.count("*"), F.min("b"), F.max("b")).first()
    lo, hi = lo or 0, hi or 0
    base = base.withColumn("b", F.col("b") - F.lit(lo))       # from 0 on: negative and positive buckets would never meet in one
    hi -= lo
    groups = [max(least, n // group_rows)]
    map_ddl, state_ddl = f"{key} {ddl}, b long, {_MAP_DDL}", f"{key} {ddl}, b long, {_STATE_DDL}"
    maps = [written(dealt(base, "b", groups[0]).applyInArrow(_summary(field, interval), map_ddl), "throttle-0")]
    groups.append(max(least, maps[0].count() // group_rows))
    while hi >= fan:
        hi //= fan
        maps.append(written(dealt(above(maps[-1]), "up", groups[-1]).applyInArrow(_composed(field), map_ddl), f"throttle-{len(maps)}"))
    states = maps[-1].limit(0).select(key, F.lit(0).cast("long").alias("up"), F.lit(0).cast("long").alias("last_us"), F.lit(0).cast("long").alias("emitted"),
                                      F.lit(0).cast("long").alias("since"), F.lit(True).alias("is_end"))
    for m in reversed(maps):
        states = dealt(above(m), "up", groups[-1]).cogroup(dealt(states, "up", groups[-1])).applyInArrow(_told(field), state_ddl)
        states = states.withColumnRenamed("b", "up")
    out = dealt(base, "b", groups[0]).cogroup(dealt(states.withColumnRenamed("up", "b"), "b", groups[0])).applyInArrow(
        _emissions(field, interval), f"{key} {ddl}, emit_idx long, row long, t long, is_tail boolean, n_rows long")
    return out.select(key, "emit_idx", F.col("row").alias(row), F.col("t").alias(t), "is_tail", "n_rows")
