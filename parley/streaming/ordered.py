"""Order-dependent rules over streams whose rows come late and out of order.

A rule sees the rows of a key in event order. Rows newer than the watermark wait in a reorder buffer in the state and
are released, sorted, when the watermark passes them; older rows can no longer come (Spark drops and counts them).
With a delay of zero the input is taken to be in order, and rows are released at once.

Keys are dealt to ``BUCKETS`` groups by hash, since what Spark and pandas do for a group costs far more than a rule does for its rows. A
group's state is two packed tables, the rows that wait and the state of its keys, and a rule takes all its keys in one
step. The timer of a group is the earliest of its waiting rows and its keys' own pending work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.segments import AGENT_END, AGENT_START, USER_END
from parley.params import Params

FAR_US = 4_102_444_800_000_000   # time of the sentinel rows (2100-01-01)
END_US = 4_000_000_000_000_000   # "when the stream ends": only a sentinel moves the watermark there
# Event time is shifted on, since Spark's watermark starts at 1970 and takes what is not after it as late; with this, times from 1939 on may come.
SHIFT_US = 1_000_000_000_000_000
SENTINEL = "_sentinel"
BUCKETS = 256           # a slice of the runner has some 5 million rows, so a group has some 20,000 of them
NULLS = "_nulls"        # bit k: the k-th key is null (it travels as 0: pandas makes nullable numbers floats, which lose digits)


def bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def pack(table: pd.DataFrame) -> bytes | None:
    if not len(table):
        return None
    batch, out = pa.RecordBatch.from_pandas(table, preserve_index=False, nthreads=1), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack(body: bytes | None) -> list[pd.DataFrame]:
    return [] if body is None else [pa.ipc.open_stream(body).read_pandas()]


def stacked(tables: list[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    some = [t[columns] for t in tables if len(t)]
    return pd.concat(some, ignore_index=True) if some else pd.DataFrame(columns=columns)


def groups(keys: pd.DataFrame) -> np.ndarray:
    """A number for each row that equal keys share, nulls among them."""
    return keys.groupby(list(keys.columns), dropna=False, sort=False).ngroup().to_numpy()


class Rule:
    """What the released rows of many keys do to their states. ``step`` gets the rows' key numbers, times, ids and kinds in
    event order, key by key, and the state as columns, one entry a key (rising key numbers ``g``); ``mark`` is the watermark. It gives
    the output's columns, ``g`` first, and the new state. In a state, the time ``NEVER`` stands for nothing."""

    keys: list[str]
    state: list[str]      # its columns, whole numbers
    out: list[str]        # without the keys
    kinds: dict[str, int]

    def step(self, g, t, ids, kind, s: dict[str, np.ndarray], mark: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        raise NotImplementedError

    def due(self, s: dict[str, np.ndarray]) -> np.ndarray:
        """Event times at which pending work is done if nothing else comes; ``NEVER`` without such work."""
        return np.full(len(s["g"]), NEVER)


NEVER = np.iinfo(np.int64).max


def _lasts(g: np.ndarray) -> np.ndarray:
    """Which entries are the last of their key."""
    return np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)


def _newest(s: dict[str, np.ndarray], new: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The states with those of the keys in ``new`` replaced."""
    stay = ~np.isin(s["g"], new["g"])
    both = {c: np.concatenate([s[c][stay], new[c]]) for c in new}
    order = np.argsort(both["g"], kind="stable")
    return {c: v[order] for c, v in both.items()}


class Segments(Rule):
    """The last edge; an END after a START gives a segment."""

    keys, state, kinds = ["session_id", "party"], ["kind", "t", "id"], {"start": 1, "end": 2}
    out = ["start_event_id", "end_event_id", "start_us", "end_us"]

    def step(self, g, t, ids, kind, s, mark):
        rows = {"g": g, "kind": kind, "t": t, "id": ids}
        all_ = {c: np.concatenate([s[c], rows[c]]) for c in rows}          # a key's state is the edge before its rows
        order = np.argsort(all_["g"], kind="stable")
        all_ = {c: v[order] for c, v in all_.items()}
        last = _lasts(all_["g"])
        end = np.flatnonzero(~last[:-1] & (all_["kind"][:-1] == 1) & (all_["kind"][1:] == 2)) + 1
        got = {"g": all_["g"][end], "start_event_id": all_["id"][end - 1], "end_event_id": all_["id"][end],
               "start_us": all_["t"][end - 1], "end_us": all_["t"][end]}
        return got, {c: v[last] for c, v in all_.items()}


class Debounce(Rule):
    """The pending END; any START or END up to its time plus the delay cancels it."""

    keys, state, kinds = ["session_id"], ["t", "id"], {USER_END: 1}
    out = ["end_event_id", "end_us", "fire_us"]

    def __init__(self, delay_us: int):
        self.delay = delay_us

    def step(self, g, t, ids, kind, s, mark):
        all_ = {c: np.concatenate(v) for c, v in {"g": (s["g"], g), "t": (s["t"], t), "id": (s["id"], ids),
                                                  "kind": (np.ones(len(s["g"]), np.int64), kind)}.items()}
        order = np.argsort(all_["g"], kind="stable")
        all_ = {c: v[order] for c, v in all_.items()}
        last, ended = _lasts(all_["g"]), all_["kind"] == 1
        until = np.append(all_["t"][1:], 0)                                # of the next row, or the watermark
        fire = ended & np.where(last, all_["t"] + self.delay <= mark, until > all_["t"] + self.delay)
        got = {"g": all_["g"][fire], "end_event_id": all_["id"][fire], "end_us": all_["t"][fire], "fire_us": all_["t"][fire] + self.delay}
        wait = last & ended & ~fire
        return got, {c: all_[c][wait] for c in ("g", "t", "id")}

    def due(self, s):
        return s["t"] + self.delay


class AgentState(Rule):
    """The newest request (``c``), not yet known to be kept, and the last kept state (``o``), waiting for its end."""

    keys, kinds = ["session_id"], {USER_END: 1, AGENT_START: 2, AGENT_END: 3}
    state = ["c_state", "c_t", "c_id", "c_eff", "o_state", "o_t", "o_id", "o_eff", "last"]
    out = ["event_id", "state", "t_us", "eff_us", "end_us"]
    names = np.array(["initializing", "thinking", "speaking", "listening"], object)

    def __init__(self, p: Params, gap_us: int | None):
        self.delays = np.array([0, p.us(p.thinking_delay), 0, 0], np.int64)
        self.gap = gap_us

    def step(self, g, t, ids, kind, s, mark):
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]) & ~np.isin(g, s["g"])) if len(g) else np.zeros(0, int)
        asked = np.flatnonzero(kind > 0)
        was = s["o_t"] != NEVER
        parts = [                                                          # g, state, t, id, eff
            tuple(s[c][was] for c in ("g", "o_state", "o_t", "o_id", "o_eff")),
            tuple(s[c] for c in ("g", "c_state", "c_t", "c_id", "c_eff")),
            (g[first], np.zeros(len(first), np.int64), t[first], np.full(len(first), -1), t[first]),
            (g[asked], kind[asked], t[asked], ids[asked], t[asked] + self.delays[kind[asked]])]
        rg, rstate, rt, rid, reff = (np.concatenate(c).astype(np.int64) for c in zip(*parts))
        kept = np.arange(len(rg)) < was.sum()
        order = np.argsort(rg, kind="stable")                              # within a key: kept one, request, rows
        rg, rstate, rt, rid, reff, kept = (c[order] for c in (rg, rstate, rt, rid, reff, kept))
        last = _lasts(rg)
        kept[:-1] |= ~last[:-1] & (rt[1:] >= reff[:-1])
        keys = rg[last]
        seen = np.full(len(keys), 0, np.int64)                             # time of a key's last row
        seen[np.searchsorted(keys, s["g"])] = s["last"]
        if len(g):
            seen[np.searchsorted(keys, g[_lasts(g)])] = t[_lasts(g)]
        over = self._over(seen) <= mark
        gone = over[np.searchsorted(keys, rg)]
        kept |= last & gone                                                # nothing comes after the newest request: it is kept
        k = np.flatnonzero(kept)
        kept_last = _lasts(rg[k])
        emit = ~kept_last | gone[k]
        end = np.append(reff[k][1:], 0)
        got = {"g": rg[k][emit], "event_id": rid[k][emit], "state": self.names[rstate[k][emit]], "t_us": rt[k][emit], "eff_us": reff[k][emit],
               "end_us": pd.array(np.where(kept_last, 0, end)[emit], "Int64")}
        got["end_us"][kept_last[emit]] = pd.NA
        c, o = np.flatnonzero(last & ~gone), k[kept_last & ~gone[k]]
        new = {"g": rg[c], "c_state": rstate[c], "c_t": rt[c], "c_id": rid[c], "c_eff": reff[c], "last": seen[~over]}
        at = np.searchsorted(new["g"], rg[o])
        for name, v in (("o_state", rstate), ("o_t", rt), ("o_id", rid), ("o_eff", reff)):
            new[name] = np.full(len(c), NEVER if name == "o_t" else 0)
            new[name][at] = v[o]
        return got, new

    def _over(self, last: np.ndarray) -> np.ndarray:
        return np.full(len(last), END_US) if self.gap is None else last + self.gap

    def due(self, s):
        return self._over(s["last"])


def reordered(rule: Rule, in_order: bool) -> Callable:
    """The function of ``applyInPandasWithState`` that runs ``rule`` behind a reorder buffer, for a bucket of keys (columns of the
    frames) or for the one key that the group is."""
    keys = [*rule.keys, NULLS]
    cols = [*keys, "t_us", "event_id", "kind"]

    def run(key, frames, state) -> Iterator[pd.DataFrame]:
        fresh = []
        for pdf in frames:
            if len(pdf):
                fresh.append(pdf if NULLS in pdf else pdf.assign(**dict(zip(rule.keys, key)), **{NULLS: 0}))
                fresh[-1] = fresh[-1][fresh[-1]["t_us"].notna()].astype({"t_us": "int64", "event_id": "int64"})
                fresh[-1]["kind"] = fresh[-1]["kind"].map(rule.kinds).fillna(0).astype("int64")
        held = state.get if state.exists else (None, None)
        rows, states = stacked([*unpack(held[0]), *fresh], cols), stacked(unpack(held[1]), [*keys, *rule.state])
        mark_ms = state.getCurrentWatermarkMs()
        mark = mark_ms * 1000 - SHIFT_US
        ready = np.full(len(rows), True) if in_order else rows["t_us"].to_numpy() <= mark
        rows, wait = rows[ready], rows[~ready]
        number = groups(pd.concat([x[keys] for x in (rows, states) if len(x)], ignore_index=True)) if len(rows) + len(states) else np.zeros(0, int)
        g, sg = number[:len(rows)], number[len(rows):]
        named = np.full(number.max(initial=-1) + 1, 0)                     # a place in both tables for each number
        named[number] = np.arange(len(number))
        t, ids, kind = (rows[c].to_numpy(np.int64) for c in ("t_us", "event_id", "kind"))
        order = np.lexsort((ids, t, g))
        by_key = np.argsort(sg)
        old = {"g": sg[by_key], **{c: states[c].to_numpy(np.int64)[by_key] for c in rule.state}}
        got, new = rule.step(g[order], t[order], ids[order], kind[order], old, mark)

        def of(g: np.ndarray) -> dict[str, np.ndarray]:
            at = named[g]
            a, b = at < len(rows), at >= len(rows)
            out = {}
            for c in keys:
                x, y = rows[c].to_numpy(), states[c].to_numpy()
                out[c] = v = np.empty(len(g), x.dtype if a.any() else y.dtype)
                v[a], v[b] = x[at[a]], y[at[b] - len(rows)]
            return out

        timers = [wait["t_us"].min()] if len(wait) else []
        if len(new["g"]) and (due := int(rule.due(new).min())) != NEVER:
            timers.append(due)
        if not len(wait) and not len(new["g"]):
            if state.exists:
                state.remove()
        else:
            state.update((pack(wait), pack(pd.DataFrame({**of(new["g"]), **{c: new[c] for c in rule.state}}))))
            if timers:
                state.setTimeoutTimestamp(max((int(min(timers)) + SHIFT_US) // 1000 + 1, mark_ms + 1))
        if len(got["g"]):
            whose = of(got["g"])
            out = {c: pd.Series(whose[c]).mask((whose[NULLS] >> k & 1) == 1, None) if whose[c].dtype == object
                   else pd.arrays.IntegerArray(whose[c].astype(np.int64), (whose[NULLS] >> k & 1) == 1) for k, c in enumerate(rule.keys)}
            yield pd.DataFrame({**out, **{c: got[c] for c in rule.out}})
    return run


def watermarked(stream: DataFrame, delay_us: int = 0) -> DataFrame:
    """``stream`` with its event time ``ts`` and watermark; sentinel rows move the watermark and go no further. (The
    condition names ``ts``, so that the optimizer doesn't drop them before the watermark is taken.)"""
    out = stream.withColumn("ts", F.timestamp_micros(F.col("t_us") + SHIFT_US)).withWatermark("ts", f"{delay_us // 1000} milliseconds")
    if SENTINEL in stream.columns:
        out = out.where(~(F.coalesce(F.col(SENTINEL), F.lit(False)) & (F.unix_micros("ts") >= FAR_US + SHIFT_US))).drop(SENTINEL)
    return out


def apply_rule(stream: DataFrame, rule: Rule, schema: str, delay_us: int) -> DataFrame:
    """``stream`` has the rule's keys, t_us, event_id, kind and ts (``watermarked``)."""
    nulls = sum((F.when(F.col(c).isNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(rule.keys)), F.lit(0))
    numbers = {f.name for f in stream.schema if f.dataType.typeName() != "string"}
    keys = [F.coalesce(c, F.lit(0)).alias(c) if c in numbers else F.col(c) for c in rule.keys]
    return stream.select(bucket(rule.keys).alias("_bucket"), *keys, nulls.alias(NULLS), "t_us", "event_id", "kind", "ts") \
        .groupBy("_bucket").applyInPandasWithState(reordered(rule, delay_us <= 0), schema, "waiting binary, kept binary", "append", "EventTimeTimeout")
