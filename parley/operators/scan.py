"""Ordered scans per session that do not put a whole session into one task.

A window ``partitionBy(session).orderBy(t)`` sends every row of a session to one
task; a session holding a third of the data would then run in one task. Here the
order is cut into buckets (``floor(order_key / bucket_width)``):

1. the per-row scan runs in a window partitioned by (session, bucket): many tasks;
2. every bucket is folded into one summary row (partial aggregation, no extra
   exchange since the window output is already partitioned by (session, bucket));
3. the summaries, one row per bucket, are scanned per session (small);
4. the carried value is joined back on (session, bucket) and combined.

Supported scans are associative: running sum / max / min / last non-null, and
previous / next row values. All are exact (integer sums stay integers).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "_bkt"


@dataclass(frozen=True)
class Scan:
    kind: str  # sum | max | min | last | prev | next
    expr: Column


def run_sum(e: Column) -> Scan:
    return Scan("sum", e)


def run_max(e: Column) -> Scan:
    return Scan("max", e)


def run_min(e: Column) -> Scan:
    return Scan("min", e)


def run_last(e: Column) -> Scan:
    """Last non-null value up to and including the row (as-of / carry forward)."""
    return Scan("last", e)


def prev(e: Column) -> Scan:
    """Value of the previous row (null for the first row of the session)."""
    return Scan("prev", e)


def next_(e: Column) -> Scan:
    """Value of the next row (null for the last row of the session)."""
    return Scan("next", e)


def first_after(e: Column) -> Scan:
    """First non-null value among the rows after this one (the next matching row)."""
    return Scan("first_after", e)


def scan(
    df: DataFrame,
    key: list[str],
    order: list[str],
    specs: dict[str, Scan],
    bucket_width: int,
    keep_bucket: bool = False,
    bucket: Column | None = None,
) -> DataFrame:
    """Add one column per spec, computed in (key, order) order across the whole session.

    ``order[0]`` must be an integral column; buckets are ``order[0] div bucket_width``.
    If ``df`` still carries the bucket column of an earlier scan with the same key and
    order (``keep_bucket=True`` there), it is reused: the rows are then already
    partitioned by (key, bucket) and the window needs no new exchange.
    ``bucket`` overrides the bucket expression; it must be non-decreasing in the
    (key, order) order (e.g. a lexicographic combination of the first order columns).
    """
    if not specs:
        return df
    # Non-nullable copies of the key (value, is-null) and of the bucket: partitioning,
    # window and join all use them, so no isnotnull filters are inferred on one branch
    # only, both branches share one exchange, and null keys still form their own group.
    kn = [f"_kn{i}" for i in range(len(key))]
    kz = [f"_kz{i}" for i in range(len(key))]
    part = [*kn, *kz]
    reuse = _B in df.columns and all(c in df.columns for c in part)
    if reuse:
        bexpr = []
    else:
        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

        def nn(k: str) -> Column:
            zero = F.lit("") if types[k] == "string" else F.lit(0).cast(types[k])
            return F.coalesce(F.col(k), zero)

        bexpr = [nn(k).alias(c) for k, c in zip(key, kn)] + [F.isnull(k).alias(c) for k, c in zip(key, kz)]
        b = F.expr(f"`{order[0]}` div {int(bucket_width)}") if bucket is None else bucket
        bexpr.append(F.coalesce(b, F.lit(0)).cast("bigint").alias(_B))
    ocols = [F.col(c) for c in order]
    w_in = Window.partitionBy(*part, _B).orderBy(*ocols)
    w_run = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    inner = {"_is_last": F.lead(F.lit(1)).over(w_in).isNull()}
    summary_cols = []
    vcols = []
    for name, s in specs.items():
        v = f"_v_{name}"
        vcols.append(s.expr.alias(v))
        if s.kind == "sum":
            inner[name] = F.sum(v).over(w_run)
        elif s.kind == "max":
            inner[name] = F.max(v).over(w_run)
        elif s.kind == "min":
            inner[name] = F.min(v).over(w_run)
        elif s.kind == "last":
            inner[name] = F.last(v, ignorenulls=True).over(w_run)
        elif s.kind == "prev":
            inner[name] = F.lag(v).over(w_in)
            inner[f"_first_{name}"] = F.lag(F.lit(1)).over(w_in).isNull()
        elif s.kind == "next":
            inner[name] = F.lead(v).over(w_in)
            inner[f"_last_{name}"] = F.lead(F.lit(1)).over(w_in).isNull()
            inner[f"_head_{name}"] = F.first(v).over(w_run)
        elif s.kind == "first_after":
            inner[name] = F.first(v, ignorenulls=True).over(w_in.rowsBetween(1, Window.unboundedFollowing))
            inner[f"_head_{name}"] = F.first(v, ignorenulls=True).over(w_run)
        else:
            raise ValueError(s.kind)
        # bucket summary = the running value at the bucket's last row
        if s.kind in ("sum", "max", "min", "last"):
            summary_cols.append(F.col(f"_i_{name}").alias(f"_a_{name}"))
        elif s.kind == "prev":
            summary_cols.append(F.col(v).alias(f"_a_{name}"))
        else:  # next, first_after: the bucket's head value
            summary_cols.append(F.col(f"_i__head_{name}").alias(f"_a_{name}"))
    data = df.select("*", *bexpr, *vcols)

    windowed = data.select("*", *[c.alias(f"_i_{n}") for n, c in inner.items()])
    # One summary row per (session, bucket), read off the windowed rows: both branches
    # share the same exchange (reused), so the input is computed once.
    summary = windowed.where(F.col("_i__is_last")).select(*part, _B, *summary_cols)
    wb = Window.partitionBy(*part).orderBy(_B)
    wb_prev = wb.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for name, s in specs.items():
        a = F.col(f"_a_{name}")
        if s.kind == "sum":
            c = F.sum(a).over(wb_prev)
        elif s.kind == "max":
            c = F.max(a).over(wb_prev)
        elif s.kind == "min":
            c = F.min(a).over(wb_prev)
        elif s.kind == "last":
            c = F.last(a, ignorenulls=True).over(wb_prev)
        elif s.kind == "prev":
            c = F.lag(a).over(wb)
        elif s.kind == "first_after":
            c = F.first(a, ignorenulls=True).over(wb.rowsBetween(1, Window.unboundedFollowing))
        else:  # next
            c = F.lead(a).over(wb)
        carry_cols.append(c.alias(f"_c_{name}"))
    carries = summary.select(*[F.col(c).alias(f"_c{c}") for c in part], F.col(_B).alias("_cb"), *carry_cols)
    cond = [F.col(c) == F.col(f"_c{c}") for c in part] + [F.col(_B) == F.col("_cb")]
    out = windowed.join(carries, on=cond, how="left")
    final = []
    for name, s in specs.items():
        i, c = F.col(f"_i_{name}"), F.col(f"_c_{name}")
        if s.kind == "sum":
            v = F.coalesce(c, F.lit(0)) + i
        elif s.kind == "max":
            v = F.when(c.isNull(), i).when(i.isNull(), c).otherwise(F.greatest(c, i))
        elif s.kind == "min":
            v = F.when(c.isNull(), i).when(i.isNull(), c).otherwise(F.least(c, i))
        elif s.kind == "last":
            v = F.coalesce(i, c)
        elif s.kind == "prev":
            v = F.when(F.col(f"_i__first_{name}"), c).otherwise(i)
        elif s.kind == "first_after":
            v = F.coalesce(i, c)
        else:
            v = F.when(F.col(f"_i__last_{name}"), c).otherwise(i)
        final.append(v.alias(name))
    internal = {_B, *part}
    keep = [c for c in df.columns if c not in specs and c not in internal]
    return out.select(*keep, *final, *([*part, _B] if keep_bucket else []))


def asof(
    probes: DataFrame,
    markers: DataFrame,
    key: list[str],
    probe_t: str,
    marker_t: str,
    marker_order: str,
    out: str,
    bucket_width: int,
    inclusive: bool = True,
) -> DataFrame:
    """For every probe row, the last marker row (as struct ``out``) of the same key with
    ``marker_t <= probe_t`` (``<`` when not inclusive); null if none.

    Sort-based as-of join: both sides are unioned, ordered by time and the marker
    struct is carried forward with a bucketed last-non-null scan. Markers at equal
    time are ordered by ``marker_order``.
    """
    mcols = [c for c in markers.columns]
    mstruct = F.struct(*[F.col(c) for c in mcols])
    mtype = markers.select(mstruct.alias("m")).schema["m"].dataType
    pstruct = F.struct(*[F.col(c) for c in probes.columns])
    ptype = probes.select(pstruct.alias("p")).schema["p"].dataType
    probe_prio = 1 if inclusive else 0
    a = probes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.col(probe_t).cast("bigint").alias("_t"),
        F.lit(probe_prio).alias("_prio"),
        F.lit(None).cast("bigint").alias("_o"),
        pstruct.alias("_p"),
        F.lit(None).cast(mtype).alias("_m"),
    )
    b = markers.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.col(marker_t).cast("bigint").alias("_t"),
        F.lit(1 - probe_prio).alias("_prio"),
        F.col(marker_order).cast("bigint").alias("_o"),
        F.lit(None).cast(ptype).alias("_p"),
        mstruct.alias("_m"),
    )
    kcols = [f"_k{i}" for i in range(len(key))]
    s = scan(a.unionByName(b), kcols, ["_t", "_prio", "_o"], {"_last": run_last(F.col("_m"))}, bucket_width)
    return s.where(F.col("_p").isNotNull()).select("_p.*", F.col("_last").alias(out))


def asof_many(
    probes: DataFrame,
    key: list[str],
    probe_t: str,
    markers: dict[str, tuple[DataFrame, str, str]],
    bucket_width: int,
    inclusive: bool = True,
) -> DataFrame:
    """Several as-of look-ups in one pass: ``markers`` maps an output name to
    (marker table, time column, tie-break column). One union, one scan."""
    pstruct = F.struct(*[F.col(c) for c in probes.columns])
    ptype = probes.select(pstruct.alias("p")).schema["p"].dataType
    mtypes = {}
    for name, (m, _, _) in markers.items():
        mtypes[name] = m.select(F.struct(*[F.col(c) for c in m.columns]).alias("m")).schema["m"].dataType
    probe_prio = 1 if inclusive else 0
    kc = [f"_k{i}" for i in range(len(key))]

    def nulls(except_name: str | None):
        return [F.lit(None).cast(t).alias(f"_m_{n}") if n != except_name
                else F.struct(*[F.col(c) for c in markers[n][0].columns]).alias(f"_m_{n}")
                for n, t in mtypes.items()]

    parts = [probes.select(*[F.col(k).alias(c) for k, c in zip(key, kc)], F.col(probe_t).cast("bigint").alias("_t"),
                           F.lit(probe_prio).alias("_prio"), F.lit(None).cast("bigint").alias("_o"),
                           pstruct.alias("_p"), *nulls(None))]
    for name, (m, mt, mo) in markers.items():
        parts.append(m.select(*[F.col(k).alias(c) for k, c in zip(key, kc)], F.col(mt).cast("bigint").alias("_t"),
                              F.lit(1 - probe_prio).alias("_prio"), F.col(mo).cast("bigint").alias("_o"),
                              F.lit(None).cast(ptype).alias("_p"), *nulls(name)))
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    specs = {f"_l_{n}": run_last(F.col(f"_m_{n}")) for n in markers}
    s = scan(u, kc, ["_t", "_prio", "_o"], specs, bucket_width)
    return s.where(F.col("_p").isNotNull()).select("_p.*", *[F.col(f"_l_{n}").alias(n) for n in markers])
