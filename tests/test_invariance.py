"""Shuffle invariance (1 vs 8 partitions, reversed input order) and property tests."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from parley.operators.scan import prev, run_last, run_max, run_sum, scan

KEYS = ["barge_in_summary", "playout_queue", "eou_metrics", "chat_context_snapshot"]


def test_results_do_not_depend_on_partitioning(spark):
    qs = E.queries()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = {}
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            res[n] = {k: sorted(map(tuple, qs[k](spark, SF_SMALL).collect())) for k in KEYS}
        assert res["1"] == res["8"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_input_order_does_not_matter(spark):
    from parley.operators import segments as seg
    from parley.params import EVENTS
    from parley.sources import agent_events

    ev = agent_events(spark, SF_SMALL)
    a = sorted(map(tuple, seg.barge_in_summary(ev, EVENTS).collect()))
    b = sorted(map(tuple, seg.barge_in_summary(ev.orderBy(F.col("event_id").desc()).repartition(3), EVENTS).collect()))
    assert a == b


rows = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.one_of(st.none(), st.integers(-9, 9))),
                min_size=1, max_size=40)


@settings(max_examples=5, deadline=None)
@given(rows=rows, width=st.integers(1, 30))
def test_scan_property(spark, rows, width):
    data = [(s, i, t, v) for i, (s, t, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "s long, id long, t long, v long")
    out = scan(df, ["s"], ["t", "id"], {"sm": run_sum(F.coalesce("v", F.lit(0))), "mx": run_max(F.col("v")),
                                        "ls": run_last(F.col("v")), "pv": prev(F.col("v"))}, width)
    got = {r.id: (r.sm, r.mx, r.ls, r.pv) for r in out.collect()}
    for s in {r[0] for r in data}:
        seq = sorted((r for r in data if r[0] == s), key=lambda r: (r[2], r[1]))
        sm, mx, ls, pv = 0, None, None, None
        for k, (_, i, _, v) in enumerate(seq):
            sm += v or 0
            mx = v if mx is None else (mx if v is None else max(mx, v))
            ls = v if v is not None else ls
            assert got[i] == (sm, mx, ls, seq[k - 1][3] if k else None)
