"""Segments, barge-in, debounce, interrupts and state timeline against plain-Python loops."""

import random

from pyspark.sql import functions as F

from conftest import ev_rows
from parley.operators import segments as seg
from parley.operators import turns
from parley.params import Params

P = Params(unit_us=1, bucket_us=25)  # tiny buckets: every scan crosses bucket borders
US, UE, AS, AE, VD = ("user_started_speaking", "user_stopped_speaking", "agent_started_speaking",
                      "agent_stopped_speaking", "vad_inference_done")


def _random_events(spark, seed=1, n=400, sessions=4):
    rnd = random.Random(seed)
    rows, t = [], {s: 0 for s in range(sessions)}
    for i in range(n):
        s = rnd.randrange(sessions)
        t[s] += rnd.randint(1, 9)
        rows.append((s, i, t[s], rnd.choice([US, UE, AS, AE, VD]), float(rnd.randint(0, 120))))
    return rows, ev_rows(spark, rows)


def _loop_segments(rows):
    out, last = [], {}
    for s, i, t, et, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if et not in (US, UE, AS, AE):
            continue
        party = "user" if et.startswith("user") else "agent"
        edge = "start" if et.endswith("started_speaking") else "end"
        lp = last.get((s, party))
        if edge == "end" and lp and lp[0] == "start":
            out.append((s, party, lp[2], i, lp[1], t))
        last[(s, party)] = (edge, t, i)
    return sorted(out)


def test_segments_loop(spark):
    rows, ev = _random_events(spark)
    got = sorted(tuple(r) for r in seg.speech_segments(ev, P).collect())
    assert got == _loop_segments(rows)


def test_restart_and_orphan(spark):
    ev = ev_rows(spark, [(1, 1, 10, US), (1, 2, 20, US), (1, 3, 30, UE), (1, 4, 40, UE)])
    out = seg.speech_segments(ev, P, with_orphans=True).orderBy("end_us").collect()
    assert [(r.start_event_id, r.end_event_id, r.status) for r in out] == [(2, 3, "segment"), (None, 4, "orphan")]


def test_barge_in_brute_force(spark):
    rows, ev = _random_events(spark, seed=5, n=500, sessions=3)
    segs = _loop_segments(rows)
    want = sorted((u[0], u[2], a[2], max(u[4], a[4]), min(u[5], a[5]), min(u[5], a[5]) - max(u[4], a[4]))
                  for u in segs for a in segs
                  if u[0] == a[0] and u[1] == "user" and a[1] == "agent" and u[4] < a[5] and a[4] < u[5])
    got = sorted(tuple(r) for r in seg.barge_in_overlap(seg.speech_segments(ev, P), P).collect())
    assert got == want and len(want) > 0


def test_debounce_boundary(spark):
    # delay 5: END at 10 with next edge exactly at 15 is cancelled; END at 20 with next at 26 fires
    p = P.with_(final_transcript_timeout=5.0)
    ev = ev_rows(spark, [(1, 1, 10, UE), (1, 2, 15, US), (1, 3, 20, UE), (1, 4, 26, US), (1, 5, 30, UE)])
    got = sorted((r.end_event_id, r.fire_us) for r in turns.endpoint_debounce(ev, p).collect())
    assert got == [(3, 25), (5, 35)]


def test_debounce_loop(spark):
    rows, ev = _random_events(spark, seed=9, n=600)
    d = 6
    want, pend = [], {}
    for s, i, t, et, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if et not in (US, UE):
            continue
        if s in pend and t > pend[s][1] + d:
            want.append((s, pend[s][0], pend[s][1], pend[s][1] + d))
        pend.pop(s, None)
        if et == UE:
            pend[s] = (i, t)
    want += [(s, i, t, t + d) for s, (i, t) in pend.items()]
    got = sorted(tuple(r) for r in turns.endpoint_debounce(ev, P.with_(final_transcript_timeout=6.0)).collect())
    assert got == sorted(want)


def test_interrupt_threshold_inclusive(spark):
    # speech_duration exactly 0.5 triggers; 0.49 does not
    ev = ev_rows(spark, [(1, 1, 10, AS), (1, 2, 11, VD, 49.0), (1, 4, 12, VD, 50.0), (1, 5, 13, AE)])
    got = [(r.event_id, r.playing_speech_id) for r in turns.interrupt_trigger(ev, P).collect()]
    assert got == [(4, 1)]
    m = turns.interrupt_match(ev, P).collect()
    assert [(r.speech_id, r.interrupt_event_id) for r in m] == [(1, 4)]


def test_non_interruptible_speech_is_not_interrupted(spark):
    # agent START event id 3 -> 3 % 3 == 0 -> not interruptible
    ev = ev_rows(spark, [(1, 3, 10, AS), (1, 4, 11, VD, 90.0), (1, 5, 13, AE)])
    assert turns.interrupt_match(ev, P).count() == 0
    si = turns.should_interrupt(ev, P).collect()
    assert [r.should_interrupt for r in si] == [False]


def test_agent_state_loop(spark):
    rows, ev = _random_events(spark, seed=11, n=500)
    p = P.with_(thinking_delay=4.0)
    names = {UE: ("thinking", 4), AS: ("speaking", 0), AE: ("listening", 0)}
    reqs = {}
    for s, i, t, et, _ in rows:
        reqs.setdefault(s, [])
        if et in names:
            reqs[s].append((t, i, names[et][0], t + names[et][1]))
    for s in reqs:
        t0 = min(r[2] for r in rows if r[0] == s)
        reqs[s].append((t0, -1, "initializing", t0))
    want = []
    for s, rs in reqs.items():
        rs.sort()
        kept = [r for k, r in enumerate(rs) if k + 1 == len(rs) or rs[k + 1][0] >= r[3]]
        for k, (t, i, st, eff) in enumerate(kept):
            want.append((s, i, st, t, eff, kept[k + 1][3] if k + 1 < len(kept) else None))
    got = sorted(tuple(r) for r in turns.agent_state_timeline(ev, p).collect())
    assert got == sorted(want)
