"""Playout queue, buffer cap, messages, chunk streams and throttle."""

import random

from pyspark.sql import functions as F

from parley.operators import playout as po
from parley.operators import text as tx
from parley.params import DAY_US, Params

P = Params(bucket_us=3 * DAY_US)
SP = "speech_id long, session_id long, t_us long, kind string, allow_interruptions boolean, add_to_chat_ctx boolean, text string"
FR = "speech_id long, frame_idx int, samples_per_channel long, sample_rate int, flag string, status string"
CH = "session_id long, turn long, role string, text string, audio array<float>"
CK = "stream_id string, seq int, t_us long, delta string"


def test_lindley_queue_loop(spark):
    rnd = random.Random(2)
    sp, fr, n = [], [], 0
    for sid in range(300):
        s = rnd.randrange(5)
        sp.append((sid, s, rnd.randint(0, 60) * DAY_US, "speech", True, True, "x"))
        for k in range(rnd.randint(0, 3)):
            fr.append((sid, k + 1, rnd.randint(1, 4), 16000, "N", "O"))
    got = {r.speech_id: (r.start_us, r.end_us) for r in po.playout_queue(
        spark.createDataFrame(sp, SP), spark.createDataFrame(fr, FR), P).collect()}
    dur = {}
    for sid, _, q, *_ in fr:
        dur[sid] = dur.get(sid, 0) + q * DAY_US
    waited = 0
    for s in range(5):
        end = None
        for sid, _, t, *_ in sorted((x for x in sp if x[1] == s), key=lambda x: (x[2], x[0])):
            start = t if end is None else max(t, end)
            waited += start > t
            end = start + dur.get(sid, 0)
            assert got[sid] == (start, end)
    assert waited > 0


def test_buffer_cap_equality_kept(spark):
    fr = spark.createDataFrame([(1, 1, 40, 16000, "N", "O"), (1, 2, 60, 16000, "N", "O"), (1, 3, 1, 16000, "N", "O"),
                                (2, 1, 101, 16000, "N", "O"), (2, 2, 1, 16000, "N", "O")], FR)
    kept = sorted((r.speech_id, r.frame_idx) for r in po.audio_buffer_cap(fr, 100).collect())
    assert kept == [(1, 1), (1, 2)]  # cum == cap is kept; the rest of the utterance is dropped
    ov = {r.speech_id: r.first_overflow_idx for r in po.buffer_overflow_flag(fr, 100).collect()}
    assert ov == {1: 3, 2: 1}


def test_interrupted_suffix(spark):
    sp = spark.createDataFrame([(1, 1, 0, "reply", True, True, "hi"), (2, 1, 0, "reply", True, False, "no ctx")], SP)
    fr = spark.createDataFrame([(1, 1, 2, 16000, "A", "O"), (1, 2, 2, 16000, "R", "F"), (2, 1, 1, 16000, "A", "O")], FR)
    out = po.interrupted_suffix(sp, fr).collect()
    assert [(r.speech_id, r.committed_text, r.event) for r in out] == [(1, "hi...", "agent_speech_interrupted")]


def test_validate_message(spark):
    ch = spark.createDataFrame([(1, 0, "user", "a", None), (1, 1, "user", "a", [0.1]), (1, 2, "user", None, None),
                                (1, 3, "robot", "x", None)], CH)
    assert [r.status for r in tx.validate_message(ch).orderBy("turn").collect()] == ["ok", "both", "empty", "bad_role"]


def test_ends_with_punct_and_words(spark):
    ch = spark.createDataFrame([(1, 0, "user", "Hi there.", None), (1, 1, "user", "", None),
                                (1, 2, "user", None, None), (1, 3, "user", " a  b\nc ", None)], CH)
    assert [r.ends_with_punct for r in tx.ends_with_punct_q(ch).orderBy("turn").collect()] == [True, False, False, False]
    assert [r.n_words for r in tx.word_count_q(ch).orderBy("turn").collect()] == [2, 0, 0, 3]


def _loop_throttle(items, iv):
    out, last, buf = [], None, ""
    for seq, t, d in items:
        buf += d
        if last is None or t - last >= iv:
            out.append((seq, t, False, buf))
            last, buf = t, ""
    out.append((items[-1][0], items[-1][1], True, buf))
    return out


def test_throttle_loop_and_tail(spark):
    rnd = random.Random(4)
    rows = []
    for s in range(20):
        t = 0
        for k in range(rnd.randint(1, 30)):
            t += rnd.choice([10, 50, 100, 200, 250])
            rows.append((f"s{s}", k + 1, t, f"w{k} "))
    got = {}
    for r in tx.throttle_stream(spark.createDataFrame(rows, CK), P, interval_us=200).collect():
        got.setdefault(r.stream_id, []).append((r.emit_idx, r.seq, r.t_us, r.is_tail, r.delta))
    for s in {r[0] for r in rows}:
        items = [(r[1], r[2], r[3]) for r in rows if r[0] == s]
        want = [(k + 1, *x) for k, x in enumerate(_loop_throttle(items, 200))]
        assert sorted(got[s]) == want
    # a one-element stream emits it and then the (empty) repeated tail
    one = tx.throttle_stream(spark.createDataFrame([("a", 1, 5, "x")], CK), P, interval_us=200).collect()
    assert sorted((r.emit_idx, r.is_tail, r.delta) for r in one) == [(1, False, "x"), (2, True, "")]


def test_empty_stream_gives_no_rows(spark):
    empty = spark.createDataFrame([], CK)
    assert tx.throttle_stream(empty, P).count() == 0
    ch = spark.createDataFrame([(7, 1, "assistant", "", None)], CH)
    assert [(r.stream_id, r.last_delta) for r in tx.stream_last(ch, empty).collect()] == [("7-1", "")]


def test_delta_roundtrip(spark):
    rows = [("a", 1, 1, "Hel"), ("a", 2, 2, "lo"), ("a", 3, 3, " you"), ("b", 1, 1, "x")]
    ck = spark.createDataFrame(rows, CK)
    back = sorted((r.stream_id, r.seq, r.delta) for r in tx.response_delta(tx.cumulative_response(ck)).collect())
    assert back == sorted((a, b, d) for a, b, _, d in rows)


def test_context_snapshot_halo_exact(spark):
    rnd = random.Random(6)
    rows = []
    for s in range(3):
        turns = sorted(rnd.sample(range(200), 40 + 10 * s))  # sparse, unordered turn numbers
        rows += [(s, t, "user" if k % 2 else "assistant", f"m{t}", None) for k, t in enumerate(turns)]
    ch = spark.createDataFrame(rows, CH)
    got = {(r.session_id, r.turn): [x.turn for x in r.context]
           for r in tx.chat_context_snapshot(ch, P.with_(context_last_n=4)).collect()}
    for s in range(3):
        ts = sorted(t for sid, t, *_ in rows if sid == s)
        for k, t in enumerate(ts):
            assert got[(s, t)] == ts[max(0, k - 3):k + 1]
    assert len(got) == len(rows)


def test_frames_numbering_with_ties(spark):
    from parley.sources import frames

    fr = frames(spark, "/root/testdata/sf0.001")
    assert fr.groupBy("speech_id").agg(F.max("frame_idx").alias("m"), F.count("*").alias("n")) \
        .where("m <> n").count() == 0


def test_interrupted_queue_uses_played_durations(spark):
    sp = spark.createDataFrame([(1, 1, 0, "reply", True, True, "a"), (2, 1, DAY_US, "reply", True, True, "b")], SP)
    fr = spark.createDataFrame([(1, 1, 2, 16000, "N", "O"), (1, 2, 3, 16000, "R", "F"), (1, 3, 4, 16000, "N", "O"),
                                (2, 1, 1, 16000, "N", "O")], FR)
    full = {r.speech_id: r.start_us for r in po.playout_queue(sp, fr, P).collect()}
    cut = {r.speech_id: r.start_us for r in po.playout_queue(sp, fr, P, interrupted=True).collect()}
    assert full[2] == 9 * DAY_US and cut[2] == 2 * DAY_US  # speech 1 stops before frame 2


def test_request_json_escaping_matches_duckdb(spark):
    import duckdb

    texts = ['say "hi"', "back\\slash", "line\nbreak\ttab", "ctl\x01char", "é ü ß 中文", "emoji 😀", "</x> & /"]
    rows = [(1, i, "user", t, None) for i, t in enumerate(texts)]
    got = tx.chat_request_json(spark.createDataFrame(rows, CH)).collect()[0].request_json
    con = duckdb.connect()
    con.execute("CREATE TABLE m(turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO m VALUES (?, ?, ?)", [(r[1], r[2], r[3]) for r in rows])
    want = con.sql("SELECT CAST(to_json(list(struct_pack(role := role, content := [struct_pack(type := 'text', "
                   "text := text)]) ORDER BY turn)) AS VARCHAR) FROM m").fetchall()[0][0]
    assert got == want


def test_whole_history_reaches_sizes_and_model(spark):
    from parley.operators import hooks as hk

    rows = [(7, t, "user" if t % 2 else "assistant", "x" * (t % 3), None) for t in range(100)]
    ch = spark.createDataFrame(rows, CH)
    got = {r.turn: (r.n_messages, r.context_chars) for r in tx.context_sizes(ch, P).collect()}
    assert got == {t: (t + 1, sum(k % 3 for k in range(t + 1))) for t in range(100)}
    seen = hk.reply_in_order(ch.repartition(5), lambda: lambda audio, history: [str(len(history))])
    assert sorted((r.turn, r.delta) for r in seen.collect()) == [(t, str(t + 1)) for t in range(1, 100, 2)]


def test_slices_keep_rows_without_order(spark):
    from parley.streaming.runner import slices_in_order

    df = spark.createDataFrame([(1, 5), (2, None), (3, 9), (4, 1)], "id long, t long")
    assert sorted(r.id for part in slices_in_order(df, 3, "t") for r in part.collect()) == [1, 2, 3, 4]


def test_one_chunk_reply_is_played_whole(spark):
    ck = spark.createDataFrame([("1-2", 1, 100, "hello"), ("2-1", 1, 100, "a"), ("2-1", 2, 200, " b")], "stream_id string, seq int, t_us long, delta string")
    got = {r.stream_id: (r.interrupted, r.played_text) for r in tx.played_text_asof(ck).collect()}
    assert got == {"1-2": (True, "hello"), "2-1": (True, "a")}


def test_request_json_carries_audio(spark):
    import base64
    import io
    import json
    import wave

    rows = [(1, 0, "system", "s", None), (1, 1, "user", None, [0.25, -0.5]), (1, 2, "user", None, [0.0, 0.0]), (1, 3, "user", "t", [0.1])]
    got = json.loads(tx.chat_request_json(spark.createDataFrame(rows, CH)).collect()[0].request_json)
    assert got[0] == {"role": "system", "content": [{"type": "text", "text": "s"}]} and len(got) == 3   # both set: quarantined
    for m, want in zip(got[1:], [(16384, -32767), (0, 0)]):
        part, = m["content"]
        head, data = part["audio_url"].split(",")
        assert set(part) == {"type", "audio_url"} and part["type"] == "audio" and head == "data:audio/wav;base64"
        with wave.open(io.BytesIO(base64.b64decode(data))) as w:
            assert w.readframes(9) == b"".join(x.to_bytes(2, "little", signed=True) for x in want)


def test_rows_without_playing_speech_keep_their_rows(spark):
    from parley.operators import turns

    rows = spark.createDataFrame([(1, None), (2, None), (3, 3), (4, 9)], "event_id long, speech long")
    im = spark.createDataFrame([(3, 50)], "speech long, interrupt_us long")
    got = turns._left_by_speech(rows, "speech", "event_id", im)
    assert sorted((r.event_id, r.interrupt_us) for r in got.collect()) == [(1, None), (2, None), (3, 50), (4, None)]
