"""Contexts, model calls with audio, planned say requests, tokenizer hooks."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.operators import context, hooks, planning, tokenizers
from parley.params import DEFAULT

CHAT = "session_id long, turn long, role string, text string"


def chat_rows(n=60):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 2, None]), t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(["hi", "", None, "é x", "ok."])) for t in range(n)]
    return rows + [(7, t, "user", str(t)) for t in range(40)]


def histories(rows):
    out = {}
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        for k in range(len(mine)):
            out[s, k + 1] = [r[1:] for r in mine[:k + 1]]
    return out


def test_fingerprint_is_a_fold_and_depends_on_order(spark):
    import hashlib

    rows, p = chat_rows(), DEFAULT.with_(turn_bucket=7)
    got = {(r.session_id, r.n_messages): r.fingerprint for r in context.context_fingerprint(spark.createDataFrame(rows, CHAT).repartition(3), p).collect()}
    for key, history in histories(rows).items():
        f = []
        for k, base in enumerate(context.BASES):
            acc = 0
            for _, role, text in history:
                h = hashlib.md5(f"{chr(1) if role is None else role}\x1f{chr(1) if text is None else text}".encode()).hexdigest()
                acc = (acc * base + int(h[7 * k:7 * k + 7], 16)) % context.PRIME
            f.append(acc)
        assert got[key] == f[0] * (1 << 31) + f[1]
    swapped = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "b"), (2, 1, "user", "a")], CHAT)
    last = {r.session_id: r.fingerprint for r in context.context_fingerprint(swapped, p).where("n_messages = 2").collect()}
    assert last[1] != last[2]
    assert context.context_fingerprint(swapped.limit(0), p).count() == 0


@pytest.mark.parametrize("block,last_n", [(4, None), (256, None), (4, 3), (5, 12)])
def test_contexts_from_blocks(spark, block, last_n):
    rows = chat_rows()
    chat = spark.createDataFrame(rows, CHAT)
    places = context.numbered(chat, DEFAULT).select("session_id", F.col("idx").alias("at_idx"))
    blocks = context.context_blocks(chat, DEFAULT, block)
    assert blocks.where(F.size("messages") > block).count() == 0
    got = {}
    for r in sorted(context.contexts_at(places, blocks, block, last_n).collect(), key=lambda r: r.idx):
        got.setdefault((r.session_id, r.at_idx), []).append((r.turn, r.role, r.text))
    assert got == {k: h[-last_n:] if last_n else h for k, h in histories(rows).items()}


def test_reply_with_audio_and_history(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", str(t)) for t in range(50)] + [(None, 0, "user", "x")]
    audio = spark.createDataFrame([(7, 4, [0.5, -0.25]), (None, 0, [1.0])], "session_id long, turn long, audio array<float>")

    def model():
        def fn(sound, history):
            if history[-1]["turn"] == 5:
                raise ValueError("no")
            yield f"{'-' if sound is None else sound.tolist()}"
            yield f"{'-' if sound is None else sound.tolist()} {[m['text'] for m in history]}"
        return fn

    got = {}
    for r in hooks.reply_with_audio(spark.createDataFrame(rows, CHAT), audio, DEFAULT, model, block=4).collect():
        got.setdefault((r.session_id, r.turn), {})[r.seq] = (r.delta, r.error)
    assert len(got) == len([r for r in rows if r[2] == "user"])
    for s, t, role, _ in rows:
        if role != "user":
            continue
        if t == 5:
            assert got[s, t] == {0: (None, "ValueError: no")}
            continue
        sound = {(7, 4): "[0.5, -0.25]", (None, 0): "[1.0]"}.get((s, t), "-")
        assert got[s, t] == {1: (sound, None), 2: (f" {[x[3] for x in rows if x[0] == s and x[1] <= t]}", None)}


def test_many_sessions_hear_one_source(spark):
    """Turn k of every session hears the k-th utterance of its source; the audio meets the turns that ask for it, not each session."""
    rows = [(s, t, "user" if t % 2 else "assistant", str(t)) for s in range(120) for t in range(2 * (s % 4 + 1))] + [(None, 1, "user", "x")]
    heard = spark.createDataFrame([(k % 3, 10 * k, [float(k)]) for k in range(300)] + [(None, 1, [-1.0])], "session_id long, utterance_id long, audio array<float>")
    got = {(r.session_id, r.turn): r.audio for r in
           hooks.utterances_of_turns(spark.createDataFrame(rows, CHAT), heard, DEFAULT, F.when(F.col("session_id") != 5, F.col("session_id") % 4)).collect()}
    want = {(s, t): None if s in (5, None) or s % 4 == 3 else [float(t // 2 * 3 + s % 4)] for s, t, role, _ in rows if role == "user"}
    assert got == want
    own = hooks.utterances_of_turns(spark.createDataFrame(rows, CHAT), heard, DEFAULT).collect()
    assert {r.session_id: r.audio for r in own if r.session_id in (0, None)} == {0: [0.0], None: [-1.0]}


def test_scorer_sees_the_last_messages(spark):
    rows = [(1, t, "user", "x" * t) for t in range(8)] + [(2, 0, "user", "abc"), (3, 0, "user", "abc")]
    langs = spark.createDataFrame([(1, "en"), (2, "fr")], "session_id long, lang string")
    got = {(r.session_id, r.turn): (r.eligible, r.p_end_of_turn, r.unlikely) for r in hooks.score_contexts(spark.createDataFrame(rows, CHAT), langs, DEFAULT, last_n=3).collect()}
    assert got[1, 0] == (False, None, None) and got[2, 0] == got[3, 0] == (False, None, None)
    assert got[1, 7] == (True, 0.18, True) and got[1, 1] == (True, 0.01, True)


def loop_plan(rows):
    out = []
    for s in {r[0] for r in rows}:
        queue = []
        for _, i, t, say, d in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            queue = [q for q in queue if q[0] > t]
            if say and queue:
                out.append((s, i, t, "nested", queue[0][1], 1, None))
                continue
            at = max(t, queue[-1][0]) if queue else t
            if d:
                queue.append((at + d, i))
            out.append((s, i, t, "enqueue", None, 0, at))
    return sorted(out, key=str)


def test_planned_requests(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 2, None]), i, rnd.randint(0, 300), rnd.random() < 0.6, rnd.choice([0, 3, 10, 40])) for i in range(200)]
    df = spark.createDataFrame(rows, "session_id long, speech_id long, t_us long, is_say boolean, dur_us long").repartition(4)
    assert sorted((tuple(r) for r in planning.plan_requests(df).collect()), key=str) == loop_plan(rows)
    assert planning.plan_requests(df.limit(0)).count() == 0


def test_planning_memory_is_flat():
    """One session of half a million requests as a stream of batches: what is held doesn't grow with it."""
    def batches(n):
        for k in range(n):
            i = list(range(k * 5000, k * 5000 + 5000))
            yield pa.RecordBatch.from_pydict({"session_id": [1] * 5000, "speech_id": i, "t_us": [x * 10 for x in i], "is_say": [x % 3 > 0 for x in i], "dur_us": [25] * 5000})

    peaks = []
    for n in (10, 100):
        tracemalloc.start()
        assert sum(b.num_rows for b in planning.fold(batches(n))) == 5000 * n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_hyphenator():
    h = tokenizers.Hyphenator(["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io"])
    assert h("hyphenation")[0] == "hy" and "".join(h("hyphenation")) == "hyphenation"
    assert h("") == [] and h("a") == ["a"] and h("xyz") == ["xyz"]
    cut = tokenizers.Hyphenator(["a1b"], left=1, right=1)
    assert cut("abab") == ["a", "ba", "b"] and cut("ABAB") == ["A", "BA", "B"]
    assert tokenizers.Hyphenator(["a1b", "2b."], left=1, right=1)("abab") == ["a", "bab"]      # a larger even weight forbids
    assert tokenizers.Hyphenator([".a1b"], left=1, right=1)("abab") == ["a", "bab"]            # only at the word's beginning


def test_tokenizer_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "c")], "id long, text string")
    assert sorted(tuple(r) for r in tokenizers.tokens(df, lambda: str.split).collect()) == [(1, 0, "a"), (1, 1, "b"), (4, 0, "c")]
    spark.udtf.register("words_of", tokenizers.token_table(lambda: str.split))
    assert [r.token for r in spark.sql("SELECT * FROM words_of('x y')").collect()] == ["x", "y"]
    with pytest.raises(Exception, match="takes a string"):
        spark.sql("SELECT * FROM words_of(1)").collect()
