"""Hand-made fixtures for formula operators: endpoint delay, EOU metrics, supersede,
participant link, session gate, turn detector, sentences."""

from pyspark.sql import functions as F

from conftest import ev_rows
from parley.operators import playout as po
from parley.operators import telemetry as tm
from parley.operators import text as tx
from parley.operators import turns
from parley.params import DAY_US, Params

P = Params(unit_us=1000, bucket_us=50)
US, UE, AS, AE, VD = ("user_started_speaking", "user_stopped_speaking", "agent_started_speaking",
                      "agent_stopped_speaking", "vad_inference_done")
CH = "session_id long, turn long, role string, text string, audio array<float>"


def test_endpoint_delay_formula(spark):
    # one conversation: the k-th user END of session 0 takes its k-th user message
    ch = spark.createDataFrame([(0, 0, "user", "Hello.", None), (0, 1, "assistant", "hi", None),
                                (0, 2, "user", "and then", None)], CH)
    ev = ev_rows(spark, [(0, 1, 0, US), (0, 2, 5, VD), (0, 3, 10, UE),          # punct, base = VAD at 5
                         (0, 4, 10_000, US), (0, 5, 10_100, UE),                  # new turn, no punct, base = end
                         (0, 6, 20_000, US), (0, 7, 20_050, UE)])                 # no message left
    got = {r.event_id: (r.has_transcript, r.delay_us) for r in turns.endpoint_delay(ev, ch, P).collect()}
    assert got[3] == (True, 375 - 5)
    assert got[5] == (True, 500)
    # the third END has no message, but the turn is not reset (previous END did not fire
    # before the next START? it did: 10_100 + 5000 < 20_000), so no transcript -> timeout
    assert got[7] == (False, 5000)


def test_transcript_accumulates_until_fire(spark):
    ch = spark.createDataFrame([(0, 0, "user", " a ", None), (0, 1, "user", "b.", None), (0, 2, "user", "c", None)], CH)
    ev = ev_rows(spark, [(0, 1, 0, US), (0, 2, 10, UE), (0, 3, 20, US), (0, 4, 30, UE),   # 30 -> fires (next > 30+5000)
                         (0, 5, 9_000, US), (0, 6, 9_010, UE)])
    got = {r.event_id: (r.turn_id, r.accumulated) for r in turns.transcript_accumulate(ev, ch, P).collect()}
    assert got == {2: (0, " a"), 4: (0, " a b."), 6: (1, " c")}


def test_eou_metrics_hand(spark):
    # END at 100 fires at 5100; last speech time from VAD event 4 (4 % 3 = 1 > 0): t - (4 % 5) s
    ev = ev_rows(spark, [(0, 1, 0, US), (0, 4, 50, VD), (0, 5, 100, UE), (0, 7, 200, AS), (0, 8, 300, AE)])
    out = turns.eou_metrics(ev, P).collect()
    ls = 50 - 4 * 1000
    assert [(r.end_event_id, r.end_of_utterance_delay_us, r.transcription_delay_us) for r in out] == \
        [(5, 5100 - ls, 200 - ls)]


def test_pending_supersede_newest_wins(spark):
    sp = spark.createDataFrame([(1, 7, 10, "reply", True, True, "a"), (2, 7, 20, "reply", True, True, "b"),
                                (3, 7, 20, "reply", True, True, "c"), (4, 7, 400 * DAY_US, "reply", True, True, "d"),
                                (5, 7, 30, "speech", True, True, "e")],
                               "speech_id long, session_id long, t_us long, kind string, allow_interruptions boolean, "
                               "add_to_chat_ctx boolean, text string")
    got = {r.speech_id: r.status for r in po.pending_supersede(sp, P).collect()}
    assert got == {1: "superseded", 2: "superseded", 3: "active", 4: "active"}


def test_participant_link(spark):
    # room 0 requests participant 10; room 1 takes the first to join
    ev = ev_rows(spark, [(20, 1, 5, VD), (10, 2, 50, VD), (1, 3, 30, VD), (11, 4, 20, VD), (21, 5, 20, VD)])
    got = {r.room: (r.participant, r.reason) for r in tm.first_participant_link(ev).collect()}
    assert got == {0: (10, "requested"), 1: (11, "first")}


def test_session_gate_window(spark):
    ev = ev_rows(spark, [(1, 1, 100, VD), (1, 2, 200, US), (1, 3, 200 + 20 * DAY_US, VD), (1, 4, 300, VD)])
    tel = tm.telemetry_source(ev, P)
    got = sorted((r.event_id, r.which, r.x_us) for r in tm.session_gate(ev, tel).where("which <> 'raw_vol' AND which <> 'smoothed_vol'").collect())
    assert got == [(2, US, 0), (4, "vad_probability", 100)]  # before start and at close are dropped


def test_turn_detector_delay_cases(spark):
    docs = spark.createDataFrame([(1, "Done.", "en", 160), (2, "Done.", "en", 130), (3, "Fin", "fr", 120), (4, "", "de", 0)],
                                 "doc_id long, text string, lang string, n_chars long")
    p = Params()
    got = {r.doc_id: (r.eligible, r.delay_us) for r in tx.turn_detector_delay(docs, p).collect()}
    assert got[1] == (True, 375_000 - 50_000)        # p = 0.60 -> likely end of turn
    assert got[2] == (True, 6_000_000 - 50_000)      # p = 0.30 < 0.5 -> unlikely endpoint delay
    assert got[3] == (False, 500_000)                # unsupported language: no detector, no floor
    assert got[4] == (False, 5_000_000)              # no transcript -> timeout


def test_sentences_keep_whole_text(spark):
    docs = spark.createDataFrame([(1, "One. Two!? three", "en", 0)], "doc_id long, text string, lang string, n_chars long")
    got = [r.sentence for r in tx.sentence_split(docs).orderBy("idx").collect()]
    assert got == ["One.", " Two!?", " three"]


def test_event_counts_wide_zero_fill(spark):
    ev = ev_rows(spark, [(1, 1, 0, US), (1, 2, 1, US), (1, 3, 2, VD), (2, 4, 0, AE)])
    got = {r.session_id: (r[US], r[UE], r[AS], r[AE], r[VD]) for r in turns.event_counts_wide(ev).collect()}
    assert got == {1: (2, 0, 0, 0, 1), 2: (0, 0, 0, 1, 0)}


def test_playout_events_and_kind_counts(spark):
    sp = spark.createDataFrame([(1, 1, 0, "reply", True, True, "a"), (2, 1, 0, "tool", True, True, "b"),
                                (3, 1, 0, "reply", True, True, "c")],
                               "speech_id long, session_id long, t_us long, kind string, allow_interruptions boolean, "
                               "add_to_chat_ctx boolean, text string")
    fr = spark.createDataFrame([(1, 1, 1, 16000, "N", "O"), (2, 1, 1, 16000, "R", "F")],
                               "speech_id long, frame_idx int, samples_per_channel long, sample_rate int, flag string, "
                               "status string")
    ev = sorted((r.speech_id, r.event) for r in po.playout_events(sp, fr).collect())
    # speech 1 played fully; speech 2 was interrupted before its first frame; speech 3 has no frames
    assert ev == [(1, "playout_started"), (1, "playout_stopped"), (1, "segment_playout_finished")]
    assert {r.kind: r.n_speeches for r in po.speech_kind_counts(sp).collect()} == {"reply": 2, "tool": 1}
