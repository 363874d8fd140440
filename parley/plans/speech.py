"""Turn-taking queries over the agent event table (EV adapter)."""

from __future__ import annotations

from parley.operators import segments as seg
from parley.operators import turns
from parley.operators.segments import AGENT_END, AGENT_START, SPEECH_EDGES, USER_END, USER_START, VAD_DONE
from parley.params import EVENTS as P
from parley.plans.oracle_base import H, TURN_CTES, sql
from parley.plans.registry import query
from parley.sources import agent_events, chat_messages

# Event types each query reads (filtered at the parquet scan).
USER_EDGES = [USER_START, USER_END]
AGENT_VAD = [AGENT_START, AGENT_END, VAD_DONE]
USER_VAD = [USER_START, USER_END, VAD_DONE]


@query("speech_segments", sql("""
SELECT session_id, party, start_event_id, end_event_id, start_us, end_us FROM segments
"""))
def q_speech_segments(spark, d):
    return seg.speech_segments(agent_events(spark, d, SPEECH_EDGES), P)


@query("barge_in_overlap", sql("""
SELECT u.session_id, u.start_event_id AS user_start_event_id, a.start_event_id AS agent_start_event_id,
       greatest(u.start_us, a.start_us) AS overlap_start_us, least(u.end_us, a.end_us) AS overlap_end_us,
       least(u.end_us, a.end_us) - greatest(u.start_us, a.start_us) AS overlap_us
FROM segments u JOIN segments a
  ON u.session_id = a.session_id AND u.party = 'user' AND a.party = 'agent'
 AND u.start_us < a.end_us AND a.start_us < u.end_us
"""))
def q_barge_in_overlap(spark, d):
    return seg.barge_in_overlap(seg.speech_segments(agent_events(spark, d, SPEECH_EDGES), P), P)


BARGE_IN_SUMMARY_SQL = sql("""
SELECT u.session_id, count(*) AS n_barge_in,
       CAST(sum(least(u.end_us, a.end_us) - greatest(u.start_us, a.start_us)) AS BIGINT) AS barge_in_us,
       CAST(sum(least(u.end_us, a.end_us) - greatest(u.start_us, a.start_us)) AS BIGINT) / 3600000000.0 AS barge_in_s
FROM segments u JOIN segments a
  ON u.session_id = a.session_id AND u.party = 'user' AND a.party = 'agent'
 AND u.start_us < a.end_us AND a.start_us < u.end_us
GROUP BY u.session_id
""")


@query("barge_in_summary", BARGE_IN_SUMMARY_SQL)
def q_barge_in_summary(spark, d):
    return seg.barge_in_summary(agent_events(spark, d, SPEECH_EDGES), P)


# --- slice 1: turn-taking --------------------------------------------------------

W_RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("event_type_split", sql("""
SELECT session_id, event_id, t_us,
       CASE event_type WHEN 'user_started_speaking' THEN 'start_of_speech'
                       WHEN 'vad_inference_done' THEN 'vad_inference_done'
                       WHEN 'user_stopped_speaking' THEN 'end_of_speech' ELSE 'other' END AS branch
FROM agent_events
"""))
def q_event_type_split(spark, d):
    return turns.event_type_split(agent_events(spark, d))


@query("latest_probability", sql(f"""
SELECT session_id, event_id, t_us,
       coalesce(last_value(CASE WHEN event_type = 'vad_inference_done' THEN probability END IGNORE NULLS)
                OVER (PARTITION BY session_id ORDER BY t_us, event_id {W_RUN}), 0.0) AS speech_probability
FROM agent_events
"""))
def q_latest_probability(spark, d):
    return turns.latest_probability(agent_events(spark, d), P)


@query("last_speech_time", sql(f"""
SELECT session_id, event_id, t_us,
       CAST(last_value(CASE WHEN event_id % 3 > 0 THEN t_us - (event_id % 5) * {H} END IGNORE NULLS)
            OVER (PARTITION BY session_id ORDER BY t_us, event_id {W_RUN}) AS BIGINT) AS last_speech_us
FROM agent_events WHERE event_type = 'vad_inference_done'
"""))
def q_last_speech_time(spark, d):
    return turns.last_speech_time(agent_events(spark, d, [VAD_DONE]), P)


@query("endpoint_debounce", sql("SELECT session_id, end_event_id, end_us, fire_us FROM debounce", TURN_CTES))
def q_endpoint_debounce(spark, d):
    return turns.endpoint_debounce(agent_events(spark, d, USER_EDGES), P)


@query("transcript_accumulate", sql(f"""
SELECT session_id, event_id, t_us, turn_id,
       coalesce(array_to_string(list_filter(list(piece) OVER (PARTITION BY session_id, turn_id
                ORDER BY t_us, event_id {W_RUN}), lambda x: x IS NOT NULL), ''), '') AS accumulated
FROM tr_turn
""", TURN_CTES))
def q_transcript_accumulate(spark, d):
    return turns.transcript_accumulate(agent_events(spark, d, USER_VAD), chat_messages(spark, d), P)


@query("endpoint_delay", sql(f"""
SELECT l.session_id, l.event_id, l.t_us, l.last_piece IS NOT NULL AS has_transcript,
       CAST(CASE WHEN l.last_piece IS NULL THEN {5 * H}
            ELSE greatest(0, (CASE WHEN right(l.last_piece, 1) IN ('.', '!', '?') THEN {round(0.375 * H)}
                                   ELSE {H // 2} END)
                             - (l.t_us - CASE WHEN u.last_vad > 0 AND u.last_vad > coalesce(u.last_start, 0)
                                                   AND u.last_vad < l.t_us THEN u.last_vad ELSE l.t_us END)) END
            AS BIGINT) AS delay_us
FROM lastpiece l JOIN uv u ON l.session_id = u.session_id AND l.event_id = u.event_id
""", TURN_CTES + f""",
lastpiece AS (
  SELECT session_id, event_id, t_us, turn_id,
         last_value(piece IGNORE NULLS) OVER (PARTITION BY session_id, turn_id ORDER BY t_us, event_id {W_RUN})
           AS last_piece
  FROM tr_turn),
uv AS (
  SELECT session_id, event_id,
         last_value(CASE WHEN event_type = 'user_started_speaking' THEN t_us END IGNORE NULLS) OVER w AS last_start,
         last_value(CASE WHEN event_type = 'vad_inference_done' THEN t_us END IGNORE NULLS) OVER w AS last_vad
  FROM agent_events
  WHERE event_type IN ('user_started_speaking', 'user_stopped_speaking', 'vad_inference_done')
  WINDOW w AS (PARTITION BY session_id ORDER BY t_us, event_id {W_RUN}))
"""))
def q_endpoint_delay(spark, d):
    return turns.endpoint_delay(agent_events(spark, d, USER_VAD), chat_messages(spark, d), P)


AGENT_STATE_SQL = sql(f"""
SELECT session_id, event_id, state, t_us, eff_us,
       CAST(lead(eff_us) OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS BIGINT) AS end_us
FROM rn WHERE next_t IS NULL OR next_t >= eff_us
""", f"""
req AS (
  SELECT session_id, min(t_us) AS t_us, CAST(-1 AS BIGINT) AS event_id, 'initializing' AS state,
         CAST(0 AS BIGINT) AS delay_us
  FROM agent_events GROUP BY session_id
  UNION ALL
  SELECT session_id, t_us, event_id,
         CASE event_type WHEN 'user_stopped_speaking' THEN 'thinking'
                         WHEN 'agent_started_speaking' THEN 'speaking' ELSE 'listening' END,
         CAST(CASE WHEN event_type = 'user_stopped_speaking' THEN {round(0.2 * H)} ELSE 0 END AS BIGINT)
  FROM agent_events
  WHERE event_type IN ('user_stopped_speaking', 'agent_started_speaking', 'agent_stopped_speaking')),
rn AS (
  SELECT *, t_us + delay_us AS eff_us,
         lead(t_us) OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS next_t
  FROM req)
""")


@query("agent_state_timeline", AGENT_STATE_SQL)
def q_agent_state_timeline(spark, d):
    return turns.agent_state_timeline(agent_events(spark, d), P)


@query("interrupt_trigger", sql("""
SELECT session_id, event_id, t_us, speech_duration, playing_id AS playing_speech_id
FROM playing WHERE event_type = 'vad_inference_done' AND speech_duration >= 0.5
""", TURN_CTES))
def q_interrupt_trigger(spark, d):
    return turns.interrupt_trigger(agent_events(spark, d, AGENT_VAD), P)


@query("interrupt_match", sql("SELECT * FROM imatch", TURN_CTES))
def q_interrupt_match(spark, d):
    return turns.interrupt_match(agent_events(spark, d, AGENT_VAD), P)


@query("should_interrupt", sql("""
SELECT p.session_id, p.event_id, p.t_us, p.playing_id AS playing_speech_id,
       CASE WHEN p.playing_id IS NULL THEN true
            WHEN p.playing_id % 3 = 0 OR coalesce(m.interrupt_us < p.t_us, false) THEN false
            ELSE true END AS should_interrupt
FROM playing p LEFT JOIN imatch m ON m.speech_id = p.playing_id
WHERE p.event_type = 'vad_inference_done'
""", TURN_CTES))
def q_should_interrupt(spark, d):
    return turns.should_interrupt(agent_events(spark, d, AGENT_VAD), P)


@query("reply_validation", sql("SELECT * FROM decisions", TURN_CTES))
def q_reply_validation(spark, d):
    return turns.reply_validation(agent_events(spark, d), P)


@query("eou_metrics", sql(f"""
SELECT v.session_id, v.end_event_id, v.fire_us, v.fire_us - s.val AS end_of_utterance_delay_us,
       CAST(greatest(coalesce(f.t_us, 0) - s.val, 0) AS BIGINT) AS transcription_delay_us
FROM decisions v
ASOF JOIN ls_marks s ON v.session_id = s.session_id AND v.fire_us >= s.t_us
ASOF LEFT JOIN finals f ON v.session_id = f.session_id AND v.fire_us >= f.t_us
WHERE v.decision = 'validated'
""", TURN_CTES + f""",
ls_marks AS (
  SELECT session_id, t_us, t_us - (event_id % 5) * {H} AS val FROM agent_events
  WHERE event_type = 'vad_inference_done' AND event_id % 3 > 0),
finals AS (SELECT session_id, t_us FROM agent_events WHERE event_type = 'agent_started_speaking')
"""))
def q_eou_metrics(spark, d):
    return turns.eou_metrics(agent_events(spark, d), P)


@query("target_volume", sql("""
SELECT session_id, event_id, greatest(0.0, 1.0 - probability) AS target_volume,
       greatest(0.0, 1.0 - probability) AS smoothed_volume
FROM agent_events WHERE event_type = 'vad_inference_done'
"""))
def q_target_volume(spark, d):
    return turns.target_volume(agent_events(spark, d, [VAD_DONE]), P)


METRICS_CTE = """
metrics AS (
  SELECT 'tts' AS kind, session_id, event_id, t_us, playing_id AS sequence_id, value AS amount
  FROM playing WHERE event_type = 'vad_inference_done' AND playing_id IS NOT NULL
  UNION ALL
  SELECT 'vad', session_id, event_id, t_us, CAST(NULL AS BIGINT), value
  FROM agent_events WHERE event_type = 'vad_inference_done')
"""


@query("tts_metric_enrich", sql("""
SELECT session_id, event_id, t_us, sequence_id, amount FROM metrics WHERE kind = 'tts'
""", TURN_CTES + "," + METRICS_CTE))
def q_tts_metric_enrich(spark, d):
    return turns.metrics(agent_events(spark, d, AGENT_VAD), P).where("kind = 'tts'").drop("kind")


@query("vad_metric_pass", sql("SELECT * FROM metrics", TURN_CTES + "," + METRICS_CTE))
def q_vad_metric_pass(spark, d):
    return turns.metrics(agent_events(spark, d, AGENT_VAD), P)


@query("usage_summary", sql("""
SELECT session_id, count(*) FILTER (WHERE kind = 'tts') AS n_tts, count(*) FILTER (WHERE kind = 'vad') AS n_vad,
       coalesce(CAST(sum(round(amount * 100)) FILTER (WHERE kind = 'tts') AS BIGINT), 0) / 100.0 AS tts_amount,
       coalesce(CAST(sum(round(amount * 100)) FILTER (WHERE kind = 'vad') AS BIGINT), 0) / 100.0 AS vad_amount
FROM metrics GROUP BY session_id
""", TURN_CTES + "," + METRICS_CTE))
def q_usage_summary(spark, d):
    return turns.usage_summary(turns.metrics(agent_events(spark, d, AGENT_VAD), P))


@query("event_counts", sql("""
SELECT session_id, event_type, count(*) AS n_events FROM agent_events GROUP BY session_id, event_type
"""))
def q_event_counts(spark, d):
    return turns.event_counts(agent_events(spark, d))


@query("event_counts_wide", sql("""
SELECT session_id,
       count(*) FILTER (WHERE event_type = 'user_started_speaking') AS user_started_speaking,
       count(*) FILTER (WHERE event_type = 'user_stopped_speaking') AS user_stopped_speaking,
       count(*) FILTER (WHERE event_type = 'agent_started_speaking') AS agent_started_speaking,
       count(*) FILTER (WHERE event_type = 'agent_stopped_speaking') AS agent_stopped_speaking,
       count(*) FILTER (WHERE event_type = 'vad_inference_done') AS vad_inference_done
FROM agent_events GROUP BY session_id
"""))
def q_event_counts_wide(spark, d):
    return turns.event_counts_wide(agent_events(spark, d))


@query("latest_interim", sql("""
SELECT session_id, event_id, t_us, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'a b c' END AS response_text,
       playing_id AS playing_speech_id, (playing_id IS NULL OR playing_id % 3 <> 0) AS starts_reply
FROM playing WHERE event_type = 'user_stopped_speaking'
""", TURN_CTES))
def q_latest_interim(spark, d):
    return turns.latest_interim(agent_events(spark, d, [AGENT_START, AGENT_END, USER_END]), P)
