"""DuckDB forms of the canonical tables (FIXTURES.md), used by the oracle SQL.

Every oracle statement is ``WITH <adapters>, <its own CTEs> SELECT ...``. DuckDB only
evaluates the CTEs a statement references. The forms are deliberately plain window
SQL: they state the meaning, the Spark operators state the scalable plan.
"""

ADAPTERS = r"""
agent_events AS (
  SELECT user_id AS session_id, event_id, epoch_us(ts) AS t_us,
         CASE event_type WHEN 'view' THEN 'user_started_speaking'
                         WHEN 'click' THEN 'user_stopped_speaking'
                         WHEN 'signup' THEN 'agent_started_speaking'
                         WHEN 'purchase' THEN 'agent_stopped_speaking'
                         WHEN 'error' THEN 'vad_inference_done' END AS event_type,
         value, least(value / 100.0, 1.0) AS probability, value / 100.0 AS speech_duration
  FROM events),
chat_messages AS (
  SELECT conv_id AS session_id, turn, role, text, CAST(NULL AS FLOAT[]) AS audio FROM conversations),
ck_words AS (
  SELECT stream_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS seq
  FROM (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS stream_id,
               regexp_extract_all(text, '[^ \t\n\r\f]+') AS ws
        FROM conversations WHERE role = 'assistant')),
chunks AS (
  SELECT stream_id, CAST(seq AS INTEGER) AS seq,
         CAST(sum(10000 * length(word)) OVER (PARTITION BY stream_id ORDER BY seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS t_us,
         CASE WHEN seq = 1 THEN word ELSE ' ' || word END AS delta
  FROM ck_words),
speeches AS (
  SELECT o_orderkey AS speech_id, o_custkey AS session_id, epoch_us(o_orderdate) AS t_us,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'reply'
              WHEN o_orderpriority = '5-LOW' THEN 'tool' ELSE 'speech' END AS kind,
         o_orderstatus <> 'F' AS allow_interruptions, o_orderstatus <> 'P' AS add_to_chat_ctx,
         o_orderpriority AS text
  FROM orders),
frames AS (
  SELECT l_orderkey AS speech_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
              l_extendedprice, l_shipdate) AS INTEGER) AS frame_idx,
         CAST(round(l_quantity) AS BIGINT) AS samples_per_channel, CAST(16000 AS INTEGER) AS sample_rate,
         l_returnflag AS flag, l_linestatus AS status
  FROM lineitem),
audio_vectors AS (
  SELECT vec_id, CAST(label AS INTEGER) AS session_id, embedding AS samples FROM embeddings),
transcripts AS (
  SELECT doc_id, text, lang, n_chars FROM documents),
seg_edges AS (
  SELECT session_id, event_id, t_us,
         CASE WHEN event_type LIKE 'user%' THEN 'user' ELSE 'agent' END AS party,
         CASE WHEN event_type LIKE '%started_speaking' THEN 'start' ELSE 'end' END AS edge
  FROM agent_events
  WHERE event_type IN ('user_started_speaking', 'user_stopped_speaking',
                       'agent_started_speaking', 'agent_stopped_speaking')),
seg_lag AS (
  SELECT *, lag(edge) OVER w AS p_edge, lag(t_us) OVER w AS p_t, lag(event_id) OVER w AS p_id
  FROM seg_edges WINDOW w AS (PARTITION BY session_id, party ORDER BY t_us, event_id)),
segments AS (
  SELECT session_id, party, p_id AS start_event_id, event_id AS end_event_id,
         p_t AS start_us, t_us AS end_us
  FROM seg_lag WHERE edge = 'end' AND p_edge = 'start')
"""


def sql(body: str, ctes: str = "", recursive: bool = False) -> str:
    """Oracle statement: adapters + optional extra CTEs + body."""
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {ADAPTERS.strip()}{extra}\n{body.strip()}"

H = 3_600_000_000  # one reference second on the EV tables (1 hour)
STRIP = r"regexp_replace({x}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


# Shared turn-taking CTEs (EV adapter, reference second = 1 hour).
TURN_CTES = f"""
user_edges AS (
  SELECT session_id, event_id, t_us, event_type FROM agent_events
  WHERE event_type IN ('user_started_speaking', 'user_stopped_speaking')),
ue_next AS (
  SELECT *, lead(t_us) OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS next_t FROM user_edges),
ends_f AS (
  SELECT session_id, event_id, t_us, (next_t IS NULL OR next_t > t_us + {5 * H}) AS fired
  FROM ue_next WHERE event_type = 'user_stopped_speaking'),
debounce AS (
  SELECT session_id, event_id AS end_event_id, t_us AS end_us, t_us + {5 * H} AS fire_us FROM ends_f WHERE fired),
ends_turn AS (
  SELECT *, CAST(sum(CAST(fired AS BIGINT)) OVER (PARTITION BY session_id ORDER BY t_us, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(fired AS BIGINT) AS BIGINT) AS turn_id
  FROM ends_f),
end_k AS (
  SELECT session_id, event_id, t_us, row_number() OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS k
  FROM agent_events WHERE event_type = 'user_stopped_speaking'),
user_msgs AS (
  SELECT session_id AS conv_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS k, text AS transcript
  FROM chat_messages WHERE role = 'user'),
n_conv AS (SELECT count(DISTINCT session_id) AS n FROM chat_messages),
tr_at_end AS (
  SELECT e.session_id, e.event_id, e.t_us, e.k, m.transcript
  FROM end_k e CROSS JOIN n_conv LEFT JOIN user_msgs m ON m.conv_id = e.session_id % n_conv.n AND m.k = e.k),
tr_turn AS (
  SELECT t.session_id, t.event_id, t.t_us, t.turn_id,
         CASE WHEN x.transcript IS NOT NULL THEN ' ' || {strip('x.transcript')} END AS piece
  FROM ends_turn t JOIN tr_at_end x ON t.session_id = x.session_id AND t.event_id = x.event_id),
playing AS (
  SELECT *, CASE WHEN ag.type = 'agent_started_speaking' THEN ag.id END AS playing_id
  FROM (SELECT *, last_value(CASE WHEN event_type IN ('agent_started_speaking', 'agent_stopped_speaking')
                  THEN struct_pack(type := event_type, id := event_id, t := t_us) END IGNORE NULLS)
                  OVER (PARTITION BY session_id ORDER BY t_us, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ag
        FROM agent_events)),
imatch AS (
  SELECT session_id, playing_id AS speech_id, arg_min(event_id, t_us) AS interrupt_event_id,
         min(t_us) AS interrupt_us, count(*) AS n_attempts
  FROM playing
  WHERE event_type = 'vad_inference_done' AND speech_duration >= 0.5
    AND playing_id IS NOT NULL AND playing_id % 3 <> 0
  GROUP BY session_id, playing_id),
agent_edges AS (
  SELECT session_id, event_id, t_us, event_type FROM agent_events
  WHERE event_type IN ('agent_started_speaking', 'agent_stopped_speaking')),
validation AS (
  SELECT f.session_id, f.end_event_id, f.fire_us,
         CASE WHEN a.event_type = 'agent_started_speaking' THEN a.event_id END AS playing_speech_id
  FROM debounce f ASOF LEFT JOIN agent_edges a ON f.session_id = a.session_id AND f.fire_us >= a.t_us),
decisions AS (
  SELECT v.session_id, v.end_event_id, v.fire_us, v.playing_speech_id,
         CASE WHEN v.playing_speech_id IS NOT NULL AND v.playing_speech_id % 3 = 0 THEN 'ignored_not_allowed'
              WHEN v.playing_speech_id IS NOT NULL AND coalesce(m.interrupt_us <= v.fire_us, false)
                   THEN 'ignored_threshold'
              WHEN v.end_event_id % 4 = 0 THEN 'nothing_pending'
              ELSE 'validated' END AS decision
  FROM validation v LEFT JOIN imatch m ON m.speech_id = v.playing_speech_id)
"""
