"""Telemetry, event log, track and participant queries (EV adapter)."""

from __future__ import annotations


from parley.operators import telemetry as tm, throttle
from parley.params import DAY_US, EVENTS as P
from parley.plans.oracle_base import H, sql
from parley.plans.registry import query
from parley.sources import agent_events
from parley.operators.segments import USER_END, USER_START

TEL = """
tel AS (
  SELECT session_id, event_id, t_us, w.which, w.y, 'value' AS kind
  FROM (SELECT session_id, event_id, t_us, unnest([
          struct_pack(which := 'raw_vol', y := greatest(0.0, 1.0 - probability)),
          struct_pack(which := 'smoothed_vol', y := greatest(0.0, 1.0 - probability)),
          struct_pack(which := 'vad_probability', y := probability)]) AS w
        FROM agent_events WHERE event_type = 'vad_inference_done')
  UNION ALL
  SELECT session_id, event_id, t_us, event_type, CAST(NULL AS DOUBLE), 'event' FROM agent_events
  WHERE event_type IN ('user_started_speaking', 'user_stopped_speaking', 'agent_started_speaking',
                       'agent_stopped_speaking'))
"""


def tel(spark, d):
    return tm.telemetry_source(agent_events(spark, d), P)


@query("telemetry_source", sql("SELECT * FROM tel", TEL))
def q_telemetry_source(spark, d):
    return tel(spark, d)


@query("relative_time", sql("""
SELECT session_id, event_id, t_us, which, y, kind, t_us - min(t_us) OVER (PARTITION BY session_id) AS x_us FROM tel
""", TEL))
def q_relative_time(spark, d):
    return tm.relative_time(tel(spark, d))


@query("session_gate", sql(f"""
SELECT t.session_id, t.event_id, t.which, t.kind, t.t_us - s.st AS x_us, t.y
FROM tel t JOIN (SELECT session_id, min(t_us) AS st FROM agent_events WHERE event_type = 'user_started_speaking'
                 GROUP BY session_id) s USING (session_id)
WHERE t.t_us >= s.st AND t.t_us < s.st + {20 * DAY_US}
""", TEL))
def q_session_gate(spark, d):
    return tm.session_gate(agent_events(spark, d, [USER_START]), tel(spark, d))


@query("series_tail", sql(f"""
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY session_id, which ORDER BY t_us DESC, event_id DESC) AS BIGINT) AS rank
  FROM tel WHERE kind = 'value') WHERE rank <= {P.telemetry_points}
""", TEL))
def q_series_tail(spark, d):
    return tm.series_tail(tel(spark, d).where("kind = 'value'"), P.telemetry_points)


@query("event_retention", sql(f"""
SELECT e.session_id, e.event_id, e.which, e.t_us
FROM tel e LEFT JOIN (SELECT session_id, max(t_us) AS mx FROM tel WHERE kind = 'value' GROUP BY session_id) m
  USING (session_id)
WHERE e.kind = 'event' AND (m.mx IS NULL OR e.t_us >= m.mx - {round(7.5 * H)})
""", TEL))
def q_event_retention(spark, d):
    return tm.event_retention(tel(spark, d), P.us(P.telemetry_retention))


@query("event_log", sql("""
SELECT session_id, event_id, t_us,
       CASE WHEN event_type = 'vad_inference_done' THEN 'metrics_collected' ELSE event_type END AS event
FROM agent_events
"""))
def q_event_log(spark, d):
    return tm.event_log(agent_events(spark, d))


@query("track_filter", sql("""
SELECT session_id % 10 AS room, session_id AS participant, event_id AS track_id, t_us
FROM agent_events WHERE event_type = 'user_stopped_speaking'
"""))
def q_track_filter(spark, d):
    return tm.track_filter(agent_events(spark, d, [USER_END]))


@query("first_track", sql("""
SELECT participant, track_id, t_us, lag(track_id) OVER w AS replaced_track_id, lag(track_id) OVER w IS NULL AS is_first
FROM (SELECT session_id AS participant, event_id AS track_id, t_us FROM agent_events
      WHERE event_type = 'user_stopped_speaking')
WINDOW w AS (PARTITION BY participant ORDER BY t_us, track_id)
"""))
def q_first_track(spark, d):
    return tm.first_track(agent_events(spark, d, [USER_END]), P)


@query("first_participant_link", sql("""
SELECT room, coalesce(req, first_p) AS participant, CASE WHEN req IS NOT NULL THEN 'requested' ELSE 'first' END AS reason
FROM (SELECT room, arg_min(participant, (joined_us, participant)) AS first_p,
             max(CASE WHEN room % 2 = 0 AND participant = room + 10 THEN participant END) AS req
      FROM (SELECT session_id % 10 AS room, session_id AS participant, min(t_us) AS joined_us
            FROM agent_events GROUP BY 1, 2) GROUP BY room)
"""))
def q_first_participant_link(spark, d):
    return tm.first_participant_link(agent_events(spark, d))


EVENT_THROTTLE_CTES = """
c AS (SELECT session_id, event_id, t_us, row_number() OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS rn FROM agent_events),
r AS (SELECT session_id, rn, t_us AS last_emit, true AS keep FROM c WHERE rn = 1
      UNION ALL
      SELECT c.session_id, c.rn, CASE WHEN c.t_us - r.last_emit >= {iv} THEN c.t_us ELSE r.last_emit END, c.t_us - r.last_emit >= {iv}
      FROM r JOIN c ON c.session_id = r.session_id AND c.rn = r.rn + 1),
k AS (SELECT c.*, row_number() OVER (PARTITION BY c.session_id ORDER BY c.rn) AS i,
             c.rn - lag(c.rn, 1, 0) OVER (PARTITION BY c.session_id ORDER BY c.rn) AS n
      FROM c JOIN r ON r.session_id = c.session_id AND r.rn = c.rn WHERE r.keep),
z AS (SELECT session_id, max(i) AS i, max(rn) AS rn FROM k GROUP BY session_id)
"""
EVENT_THROTTLE = """
SELECT session_id, i AS emit_idx, event_id, t_us, false AS is_tail, n AS n_rows FROM k
UNION ALL
SELECT c.session_id, z.i + 1, c.event_id, c.t_us, true, c.rn - z.rn
FROM c JOIN z USING (session_id) WHERE c.rn = (SELECT max(rn) FROM c AS x WHERE x.session_id = c.session_id)
"""


def _throttled(seconds: float) -> str:
    return sql(EVENT_THROTTLE, EVENT_THROTTLE_CTES.format(iv=P.us(seconds)), recursive=True)


@query("throttle_events", _throttled(P.throttle_interval))
def q_throttle_events(spark, d):
    return throttle.throttle_events(agent_events(spark, d), P.us(P.throttle_interval), P.bucket_us)


# An interval above the usual gap between events (the test tables are slow), longer than a bucket of the scan.
@query("throttle_events_coarse", _throttled(30.0))
def q_throttle_events_coarse(spark, d):
    return throttle.throttle_events(agent_events(spark, d), P.us(30.0), P.bucket_us)
