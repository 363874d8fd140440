"""Playout queries over speeches (SP) and frames (FR)."""

from __future__ import annotations


from pyspark.sql import functions as F

from parley.operators import planning, playout as po
from parley.operators import turns
from parley.params import DAY_US, EVENTS
from parley.plans.oracle_base import TURN_CTES, sql
from parley.plans.registry import query
from parley.sources import agent_events, frames, speeches
from parley.operators.segments import AGENT_END, AGENT_START, VAD_DONE

P = EVENTS.with_(unit_us=DAY_US)  # SP/FR: one reference second of playout = one day
CAP = 100  # buffer cap used on the test tables (FIXTURES.md)

STATS = """
fstats AS (
  SELECT speech_id, count(*) AS n_frames, CAST(sum(samples_per_channel) AS BIGINT) AS pushed_samples,
         bool_or(flag = 'A') AS initialized, bool_or(flag = 'N') AS user_committed,
         bool_or(flag = 'R') AS speech_committed,
         min(frame_idx) FILTER (WHERE flag = 'A') AS init_pos,
         max(frame_idx) FILTER (WHERE flag = 'R') AS last_commit_pos,
         min(frame_idx) FILTER (WHERE flag = 'R' AND status = 'F') AS interrupt_pos
  FROM frames GROUP BY speech_id),
pframes AS (
  SELECT f.* FROM frames f JOIN fstats s USING (speech_id)
  WHERE s.interrupt_pos IS NULL OR f.frame_idx < s.interrupt_pos),
durs AS (
  SELECT s.*, d.units, CAST(coalesce(d.units, 0) * 86400000000 AS BIGINT) AS dur_us
  FROM speeches s LEFT JOIN (SELECT speech_id, CAST(sum(samples_per_channel) AS BIGINT) AS units
                             FROM frames GROUP BY speech_id) d USING (speech_id)),
sched AS (
  SELECT speech_id, session_id, t_us, t_us + (speech_id % 5) * 86400000000 AS start_us,
         t_us + (speech_id % 5) * 86400000000 + dur_us AS full_end_us
  FROM durs WHERE units IS NOT NULL),
outcome AS (
  SELECT s.speech_id, s.session_id, CAST(coalesce(p.n, 0) AS BIGINT) AS n_played,
         coalesce(p.n, 0) >= 1 AS started, coalesce(p.n, 0) >= 1 AS stopped_emitted,
         f.interrupt_pos IS NOT NULL AS interrupted,
         coalesce(p.n, 0) >= 1 AND f.interrupt_pos IS NULL AS segment_finished
  FROM speeches s LEFT JOIN (SELECT speech_id, count(*) AS n FROM pframes GROUP BY speech_id) p USING (speech_id)
  LEFT JOIN fstats f USING (speech_id))
"""


def q(body: str, extra: str = "") -> str:
    return sql(body, STATS + ("," + extra if extra else ""))


@query("frame_source", sql("SELECT speech_id, frame_idx, samples_per_channel, sample_rate FROM frames"))
def q_frame_source(spark, d):
    return frames(spark, d).select("speech_id", "frame_idx", "samples_per_channel", "sample_rate")


@query("pushed_duration", sql("""
SELECT speech_id, sample_rate, CAST(sum(samples_per_channel) AS BIGINT) AS pushed_samples,
       CAST(sum(samples_per_channel) AS BIGINT) / sample_rate AS pushed_duration
FROM frames GROUP BY speech_id, sample_rate
"""))
def q_pushed_duration(spark, d):
    return po.pushed_duration(frames(spark, d))


@query("time_played", q("""
SELECT s.speech_id, s.pushed_samples, CAST(coalesce(p.played, 0) AS BIGINT) AS played_samples,
       16000 AS sample_rate, s.interrupt_pos IS NOT NULL AS interrupted,
       CAST(coalesce(p.played, 0) AS BIGINT) / 16000 AS time_played
FROM fstats s LEFT JOIN (SELECT speech_id, sum(samples_per_channel) AS played FROM pframes GROUP BY speech_id) p
  USING (speech_id)
"""))
def q_time_played(spark, d):
    return po.time_played(frames(spark, d))


@query("playout_queue", q("""
SELECT speech_id, session_id, t_us AS arrival_us, CAST(s_excl + m AS BIGINT) AS start_us,
       CAST(s_excl + m + dur_us AS BIGINT) AS end_us, CAST(s_excl + m - t_us AS BIGINT) AS wait_us
FROM (SELECT *, max(t_us - s_excl) OVER (PARTITION BY session_id ORDER BY t_us, speech_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m
      FROM (SELECT *, CAST(sum(dur_us) OVER (PARTITION BY session_id ORDER BY t_us, speech_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - dur_us AS BIGINT) AS s_excl
            FROM durs))
"""))
def q_playout_queue(spark, d):
    return po.playout_queue(speeches(spark, d), frames(spark, d), P)


@query("queue_head", sql("""
SELECT session_id, arg_min(speech_id, (t_us, speech_id)) AS head_speech_id, min(t_us) AS head_arrival_us
FROM speeches GROUP BY session_id
"""))
def q_queue_head(spark, d):
    return po.queue_head(speeches(spark, d))


@query("playout_truncate", q("""
SELECT speech_id, session_id, start_us,
       CASE WHEN nx IS NOT NULL THEN least(full_end_us, nx) ELSE full_end_us END AS end_us,
       CASE WHEN nx IS NOT NULL THEN least(full_end_us, nx) ELSE full_end_us END < full_end_us AS truncated
FROM (SELECT *, lead(start_us) OVER (PARTITION BY session_id ORDER BY start_us, speech_id) AS nx FROM sched)
"""))
def q_playout_truncate(spark, d):
    return po.playout_truncate(speeches(spark, d), frames(spark, d), P)


@query("playout_overlap_warning", q("""
SELECT speech_id, session_id, prev_id AS prev_speech_id, start_us, prev_end - start_us AS queued_us
FROM (SELECT *, lag(full_end_us) OVER w AS prev_end, lag(speech_id) OVER w AS prev_id
      FROM sched WINDOW w AS (PARTITION BY session_id ORDER BY start_us, speech_id))
WHERE prev_end > start_us
"""))
def q_playout_overlap_warning(spark, d):
    return po.playout_overlap_warning(speeches(spark, d), frames(spark, d), P)


@query("first_frame_latency", q("""
SELECT speech_id, session_id, start_us - t_us AS first_frame_latency_us
FROM sched WHERE speech_id IN (SELECT speech_id FROM pframes)
"""))
def q_first_frame_latency(spark, d):
    return po.first_frame_latency(speeches(spark, d), frames(spark, d))


@query("speech_lifecycle", q("""
SELECT s.speech_id, s.session_id, coalesce(f.initialized, false) AS initialized,
       f.interrupt_pos IS NOT NULL AS interrupted, coalesce(f.user_committed, false) AS user_committed,
       coalesce(f.speech_committed, false) AS speech_committed,
       (f.interrupt_pos IS NOT NULL) OR (coalesce(f.initialized, false) AND f.n_frames IS NOT NULL
                                         AND coalesce(f.interrupt_pos, 1073741824) > 1) AS done
FROM speeches s LEFT JOIN fstats f USING (speech_id)
"""))
def q_speech_lifecycle(spark, d):
    return po.speech_lifecycle(speeches(spark, d), frames(spark, d))


@query("playout_outcome", q("SELECT * FROM outcome"))
def q_playout_outcome(spark, d):
    return po.playout_outcome(speeches(spark, d), frames(spark, d))


@query("playout_events", q("""
SELECT speech_id, session_id, interrupted, event FROM (
  SELECT speech_id, session_id, interrupted,
         unnest([CASE WHEN started THEN 'playout_started' END, CASE WHEN stopped_emitted THEN 'playout_stopped' END,
                 CASE WHEN segment_finished THEN 'segment_playout_finished' END]) AS event
  FROM outcome) WHERE event IS NOT NULL
"""))
def q_playout_events(spark, d):
    return po.playout_events(speeches(spark, d), frames(spark, d))


@query("speech_kind", sql("""
SELECT speech_id, kind, kind = 'reply' AS is_reply, CASE WHEN kind = 'reply' THEN text ELSE '' END AS user_question,
       CASE WHEN kind = 'tool' THEN 1 ELSE 0 END AS fnc_nested_depth
FROM speeches
"""))
def q_speech_kind(spark, d):
    return po.speech_kind(speeches(spark, d))


@query("speech_kind_counts", sql("SELECT kind, count(*) AS n_speeches FROM speeches GROUP BY kind"))
def q_speech_kind_counts(spark, d):
    return po.speech_kind_counts(speeches(spark, d))


@query("pending_supersede", sql("""
SELECT speech_id, session_id, turn,
       CASE WHEN row_number() OVER (PARTITION BY session_id, turn ORDER BY t_us DESC, speech_id DESC) = 1
            THEN 'active' ELSE 'superseded' END AS status
FROM (SELECT *, CAST(floor(t_us / (365 * 86400000000)) AS BIGINT) AS turn FROM speeches WHERE kind = 'reply')
"""))
def q_pending_supersede(spark, d):
    return po.pending_supersede(speeches(spark, d, ["reply"]), P)


@query("min_played_commit", q("""
SELECT speech_id, CAST(sum(samples_per_channel) AS BIGINT) AS played_units FROM pframes GROUP BY speech_id
HAVING sum(samples_per_channel) >= 1.5
"""))
def q_min_played_commit(spark, d):
    return po.min_played_commit(frames(spark, d), P)


@query("poll_quantize", q("""
SELECT speech_id, played_us, CAST((played_us + 17279999999) // 17280000000 * 17280000000 AS BIGINT) AS noticed_us
FROM (SELECT speech_id, CAST(sum(samples_per_channel) * 86400000000 AS BIGINT) AS played_us
      FROM pframes GROUP BY speech_id)
"""))
def q_poll_quantize(spark, d):
    return po.poll_quantize(speeches(spark, d), frames(spark, d), P)


@query("interrupted_suffix", q("""
SELECT s.speech_id, s.session_id,
       CASE WHEN o.interrupted THEN s.text || '...' ELSE s.text END AS committed_text,
       CASE WHEN o.interrupted THEN 'agent_speech_interrupted' ELSE 'agent_speech_committed' END AS event
FROM speeches s JOIN outcome o USING (speech_id)
WHERE o.started AND s.add_to_chat_ctx AND length(s.text) > 0
"""))
def q_interrupted_suffix(spark, d):
    return po.interrupted_suffix(speeches(spark, d), frames(spark, d))


@query("lifecycle_rules", q("""
SELECT speech_id, rule FROM (
  SELECT s.speech_id, unnest([
    CASE WHEN f.interrupt_pos IS NOT NULL AND f.init_pos > f.interrupt_pos THEN 'initialize_after_interrupt' END,
    CASE WHEN NOT f.initialized THEN 'access_before_initialize' END,
    CASE WHEN f.interrupt_pos IS NOT NULL AND NOT s.allow_interruptions THEN 'interrupt_not_allowed' END,
    CASE WHEN f.interrupt_pos IS NOT NULL AND f.last_commit_pos > f.interrupt_pos THEN 'play_after_interrupt' END
  ]) AS rule
  FROM speeches s JOIN fstats f USING (speech_id))
WHERE rule IS NOT NULL
"""))
def q_lifecycle_rules(spark, d):
    return po.lifecycle_rules(speeches(spark, d), frames(spark, d))


@query("audio_buffer_cap", sql(f"""
SELECT speech_id, frame_idx, samples_per_channel, cum_samples FROM (
  SELECT speech_id, frame_idx, samples_per_channel,
         CAST(sum(samples_per_channel) OVER (PARTITION BY speech_id ORDER BY frame_idx
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_samples
  FROM frames) WHERE cum_samples <= {CAP}
"""))
def q_audio_buffer_cap(spark, d):
    return po.audio_buffer_cap(frames(spark, d), CAP)


@query("buffer_overflow_flag", sql(f"""
SELECT speech_id, CAST(max(cum) AS BIGINT) AS total_samples, min(frame_idx) FILTER (WHERE cum > {CAP}) AS first_overflow_idx
FROM (SELECT speech_id, frame_idx, sum(samples_per_channel) OVER (PARTITION BY speech_id ORDER BY frame_idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM frames)
GROUP BY speech_id HAVING max(cum) > {CAP}
"""))
def q_buffer_overflow_flag(spark, d):
    return po.buffer_overflow_flag(frames(spark, d), CAP)


@query("nonempty_utterance", sql("""
SELECT speech_id, CAST(sum(samples_per_channel) AS BIGINT) AS n_samples FROM frames GROUP BY speech_id
HAVING sum(samples_per_channel) > 0
"""))
def q_nonempty_utterance(spark, d):
    return po.nonempty_utterance(frames(spark, d))


@query("structured_log", q("""
SELECT 'DEBUG' AS level, 'speech playout finished' AS msg, speech_id,
       CAST(to_json(struct_pack(speech_id := speech_id, interrupted := interrupted)) AS VARCHAR) AS extra
FROM outcome
UNION ALL
SELECT 'DEBUG', 'committed agent speech', s.speech_id,
       CAST(to_json(struct_pack(agent_response := CASE WHEN o.interrupted THEN s.text || '...' ELSE s.text END,
                                interrupted := o.interrupted, speech_id := s.speech_id)) AS VARCHAR)
FROM speeches s JOIN outcome o USING (speech_id)
WHERE o.started AND s.add_to_chat_ctx AND length(s.text) > 0
UNION ALL
SELECT 'WARNING', 'new playout while the source is still playing', speech_id,
       CAST(to_json(struct_pack(speech_id := speech_id, queued_duration_us := prev_end - start_us)) AS VARCHAR)
FROM (SELECT *, lag(full_end_us) OVER (PARTITION BY session_id ORDER BY start_us, speech_id) AS prev_end FROM sched)
WHERE prev_end > start_us
"""))
def q_structured_log(spark, d):
    return po.structured_log(speeches(spark, d), frames(spark, d), P)


@query("say_routing", sql("""
SELECT event_id AS speech_id, session_id, t_us, playing_id AS parent_id,
       CASE WHEN playing_id IS NOT NULL THEN 'nested' ELSE 'enqueue' END AS route,
       CASE WHEN playing_id IS NOT NULL THEN 1 ELSE 0 END AS depth
FROM playing WHERE event_type = 'vad_inference_done'
""", TURN_CTES))
def q_say_routing(spark, d):
    return turns.say_routing(agent_events(spark, d, [AGENT_START, AGENT_END, VAD_DONE]), EVENTS)


SAY_PLAN = """
q AS (SELECT s.session_id, s.speech_id, s.t_us, s.kind = 'speech' AS say, coalesce(f.units, 0)::BIGINT * 86400000000 AS dur,
             row_number() OVER (PARTITION BY s.session_id ORDER BY s.t_us, s.speech_id) AS rn
      FROM speeches s LEFT JOIN (SELECT speech_id, sum(samples_per_channel) AS units FROM frames GROUP BY speech_id) f USING (speech_id)),
r(session_id, rn, speech_id, t_us, parent_id, start_us, open) AS (
  SELECT session_id, rn, speech_id, t_us, NULL::BIGINT, t_us, CASE WHEN dur > 0 THEN [{'e': t_us + dur, 'id': speech_id}] ELSE [] END FROM q WHERE rn = 1
  UNION ALL
  SELECT session_id, rn, speech_id, t_us, CASE WHEN say THEN o[1].id END, CASE WHEN NOT say OR len(o) = 0 THEN from_us END,
         CASE WHEN (say AND len(o) > 0) OR dur = 0 THEN o ELSE o || [{'e': from_us + dur, 'id': speech_id}] END
  FROM (SELECT *, coalesce(o[-1].e, t_us) AS from_us FROM (SELECT q.*, list_filter(r.open, lambda x: x.e > q.t_us) AS o
        FROM r JOIN q ON q.session_id = r.session_id AND q.rn = r.rn + 1)))
"""


@query("say_planned", sql("""
SELECT session_id, speech_id, t_us, CASE WHEN parent_id IS NULL THEN 'enqueue' ELSE 'nested' END AS route, parent_id,
       CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END AS depth, start_us FROM r
""", SAY_PLAN, recursive=True))
def q_say_planned(spark, d):
    """Routes without a record: plain speeches are said, replies and tool speeches always enqueue."""
    s = po.speech_durations(speeches(spark, d), frames(spark, d))
    return planning.plan_requests(s.select("session_id", "speech_id", "t_us", (F.col("kind") == "speech").alias("is_say"), "dur_us"))


@query("nested_rollup", sql("""
SELECT r.session_id, r.parent_id, r.children, r.n_children, r.max_depth,
       coalesce(c.closed, false) AS finished
FROM (SELECT session_id, playing_id AS parent_id, list_sort(list(event_id)) AS children,
             count(*) AS n_children, max(1) AS max_depth
      FROM playing WHERE event_type = 'vad_inference_done' AND playing_id IS NOT NULL
      GROUP BY session_id, playing_id) r
LEFT JOIN (SELECT start_event_id AS parent_id, true AS closed FROM segments WHERE party = 'agent') c
  USING (parent_id)
""", TURN_CTES))
def q_nested_rollup(spark, d):
    return turns.nested_rollup(agent_events(spark, d, [AGENT_START, AGENT_END, VAD_DONE]), EVENTS)
