"""Hook queries with the deterministic stubs (no network)."""

from __future__ import annotations


from pyspark.sql import functions as F

from parley.operators import hooks as hk
from parley.operators.audio import utterance_concat
from parley.params import DEFAULT
from parley.plans.oracle_base import sql, strip
from parley.plans.registry import query
from parley.sources import audio_vectors, chat_messages, transcripts

WORD = r"'[^ \t\n\r\f]+'"


@query("batch_reply", sql(f"""
SELECT session_id, turn, CAST(generate_subscripts(ws, 1) AS INTEGER) AS seq,
       unnest(list_transform(ws, lambda w, i: CASE WHEN i = 1 THEN w ELSE ' ' || w END)) AS delta,
       CAST(NULL AS VARCHAR) AS error
FROM (SELECT session_id, turn, regexp_extract_all(text, {WORD}) AS ws FROM chat_messages WHERE role = 'user')
"""))
def q_batch_reply(spark, d):
    """A model call at every user message with the whole history up to it."""
    return hk.reply_in_order(chat_messages(spark, d))


SOUND = """
heard AS (SELECT session_id AS label, row_number() OVER (PARTITION BY session_id ORDER BY utterance_id) AS k, pcm FROM (
  SELECT session_id, vec_id // 16 AS utterance_id,
         flatten(list(list_transform(samples, lambda x: CAST(round(CAST(x AS DOUBLE) * 32767) AS BIGINT)) ORDER BY vec_id)) AS pcm
  FROM audio_vectors GROUP BY ALL)),
labels AS (SELECT count(DISTINCT session_id) AS n, list_sort(list(DISTINCT session_id)) AS l FROM audio_vectors),
turns AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, role, text) AS idx FROM chat_messages),
asked AS (SELECT session_id, turn, idx, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS k FROM turns WHERE role = 'user'),
said AS (SELECT asked.session_id, turn, idx, coalesce(len(pcm), 0) AS n, coalesce(list_sum(pcm), 0)::BIGINT AS s
  FROM asked CROSS JOIN labels LEFT JOIN heard ON heard.label = labels.l[1 + asked.session_id % labels.n] AND heard.k = asked.k)
"""


@query("batch_reply_audio", sql("""
SELECT session_id, turn, 1 AS seq, 'heard ' || n AS delta, CAST(NULL AS VARCHAR) AS error FROM said
UNION ALL SELECT session_id, turn, 2, ' ' || s || ' of ' || idx, NULL FROM said
""", SOUND))
def q_batch_reply_audio(spark, d):
    """A model call at every user message with the audio of the turn; conversation n hears the utterances of the (n mod labels)-th label."""
    chat, vectors = chat_messages(spark, d), audio_vectors(spark, d)
    u = utterance_concat(vectors)
    labels = sorted(r[0] for r in vectors.select("session_id").distinct().collect())      # the few labels of the fixture
    of = F.array(*[F.lit(x) for x in labels])[(F.col("session_id") % len(labels)).cast("int")]
    return hk.reply_with_audio(chat, hk.utterances_of_turns(chat, u, DEFAULT, of), DEFAULT)


@query("score_turns_context", sql("""
SELECT session_id, turn, lang, eligible, p AS p_end_of_turn, p < 0.5 AS unlikely FROM (
  SELECT *, CASE WHEN eligible THEN (chars % 100) / 100.0 END AS p FROM (
    SELECT session_id, turn, role, lang, coalesce(length(text) > 0 AND lang IN ('en', 'de'), false) AS eligible,
           sum(coalesce(length(text), 0)) OVER (PARTITION BY session_id ORDER BY turn, role, text ROWS 3 PRECEDING) AS chars
    FROM (SELECT *, (['en', 'de', 'fr', 'es'])[1 + session_id % 4] AS lang FROM chat_messages)) WHERE role = 'user')
"""))
def q_score_turns_context(spark, d):
    """Turn detector on the last four messages at every user turn; conversation n is in the (n mod 4)-th language."""
    chat = chat_messages(spark, d)
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])[(F.col("session_id") % 4).cast("int")]
    return hk.score_contexts(chat, chat.select("session_id").distinct().withColumn("lang", langs), DEFAULT)


@query("text_hook", sql(f"""
SELECT session_id, turn, {strip('text')} AS tts_text,
       CASE WHEN text IS NULL THEN 'hook_returned_none' ELSE 'ok' END AS status
FROM chat_messages WHERE role = 'assistant'
"""))
def q_text_hook(spark, d):
    """before-TTS hook that strips surrounding whitespace."""
    from parley.functions.text import strip as strip_col

    a = chat_messages(spark, d).where("role = 'assistant'")
    return hk.text_hook(a, strip_col)


@query("score_turns", sql("SELECT doc_id, lang, (n_chars % 100) / 100.0 AS p_end_of_turn FROM transcripts"))
def q_score_turns(spark, d):
    return hk.score_turns(transcripts(spark, d))


@query("synthesize", sql(f"""
SELECT session_id, turn, CAST(generate_subscripts(ws, 1) AS INTEGER) AS frame_idx,
       unnest(list_transform(ws, lambda w: CAST(240 * length(w) AS BIGINT))) AS samples_per_channel,
       24000 AS sample_rate
FROM (SELECT session_id, turn, regexp_extract_all(text, {WORD}) AS ws FROM chat_messages WHERE role = 'assistant')
"""))
def q_synthesize(spark, d):
    return hk.synthesize(chat_messages(spark, d).where("role = 'assistant'"))


@query("vad", sql("""
SELECT session_id, vec_id, event_type, probability FROM (
  SELECT session_id, vec_id, probability, unnest([
           'vad_inference_done',
           CASE WHEN sp AND NOT coalesce(was, false) THEN 'start_of_speech'
                WHEN NOT sp AND coalesce(was, false) THEN 'end_of_speech' END]) AS event_type
  FROM (SELECT *, lag(sp) OVER (PARTITION BY session_id ORDER BY vec_id) AS was
        FROM (SELECT session_id, vec_id, probability, probability >= 0.5 AS sp
              FROM (SELECT session_id, vec_id,
                           least(list_max(list_transform(samples, lambda x: abs(CAST(x AS DOUBLE)))), 1.0) AS probability
                    FROM audio_vectors))))
WHERE event_type IS NOT NULL
"""))
def q_vad(spark, d):
    return hk.vad(audio_vectors(spark, d), DEFAULT)
