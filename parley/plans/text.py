"""Text queries: chat messages (CH), response chunks (CK), transcripts (DX)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import config as cfg
from parley.operators import context as ctx, text as tx, tokenizers
from parley.operators import turns
from parley.params import DEFAULT, EVENTS
from parley.plans.oracle_base import TURN_CTES, sql
from parley.plans.registry import query
from parley.sources import agent_events, chat_messages, chunks, model_config, transcripts

SENT = r"'[^.!?]+[.!?]*'"
WORD = r"'[^ \t\n\r\f]+'"
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("chat_source", sql("SELECT session_id, turn, role, text FROM chat_messages"))
def q_chat_source(spark, d):
    return chat_messages(spark, d).select("session_id", "turn", "role", "text")


@query("chunk_source", sql("SELECT stream_id, seq, t_us, delta FROM chunks"))
def q_chunk_source(spark, d):
    return chunks(spark, d)


@query("validate_message", sql("""
SELECT session_id, turn,
       CASE WHEN text IS NOT NULL AND audio IS NOT NULL THEN 'both'
            WHEN text IS NULL AND audio IS NULL THEN 'empty'
            WHEN role NOT IN ('user', 'assistant', 'system') THEN 'bad_role' ELSE 'ok' END AS status
FROM chat_messages
"""))
def q_validate_message(spark, d):
    return tx.validate_message(chat_messages(spark, d))


@query("nonempty_reply", sql("""
SELECT session_id, turn, text FROM chat_messages WHERE role = 'assistant' AND length(text) > 0
"""))
def q_nonempty_reply(spark, d):
    return tx.nonempty_reply(chat_messages(spark, d))


@query("nonempty_chat", sql("""
SELECT session_id, turn, text FROM chat_messages WHERE role = 'user' AND length(text) > 0
"""))
def q_nonempty_chat(spark, d):
    return tx.nonempty_chat(chat_messages(spark, d))


@query("nonempty_history", sql("""
SELECT session_id, turn, n_history, CASE WHEN n_history > 0 THEN 'ok' ELSE 'empty_history' END AS status
FROM (SELECT session_id, turn, role,
             CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS BIGINT) AS n_history
      FROM chat_messages) WHERE role = 'user'
"""))
def q_nonempty_history(spark, d):
    return tx.nonempty_history(chat_messages(spark, d), DEFAULT)


@query("single_turn", sql("""
SELECT session_id, turn, role, text FROM chat_messages
WHERE (session_id, turn) IN (SELECT (session_id, min(turn)) FROM chat_messages GROUP BY session_id)
"""))
def q_single_turn(spark, d):
    return tx.single_turn(chat_messages(spark, d))


@query("chat_context_snapshot", sql("""
SELECT session_id, turn, CAST(count(*) OVER w AS INTEGER) AS n_messages,
       CAST(sum(coalesce(length(text), 0)) OVER w AS BIGINT) AS context_chars
FROM chat_messages WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
"""))
def q_chat_context_snapshot(spark, d):
    """The whole history visible at each turn, by its size."""
    return tx.context_sizes(chat_messages(spark, d), DEFAULT)


def _folded(k: int, base: int) -> str:
    """Horner's form of the fingerprint, by a fold over all messages up to the turn."""
    return (f"list_reduce([0::BIGINT] || list_transform(hs, lambda x: ('0x' || substr(x, {1 + 7 * k}, 7))::BIGINT), "
            f"lambda a, x: (a * {base} + x) % {ctx.PRIME})")


@query("chat_context_fingerprint", sql(f"""
SELECT session_id, turn, len(hs) AS n_messages, {_folded(0, ctx.BASES[0])} * 2147483648 + {_folded(1, ctx.BASES[1])} AS fingerprint
FROM (SELECT session_id, turn, list(md5(coalesce(role, chr(1)) || chr(31) || coalesce(text, chr(1)))) OVER
        (PARTITION BY session_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS hs FROM chat_messages)
"""))
def q_chat_context_fingerprint(spark, d):
    """The whole context at each turn, by an order-dependent fingerprint."""
    return ctx.context_fingerprint(chat_messages(spark, d), DEFAULT)


LAST_N = 6
LAST_CONTEXT = f"""
SELECT a.session_id, a.idx AS at_idx, b.idx, b.turn, b.role, b.text FROM numbered a JOIN numbered b
  ON a.session_id = b.session_id AND b.idx <= a.idx AND b.idx > a.idx - {LAST_N}
WHERE a.role = 'user'
"""
NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, role, text) AS idx FROM chat_messages)"


@query("chat_context_rows", sql(LAST_CONTEXT.replace(f" AND b.idx > a.idx - {LAST_N}", ""), NUMBERED))
def q_chat_context_rows(spark, d):
    """The whole context at each user turn, read message by message from the store of blocks."""
    chat = chat_messages(spark, d)
    places = ctx.numbered(chat, DEFAULT).where("role = 'user'").select("session_id", F.col("idx").alias("at_idx"))
    return ctx.contexts_at(places, ctx.context_blocks(chat, DEFAULT, 4), 4)


@query("chat_context_last_n", sql(LAST_CONTEXT, NUMBERED))
def q_chat_context_last_n(spark, d):
    """The last messages of the context at each user turn."""
    chat = chat_messages(spark, d)
    places = ctx.numbered(chat, DEFAULT).where("role = 'user'").select("session_id", F.col("idx").alias("at_idx"))
    return ctx.contexts_at(places, ctx.context_blocks(chat, DEFAULT), last_n=LAST_N)


@query("system_prompt_union", sql(f"""
SELECT session_id, turn, role, text FROM chat_messages
UNION ALL
SELECT DISTINCT session_id, CAST(-1 AS BIGINT), 'system', '{tx.SYSTEM_PROMPT}' FROM chat_messages
WHERE session_id NOT IN (SELECT session_id FROM chat_messages WHERE role = 'system')
"""))
def q_system_prompt_union(spark, d):
    return tx.system_prompt_union(chat_messages(spark, d))


@query("ends_with_punct", sql("""
SELECT session_id, turn, coalesce(right(text, 1) IN ('.', '!', '?'), false) AS ends_with_punct FROM chat_messages
"""))
def q_ends_with_punct(spark, d):
    return tx.ends_with_punct_q(chat_messages(spark, d))


@query("word_count", sql(f"""
SELECT session_id, turn, CASE WHEN text IS NULL THEN 0 ELSE CAST(len(regexp_extract_all(text, {WORD})) AS INTEGER) END
       AS n_words FROM chat_messages
"""))
def q_word_count(spark, d):
    return tx.word_count_q(chat_messages(spark, d))


@query("response_event_struct", sql("""
SELECT session_id, turn, 'final_response' AS event_type, text, 'en' AS language FROM chat_messages WHERE role = 'assistant'
"""))
def q_response_event_struct(spark, d):
    return tx.response_event_struct(chat_messages(spark, d))


@query("chat_request_json", sql("""
SELECT session_id, count(*) AS n_messages,
       CAST(to_json(list(struct_pack(role := role, content := [struct_pack(type := 'text', text := text)])
                         ORDER BY turn)) AS VARCHAR) AS request_json
FROM chat_messages WHERE text IS NOT NULL AND role IN ('user', 'assistant', 'system')
GROUP BY session_id
"""))
def q_chat_request_json(spark, d):
    return tx.chat_request_json(chat_messages(spark, d))


CUM = f"""
cum AS (SELECT stream_id, seq, t_us,
               array_to_string(list(delta) OVER (PARTITION BY stream_id ORDER BY seq {RUN}), '') AS text
        FROM chunks)
"""


@query("cumulative_response", sql("SELECT * FROM cum", CUM))
def q_cumulative_response(spark, d):
    return tx.cumulative_response(chunks(spark, d))


@query("response_delta", sql("""
SELECT stream_id, seq, substring(text, length(lag(text, 1, '') OVER (PARTITION BY stream_id ORDER BY seq)) + 1) AS delta
FROM cum
""", CUM))
def q_response_delta(spark, d):
    return tx.response_delta(tx.cumulative_response(chunks(spark, d)))


THROTTLE_CTES = """
c AS (SELECT stream_id, seq, t_us, delta, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS rn FROM chunks),
r AS (SELECT stream_id, rn, t_us AS last_emit, true AS keep FROM c WHERE rn = 1
      UNION ALL
      SELECT c.stream_id, c.rn, CASE WHEN c.t_us - r.last_emit >= {iv} THEN c.t_us ELSE r.last_emit END,
             c.t_us - r.last_emit >= {iv}
      FROM r JOIN c ON c.stream_id = r.stream_id AND c.rn = r.rn + 1),
g AS (SELECT c.*, r.keep,
             coalesce(sum(CASE WHEN r.keep THEN 1 ELSE 0 END) OVER (PARTITION BY c.stream_id ORDER BY c.seq
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS grp
      FROM c JOIN r ON c.stream_id = r.stream_id AND c.rn = r.rn),
nk AS (SELECT stream_id, sum(CASE WHEN keep THEN 1 ELSE 0 END) AS n_keep, max(seq) AS last_seq,
              arg_max(t_us, seq) AS last_t FROM g GROUP BY stream_id),
agg AS (SELECT stream_id, grp, string_agg(delta, '' ORDER BY seq) AS d FROM g GROUP BY stream_id, grp)
"""
THROTTLE_BODY = """
SELECT g.stream_id, CAST(g.grp AS INTEGER) AS emit_idx, g.seq, g.t_us, false AS is_tail, a.d AS delta
FROM g JOIN agg a ON a.stream_id = g.stream_id AND a.grp = g.grp WHERE g.keep
UNION ALL
SELECT n.stream_id, CAST(n.n_keep + 1 AS INTEGER), n.last_seq, n.last_t, true, coalesce(a.d, '')
FROM nk n LEFT JOIN agg a ON a.stream_id = n.stream_id AND a.grp = n.n_keep + 1
"""


@query("throttle_stream", sql(THROTTLE_BODY, THROTTLE_CTES.format(iv=DEFAULT.us(DEFAULT.throttle_interval)), recursive=True))
def q_throttle_stream(spark, d):
    return tx.throttle_stream(chunks(spark, d), DEFAULT)


@query("stream_concat", sql("""
SELECT stream_id, count(*) AS n_chunks, string_agg(delta, '' ORDER BY seq) AS text FROM chunks GROUP BY stream_id
"""))
def q_stream_concat(spark, d):
    return tx.stream_concat(chunks(spark, d))


STREAMS = """
streams AS (SELECT CAST(session_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS stream_id
            FROM chat_messages WHERE role = 'assistant')
"""


@query("stream_last", sql("""
SELECT s.stream_id, coalesce(l.d, '') AS last_delta
FROM streams s LEFT JOIN (SELECT stream_id, arg_max(delta, seq) AS d FROM chunks GROUP BY stream_id) l USING (stream_id)
""", STREAMS))
def q_stream_last(spark, d):
    return tx.stream_last(chat_messages(spark, d), chunks(spark, d))


@query("source_routing", sql("""
SELECT s.stream_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_chunks,
       CASE WHEN coalesce(n.n, 0) = 1 THEN 'string' ELSE 'stream' END AS source
FROM streams s LEFT JOIN (SELECT stream_id, count(*) AS n FROM chunks GROUP BY stream_id) n USING (stream_id)
""", STREAMS))
def q_source_routing(spark, d):
    return tx.source_routing(chat_messages(spark, d), chunks(spark, d))


@query("played_text_asof", sql("""
SELECT i.stream_id, i.interrupt_us IS NOT NULL AS interrupted,
       coalesce(string_agg(c.delta, '' ORDER BY c.seq) FILTER (WHERE i.interrupt_us IS NULL OR c.t_us < i.interrupt_us OR i.n_chunks = 1), '')
         AS played_text
FROM (SELECT stream_id, count(*) AS n_chunks,
             CASE WHEN (CAST(split_part(stream_id, '-', 1) AS BIGINT) + CAST(split_part(stream_id, '-', 2) AS BIGINT)) % 3 = 0
                  THEN (max(t_us) * 3) // 5 END AS interrupt_us
      FROM chunks GROUP BY stream_id) i
JOIN chunks c USING (stream_id)
GROUP BY i.stream_id, i.interrupt_us
"""))
def q_played_text_asof(spark, d):
    return tx.played_text_asof(chunks(spark, d))


@query("sentence_split", sql(f"""
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS idx, unnest(s) AS sentence
FROM (SELECT doc_id, regexp_extract_all(text, {SENT}) AS s FROM transcripts)
"""))
def q_sentence_split(spark, d):
    return tx.sentence_split(transcripts(spark, d))


@query("word_tokens", sql(f"""
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS idx, unnest(s) AS word
FROM (SELECT doc_id, regexp_extract_all(text, {WORD}) AS s FROM transcripts)
"""))
def q_word_tokens(spark, d):
    return tx.word_tokens(transcripts(spark, d))


@query("transcript_pacing", sql(f"""
SELECT session_id, turn, idx, word,
       CAST(sum(length(word)) OVER (PARTITION BY session_id, turn ORDER BY idx {RUN}) * 10000 AS BIGINT) AS release_us
FROM (SELECT session_id, turn, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS idx, unnest(s) AS word
      FROM (SELECT session_id, turn, regexp_extract_all(text, {WORD}) AS s FROM chat_messages WHERE role = 'assistant'))
"""))
def q_transcript_pacing(spark, d):
    return tx.transcript_pacing(chat_messages(spark, d), DEFAULT)


@query("transcription_toggle", sql(f"""
SELECT session_id, turn, CAST(len(regexp_extract_all(text, {SENT})) AS INTEGER) AS n_segments
FROM chat_messages WHERE role = 'assistant'
"""))
def q_transcription_toggle(spark, d):
    return tx.transcription_toggle(chat_messages(spark, d), DEFAULT.transcription)


@query("language_semi", sql("""
SELECT doc_id, lang FROM transcripts WHERE length(text) > 0 AND lang IN ('en', 'de')
"""))
def q_language_semi(spark, d):
    return tx.language_semi(transcripts(spark, d), spark)


@query("turn_detector_delay", sql("""
SELECT doc_id, lang, elig AS eligible, p AS p_end_of_turn,
       CAST(CASE WHEN elig THEN greatest(0, CASE WHEN p < 0.5 THEN 6000000 ELSE base END - 50000) ELSE base END
            AS BIGINT) AS delay_us
FROM (SELECT doc_id, lang, (n_chars % 100) / 100.0 AS p,
             coalesce(length(text) > 0, false) AND lang IN ('en', 'de') AS elig,
             CASE WHEN text IS NULL OR length(text) = 0 THEN 5000000
                  WHEN right(text, 1) IN ('.', '!', '?') THEN 375000 ELSE 500000 END AS base
      FROM transcripts)
"""))
def q_turn_detector_delay(spark, d):
    return tx.turn_detector_delay(transcripts(spark, d), DEFAULT)


MODEL_DIM = """
dim AS (SELECT * FROM (VALUES ('model-0', 'http://model-0.invalid/v1', 'empty'),
                              ('model-1', 'http://model-1.invalid/v1', 'empty'),
                              ('model-2', 'http://model-2.invalid/v1', 'empty'),
                              ('model-3', 'http://model-3.invalid/v1', NULL)) t(model_id, base_url, api_key)),
sm AS (SELECT DISTINCT session_id, 'model-' || CAST(session_id % 5 AS VARCHAR) AS model_id FROM chat_messages)
"""


@query("model_config_join", sql("""
SELECT sm.session_id, sm.model_id, dim.base_url, coalesce(dim.api_key IS NOT NULL, false) AS has_key,
       CASE WHEN dim.base_url IS NULL THEN 'unknown_model' ELSE 'ok' END AS status
FROM sm LEFT JOIN dim USING (model_id)
""", MODEL_DIM))
def q_model_config_join(spark, d):
    return cfg.model_config_join(cfg.session_models(chat_messages(spark, d)), model_config(spark))


@query("model_config", sql("""
SELECT u.model_id, u.n_sessions, dim.base_url, dim.api_key IS NOT NULL AS has_key
FROM (SELECT model_id, count(*) AS n_sessions FROM sm GROUP BY model_id) u JOIN dim USING (model_id)
""", MODEL_DIM))
def q_model_config(spark, d):
    return cfg.models_in_use(cfg.session_models(chat_messages(spark, d)), model_config(spark))


@query("conversation_commit", sql("""
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS BIGINT) AS turn,
       role, source, event_id, text
FROM (
  SELECT session_id, event_id, t_us, 'user' AS role, 'user_audio' AS source, CAST(NULL AS VARCHAR) AS text
  FROM agent_events WHERE event_type = 'user_stopped_speaking'
  UNION ALL
  SELECT session_id, event_id, t_us, 'assistant', 'final_reply', 'a b c'
  FROM agent_events WHERE event_type = 'agent_started_speaking' AND event_id % 4 <> 0
  UNION ALL
  SELECT e.session_id, e.event_id, e.t_us, 'assistant', 'played_speech',
         CASE WHEN m.interrupt_us IS NOT NULL THEN 'a b c...' ELSE 'a b c' END
  FROM agent_events e JOIN segments s ON s.party = 'agent' AND s.end_event_id = e.event_id
  LEFT JOIN imatch m ON m.speech_id = s.start_event_id
  WHERE e.event_type = 'agent_stopped_speaking' AND s.start_event_id % 4 <> 0)
""", TURN_CTES))
def q_conversation_commit(spark, d):
    return turns.conversation_commit(
        agent_events(spark, d, ["user_stopped_speaking", "agent_started_speaking", "agent_stopped_speaking",
                                "vad_inference_done"]), EVENTS)


# A small pattern set for the tests: a break between a vowel and a consonant before a vowel, none within some groups.
VOWELS, CONSONANTS = "aeiou", "bcdfgklmnprstvz"
PATTERNS = [f"{v}1{c}{w}" for v in VOWELS for c in CONSONANTS for w in VOWELS] + [f"{c}1{d}" for c in "lnr" for d in "bdgkpt"] + ["2st.", "n2k", ".re3", "s2ch"]


def _pattern_rows() -> str:
    """(letters, place, weight) of every weight in the patterns."""
    rows = []
    for p in PATTERNS:
        letters = "".join(c for c in p if not c.isdigit())
        for k, c in enumerate(p):
            if c.isdigit():
                rows.append(f"('{letters}', {sum(not x.isdigit() for x in p[:k])}, {c})")
    return "VALUES " + ", ".join(rows)


@query("hyphenate_words", sql("""
SELECT word, CAST(i - 1 AS INTEGER) AS idx, substring(word, cuts[i] + 1, cuts[i + 1] - cuts[i]) AS part
FROM (SELECT word, cuts, unnest(range(1, len(cuts))) AS i FROM (
  SELECT w.word, list_sort(list_distinct([0, length(w.word)] || coalesce(list(k) FILTER (WHERE weight % 2 = 1), []))) AS cuts
  FROM words w LEFT JOIN (SELECT word, i + place - 2 AS k, max(weight) AS weight
    FROM (SELECT word, unnest(range(1, length(word) + 3)) AS i FROM words) CROSS JOIN pats
    WHERE substring('.' || word || '.', i, length(letters)) = letters
    GROUP BY word, i + place - 2 HAVING k >= 2 AND k <= length(word) - 2) p USING (word)
  GROUP BY w.word))
""", f"""
words AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM transcripts)),
pats(letters, place, weight) AS ({_pattern_rows()})
"""))
def q_hyphenate_words(spark, d):
    """Parts of the distinct lower-case words of the transcripts, by a hyphenator over the small pattern set."""
    words = transcripts(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("word")).distinct()
    return tokenizers.hyphenate_words(words, PATTERNS)


def word_tokenizer():
    import re

    return re.compile(r"[^ \t\n\r\f]+").findall


@query("token_hook", sql(f"""
SELECT doc_id, lang, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS idx, unnest(w) AS token
FROM (SELECT doc_id, lang, regexp_extract_all(text, {WORD}) AS w FROM transcripts WHERE lang = 'de')
"""))
def q_token_hook(spark, d):
    """A word tokenizer of the caller's on the German transcripts."""
    docs = transcripts(spark, d).where("lang = 'de'").select("doc_id", "lang", "text")
    return tokenizers.tokens(docs, word_tokenizer)
