"""User hooks: model reply, before-TTS text hook, turn detector, TTS and VAD.

The reference calls user code (a speech-in/text-out model, a TTS engine, a VAD
model, a turn detector) one event at a time. Here each hook is a user callable run on
Arrow batches: ``mapInPandas`` for one-to-many hooks (model, TTS), a scalar
``pandas_udf`` for per-row scores (turn detector, VAD probability). Order-dependent
logic around them (VAD edges) stays in the bucketed scans. Callables are created once
per partition (the reference's prewarm). Deterministic stubs are provided for tests;
no network is used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import WORD_RE
from parley.operators.context import context_blocks, contexts_at, numbered
from parley.operators.scan import prev, run_sum, scan
from parley.operators.text import SUPPORTED_LANGUAGES
from parley.params import Params

# A model factory returns fn(audio, history) -> iterable of cumulative reply strings.
ModelFactory = Callable[[], Callable[[object, list], Iterable[str]]]

REPLY_SCHEMA = "session_id long, turn long, seq int, delta string, error string"


def echo_model() -> Callable[[object, list], Iterable[str]]:
    """Deterministic stub: replies with the last message's words as cumulative strings
    (ignores the audio argument and reads the history, like the shipped function)."""
    import re

    word = re.compile(WORD_RE)

    def fn(audio, history):
        if len(history) == 0:
            raise ValueError("empty history")
        words = word.findall(history[-1]["text"] or "")
        acc = ""
        for i, w in enumerate(words):
            acc += (" " if i else "") + w
            yield acc

    return fn


def batch_reply(requests: DataFrame, factory: ModelFactory = echo_model) -> DataFrame:
    """One model call per request row (session_id, turn, history array<struct<turn, role, text>>);
    the cumulative stream is turned into deltas; errors go to the ``error`` column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()  # once per partition
        for pdf in batches:
            rows = []
            for sid, turn, hist in zip(pdf["session_id"], pdf["turn"], pdf["history"]):
                hist = [] if hist is None else list(hist)
                try:
                    prev_s = ""
                    for k, cum in enumerate(fn(None, hist), start=1):
                        rows.append((sid, turn, k, cum[len(prev_s):], None))
                        prev_s = cum
                except Exception as ex:  # noqa: BLE001 - the error is data
                    rows.append((sid, turn, 0, None, f"{type(ex).__name__}: {ex}"))
            yield pd.DataFrame(rows, columns=["session_id", "turn", "seq", "delta", "error"])

    return requests.select("session_id", "turn", "history").mapInPandas(run, REPLY_SCHEMA)


def reply_in_order(chat: DataFrame, factory: ModelFactory = echo_model) -> DataFrame:
    """One model call at every user message, with the whole history up to it.

    A conversation's messages (session_id, turn, role, text) come in order to one task, which appends
    them to the running history across Arrow batches: each message is shipped once. The
    model gets the history as a list of dicts (turn, role, text); errors go to the ``error`` column.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()  # once per partition
        session, history = None, []
        for pdf in batches:
            rows = []
            for sid, turn, role, text in zip(pdf["session_id"], pdf["turn"], pdf["role"], pdf["text"]):
                if sid != session:
                    session, history = sid, []
                history.append({"turn": turn, "role": role, "text": text})
                if role != "user":
                    continue
                try:
                    before = ""
                    for k, cum in enumerate(fn(None, history), start=1):
                        rows.append((sid, turn, k, cum[len(before):], None))
                        before = cum
                except Exception as ex:  # noqa: BLE001 - the error is data
                    rows.append((sid, turn, 0, None, f"{type(ex).__name__}: {ex}"))
            yield pd.DataFrame(rows, columns=["session_id", "turn", "seq", "delta", "error"])

    ordered = chat.select("session_id", "turn", "role", "text").repartition("session_id").sortWithinPartitions("session_id", "turn")
    return ordered.mapInPandas(run, REPLY_SCHEMA)


def listening_model() -> Callable[[object, list], Iterable[str]]:
    """Deterministic stub that reads the audio: number and sum of its 16-bit samples, then the number of messages."""

    def fn(audio, history):
        pcm = np.zeros(0) if audio is None else np.asarray(audio, np.float64) * 32767
        pcm = np.sign(pcm) * np.floor(np.abs(pcm) + 0.5)
        yield f"heard {len(pcm)}"
        yield f"heard {len(pcm)} {int(pcm.sum())} of {len(history)}"

    return fn


COPIES = 64            # most copies of an utterance that many sessions hear, so that none of its joins is one task


def utterances_of_turns(chat: DataFrame, utterances: DataFrame, p: Params, heard: Column | None = None) -> DataFrame:
    """session_id, turn, audio: the k-th user message of a session is its k-th utterance (session_id, utterance_id, audio), or with
    ``heard`` (an expression of the chat's session) the k-th utterance of that session; a null one hears nothing.
    An utterance is one row.

    Both sides are numbered without the audio, which is then fetched for the numbers that some turn asks for only.
    """
    count = {"k": run_sum(F.lit(1).cast("bigint"))}
    user = scan(chat.where(F.col("role") == "user").select("session_id", "turn"), ["session_id"], ["turn"], count, p.turn_bucket)
    user = user.withColumn("heard", F.col("session_id") if heard is None else heard).withColumn("copy", F.pmod(F.xxhash64("session_id"), F.lit(COPIES)))
    said = scan(utterances.select("session_id", "utterance_id"), ["session_id"], ["utterance_id"], count, p.turn_bucket)
    asked = user.select("heard", "k", "copy").distinct()
    if heard is not None:
        asked = asked.where(F.col("heard").isNotNull())

    def same(*names: str) -> Column:
        return reduce(Column.__and__, [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names])

    said = said.withColumnRenamed("session_id", "heard")
    wanted = asked.alias("a").join(said.alias("b"), same("heard", "k")).select("a.*", "b.utterance_id")
    sound = utterances.select(F.col("session_id").alias("heard"), "utterance_id", "audio")
    sound = wanted.alias("a").join(sound.alias("b"), same("heard", "utterance_id")).select("a.heard", "a.k", "a.copy", "b.audio")
    return user.alias("a").join(sound.alias("b"), same("heard", "k", "copy"), "left").select("a.session_id", "a.turn", "b.audio")


def reply_with_audio(chat: DataFrame, audio: DataFrame, p: Params, factory: ModelFactory = listening_model, block: int = 256) -> DataFrame:
    """One model call at every user message, with the audio of the turn and the whole history up to it.

    The calls of a conversation are spread: those of ``block`` consecutive messages form a group, which gets the blocks before it
    from the store of contexts (each message of a block once for all calls of the group, not once a call). ``audio`` has (session_id,
    turn, audio); a turn without gets None. Errors go to the ``error`` column. Null sessions are one conversation.
    """
    places = numbered(chat, p).where(F.col("role") == "user").withColumn("block", F.expr(f"(idx - 1) div {block}"))
    calls = (places.alias("c").join(audio.alias("a"), F.col("c.session_id").eqNullSafe(F.col("a.session_id")) & (F.col("c.turn") == F.col("a.turn")), "left")
             .select(*[F.col(f"c.{x}").alias(x) for x in ("session_id", "block", "idx", "turn")], "a.audio"))
    last = places.groupBy("session_id", "block").agg(F.max("idx").alias("at_idx"))
    history = contexts_at(last, context_blocks(chat, p, block), block).withColumn("block", F.expr(f"(at_idx - 1) div {block}"))

    def run(past: pa.Table, asked: pa.Table) -> pa.Table:
        fn, rows = factory(), []
        past = past.sort_by("idx").select(["idx", "turn", "role", "text"]).to_pylist()
        messages = [{"turn": m["turn"], "role": m["role"], "text": m["text"]} for m in past]
        asked = asked.sort_by("idx")
        for i in range(asked.num_rows):           # one call's audio at a time
            sid, idx, turn = (asked[c][i].as_py() for c in ("session_id", "idx", "turn"))
            sound = asked["audio"][i]
            try:
                before = ""
                for k, cum in enumerate(fn(sound.values.to_numpy(zero_copy_only=False) if sound.is_valid else None, messages[:idx]), start=1):
                    rows.append((sid, turn, k, cum[len(before):], None))
                    before = cum
            except Exception as ex:  # noqa: BLE001 - the error is data
                rows.append((sid, turn, 0, None, f"{type(ex).__name__}: {ex}"))
        cols = list(zip(*rows)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))],
                        names=["session_id", "turn", "seq", "delta", "error"])

    return history.groupBy("session_id", "block").cogroup(calls.groupBy("session_id", "block")).applyInArrow(run, REPLY_SCHEMA)


def text_hook(texts: DataFrame, hook: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """before-TTS hook as a Column -> Column function (default identity); a null result is
    a violation row instead of the reference's error."""
    h = hook(F.col("text"))
    return texts.select("session_id", "turn", h.alias("tts_text"),
                        F.when(h.isNull(), "hook_returned_none").otherwise("ok").alias("status"))


def stub_turn_scorer(n_chars: pd.Series) -> pd.Series:
    """Deterministic turn detector: p(end of turn) = (n_chars % 100) / 100."""
    return (n_chars % 100) / 100.0


def score_turns(docs: DataFrame, scorer: Callable[[pd.Series], pd.Series] = stub_turn_scorer) -> DataFrame:
    """Turn-detector probability per transcript through a vectorized pandas UDF."""
    udf = F.pandas_udf(scorer, "double")
    return docs.select("doc_id", "lang", udf(F.col("n_chars")).alias("p_end_of_turn"))


def context_scorer() -> Callable[[pd.Series], pd.Series]:
    """Deterministic detector over contexts: (characters of the messages % 100) / 100. Loaded once per partition."""
    return lambda contexts: contexts.map(lambda c: sum(len(m["text"] or "") for m in c) % 100 / 100.0)


def score_contexts(chat: DataFrame, languages: DataFrame, p: Params, factory: Callable[[], Callable[[pd.Series], pd.Series]] = context_scorer,
                   last_n: int = 4, threshold: float = 0.5) -> DataFrame:
    """Turn detector at every user message: the scorer gets the last ``last_n`` messages of the context, oldest first.

    ``languages`` has (session_id, lang). A message is eligible if its language is supported and it has text; others aren't scored.
    ``unlikely``: the probability is below the threshold, so the end of the turn is waited for longer.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = factory()                         # once per partition
        for contexts in batches:
            yield score(contexts).astype("float64")

    udf = F.pandas_udf(run, "double")
    user = numbered(chat, p).where(F.col("role") == "user").select("session_id", "turn", "text", F.col("idx").alias("at_idx"))
    known = user.join(languages, "session_id", "left")
    ok = F.coalesce((F.length("text") > 0) & F.col("lang").isin(*SUPPORTED_LANGUAGES), F.lit(False))
    known = known.select("session_id", "turn", "at_idx", "lang", ok.alias("eligible"))
    places = known.where("eligible")
    rows = contexts_at(places, context_blocks(chat, p), last_n=last_n)
    contexts = rows.groupBy("session_id", "at_idx").agg(F.sort_array(F.collect_list(F.struct("idx", "role", "text"))).alias("context"))
    scored = contexts.select("session_id", "at_idx", udf(F.col("context")).alias("p_end_of_turn"))
    return known.join(scored, ["session_id", "at_idx"], "left").select(
        "session_id", "turn", "lang", "eligible", "p_end_of_turn", (F.col("p_end_of_turn") < threshold).alias("unlikely"))


TTS_SCHEMA = "session_id long, turn long, frame_idx int, samples_per_channel long, sample_rate int"


def stub_tts(sample_rate: int = 24000) -> Callable[[str], list[int]]:
    """Deterministic TTS: one frame per word, 10 ms of audio per character."""
    import re

    word = re.compile(WORD_RE)
    per_char = sample_rate // 100
    return lambda text: [per_char * len(w) for w in word.findall(text or "")]


def synthesize(texts: DataFrame, factory: Callable[[], Callable[[str], list[int]]] = stub_tts,
               sample_rate: int = 24000) -> DataFrame:
    """Text -> audio frame rows (frame sizes) through a user TTS callable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tts = factory()
        for pdf in batches:
            rows = [(sid, turn, i, n, sample_rate)
                    for sid, turn, text in zip(pdf["session_id"], pdf["turn"], pdf["text"])
                    for i, n in enumerate(tts(text), start=1)]
            yield pd.DataFrame(rows, columns=["session_id", "turn", "frame_idx", "samples_per_channel", "sample_rate"])

    return texts.select("session_id", "turn", "text").mapInPandas(run, TTS_SCHEMA)


def stub_vad_probability(samples: pd.Series) -> pd.Series:
    """Deterministic VAD model: speech probability of a frame = its peak |sample|, capped
    at 1 (0 for empty frames). Vectorized over the Arrow batch when frames have one length."""
    arrs = [np.asarray(a, dtype=np.float64) if a is not None else np.zeros(0) for a in samples]
    lens = {len(a) for a in arrs}
    if len(lens) == 1 and 0 not in lens:
        peak = np.abs(np.vstack(arrs)).max(axis=1)
    else:
        peak = np.array([np.abs(a).max() if len(a) else 0.0 for a in arrs])
    return pd.Series(np.minimum(peak, 1.0), index=samples.index)


def vad(frames: DataFrame, p: Params, model: Callable[[pd.Series], pd.Series] = stub_vad_probability,
        threshold: float = 0.5, bucket: int = 1 << 16) -> DataFrame:
    """Frames (session_id, vec_id, samples) -> VAD events: INFERENCE_DONE for every frame,
    START / END where the thresholded probability changes. The model runs as a pandas UDF;
    the state (speaking or not) is a previous-row scan, so no session sits in one task."""
    prob = F.pandas_udf(model, "double")
    f = frames.select("session_id", "vec_id", prob(F.col("samples")).alias("probability"))
    f = f.withColumn("speaking", F.col("probability") >= F.lit(threshold))
    s = scan(f, ["session_id"], ["vec_id"], {"was": prev(F.col("speaking"))}, bucket)
    was = F.coalesce(F.col("was"), F.lit(False))
    edge = (F.when(F.col("speaking") & ~was, F.lit("start_of_speech"))
            .when(~F.col("speaking") & was, F.lit("end_of_speech")))
    ev = s.select("session_id", "vec_id", "probability",
                  F.array(F.lit("vad_inference_done"), edge).alias("_types"))
    return ev.select("session_id", "vec_id", F.explode(F.filter("_types", lambda x: x.isNotNull())).alias("event_type"),
                     "probability")
