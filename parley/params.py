"""Operator parameters.

Times inside the engine are bigint microseconds. The constants below are in the
reference's unit (seconds); ``Params.us`` converts with ``unit_us`` microseconds per
reference second, so the same operators run on real-time data (1 s = 1e6 us) and on
the slow test tables (1 s = 1 hour, see FIXTURES.md).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Params:
    # --- fixed values that must equal the reference's defaults -----------------
    # min endpointing delay 0.5 s; interrupt speech duration 0.5 s; interrupt min
    # words 0 (off); min time played for commit 1.5 s; punctuation reduce factor
    # 0.75; unlikely-endpoint delay 6 s; final transcript timeout 5 s; "thinking"
    # state delay 0.2 s; playout poll 0.2 s; response throttle 0.2 s; utterance
    # buffer 30 s at 16 kHz; telemetry 250 points per series, 7.5 s event retention;
    # TTS output 24 kHz.
    min_endpointing_delay: float = 0.5
    interrupt_speech_duration: float = 0.5
    interrupt_min_words: int = 0
    min_time_played_for_commit: float = 1.5
    punctuation_reduce_factor: float = 0.75
    unlikely_endpoint_delay: float = 6.0
    final_transcript_timeout: float = 5.0
    thinking_delay: float = 0.2
    playout_poll: float = 0.2
    throttle_interval: float = 0.2
    buffer_max_seconds: float = 30.0
    input_sample_rate: int = 16000
    telemetry_points: int = 250
    telemetry_retention: float = 7.5
    tts_sample_rate: int = 24000
    allow_interruptions: bool = True
    transcription: bool = True
    transcription_speed: float = 1.0
    # A caller's choice (the default of a live agent is off): replies are synthesized before validation.
    preemptive_synthesis: bool = True
    # --- engine parameters ------------------------------------------------------
    unit_us: int = 1_000_000  # microseconds per reference second
    # Ordered scans are split into time buckets of this width so one hot session
    # spreads over many tasks (see operators/scan.py).
    bucket_us: int = DAY_US
    # Same for scans ordered by message turn number.
    turn_bucket: int = 1024
    # Tables of contexts need a cut (windowed collect_list is quadratic); sizes and model calls don't.
    context_last_n: int | None = None   # a caller's cut of the context; None = whole history

    def us(self, seconds: float) -> int:
        """Reference seconds -> engine microseconds (rounded, so both engines agree)."""
        return int(round(seconds * self.unit_us))

    @property
    def max_buffer_samples(self) -> int:
        return int(self.buffer_max_seconds * self.input_sample_rate)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
# Test tables: one reference second is one hour of event time (FIXTURES.md).
EVENTS = Params(unit_us=HOUR_US)
