"""Scalar audio functions on ``array<float>`` sample vectors (higher-order SQL functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PCM16_MAX = 32767  # full scale of 16-bit PCM
DATA_URL_PREFIX = "data:audio/wav;base64,"
# Fixed value: "WAVE", "fmt " chunk of 16 bytes: PCM, 1 channel, 16000 Hz, 32000 bytes/s, 2 bytes a frame, 16 bits.
WAV_FORMAT_HEX = "57415645666D7420" "10000000" "0100" "0100" "803E0000" "007D0000" "0200" "1000"


def peak(samples: Column) -> Column:
    """max |sample| (as double)."""
    return F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))


def normalize(samples: Column) -> Column:
    """y / max|y| in float32; silent input (peak 0) gives null instead of NaN.

    The peak is paired with every element (``zip_with`` over ``array_repeat``) so it is
    evaluated once per row; referencing it inside the lambda would re-evaluate it per
    element once Catalyst inlines the projection.
    """
    pk = F.nullif(peak(samples), F.lit(0.0))
    return F.when(pk.isNotNull(), F.zip_with(samples, F.array_repeat(pk, F.size(samples)),
                                             lambda x, p: (x.cast("double") / p).cast("float")))


def pcm16(samples: Column) -> Column:
    """Float samples in [-1, 1] -> 16-bit PCM integers, round half away from zero."""
    return F.transform(samples, lambda x: F.round(x.cast("double") * F.lit(float(PCM16_MAX))).cast("int"))


def fingerprint(pcm: Column) -> Column:
    """Content hash of the quantized samples (equal for rescaled copies)."""
    return F.md5(F.array_join(F.transform(pcm, lambda v: v.cast("string")), ","))


def pcm16_bytes(pcm: Column) -> Column:
    """Little-endian 16-bit PCM bytes of the quantized samples."""
    def le(v):
        h = F.lpad(F.hex(F.pmod(v, F.lit(65536))), 4, "0")
        return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))

    return F.unhex(F.array_join(F.transform(pcm, le), ""))


def _le32(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)])


def wav_bytes(pcm: Column) -> Column:
    """A WAV file of the samples: RIFF header (PCM, mono, 16 kHz, 16 bit), then the little-endian samples."""
    data = pcm16_bytes(pcm)
    n = F.length(data).cast("bigint")
    header = F.concat(F.lit("52494646"), _le32(n + 36), F.lit(WAV_FORMAT_HEX), F.lit("64617461"), _le32(n))
    return F.concat(F.unhex(header), data)


def wav_pcm(b: Column) -> Column:
    """Samples of a WAV file with the header above (null for other bytes)."""
    ok = (F.hex(F.substring(b, 9, 28)) == F.lit(WAV_FORMAT_HEX)) & (F.hex(F.substring(b, 37, 4)) == F.lit("64617461"))
    pairs = F.regexp_extract_all(F.substring(F.hex(b), 89, 2**31 - 1), F.lit("...."), 0)
    n = F.transform(pairs, lambda x: F.conv(F.concat(F.substring(x, 3, 2), F.substring(x, 1, 2)), 16, 10).cast("int"))
    return F.when(ok, F.transform(n, lambda v: F.when(v > PCM16_MAX, v - 65536).otherwise(v)))


def data_url(b: Column) -> Column:
    """data:audio/wav;base64,<payload> without the line breaks Spark's base64 may insert."""
    return F.concat(F.lit(DATA_URL_PREFIX), F.translate(F.base64(b), "\r\n", ""))
