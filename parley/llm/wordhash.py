"""Words of many texts at once, as numpy arrays: where they lie, to which text they belong, a 64-bit hash of each.

Texts are handled in chunks of a few megabytes; every array is as long as the chunk's bytes or words. A word's hash is
a polynomial over its bytes (mod 2^64, prefix sums, so that no loop runs over words), mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_KEEP = 2 << 20


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (base is odd). Tables of usual length are kept."""
    if base not in _kept or len(_kept[base][0]) < n:
        m = -(-n // (1 << 18)) << 18
        up, down = np.full(m, base, U), np.full(m, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        made = np.cumprod(up, out=up), np.cumprod(down, out=down)
        if m > _KEEP:
            return made[0][:n], made[1][:n]
        _kept[base] = made
    return _kept[base][0][:n], _kept[base][1][:n]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _STEP) -> np.ndarray:
    """Hash of ``values[starts:ends]`` for every pair; equal stretches of values have equal hashes wherever they lie."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def _slices(start: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of words that begin within ``size`` bytes of each other."""
    lo = 0
    while lo < len(start):
        hi = int(np.searchsorted(start, start[lo] + size))
        yield lo, hi
        lo = hi


class Words:
    """The words of some texts: ``doc`` (index of the text), ``start`` and ``end`` in ``data``, ``hash``."""

    def __init__(self, texts: list[bytes | None], classes: np.ndarray):
        """``classes`` maps a byte to 0 (part of a word), 1 (separator) or 2 (break); texts are set apart by breaks."""
        self.data = np.frombuffer(b"\x00".join([b"", *[t or b"" for t in texts], b""]), np.uint8)
        lens = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        first = np.cumsum(lens + 1) - lens                      # where each text begins
        kind = classes[self.data]
        kind[first - 1] = 2
        kind[-1] = 2
        inside = kind == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(first, self.start, "right") - 1
        self.hash = np.empty(len(self.start), U)
        for lo, hi in _slices(self.start, 1 << 19):             # 64-bit work arrays only as long as a slice of the bytes
            s, e = self.start[lo:hi], self.end[lo:hi]
            some = self.data[s[0]:e[-1]].astype(U) + U(1)
            self.hash[lo:hi] = mix(rolling(some, s - s[0], e - s[0], _BASE) + (e - s).astype(U))
        self.breaks = np.flatnonzero(kind == 2)

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def byte_classes(separators: bytes, breaks: bytes = b"") -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[np.frombuffer(separators, np.uint8)] = 1
    if breaks:
        out[np.frombuffer(breaks, np.uint8)] = 2
    return out


def chunks(batches: Iterator, columns: list[str], text: str, max_bytes: int) -> Iterator[dict[str, list]]:
    """Rows of Arrow batches regrouped into lists of about ``max_bytes`` of text (one longer text is a list of its own)."""
    some: dict[str, list] = {c: [] for c in columns}
    size = 0
    for b in batches:
        cols = {c: b.column(b.schema.get_field_index(c)) for c in columns}
        cols[text] = cols[text].cast(pa.binary())
        for i in range(b.num_rows):
            t = cols[text][i].as_py()
            n = 16 + len(t or b"")
            if size and size + n > max_bytes:
                yield some
                some, size = {c: [] for c in columns}, 0
            for c in columns:
                some[c].append(t if c == text else cols[c][i].as_py())
            size += n
    if size:
        yield some


def squeezed(x: np.ndarray) -> bytes:
    """Numbers from 0 on as compressed byte planes."""
    planes = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return bytes([planes]) + len(x).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(x: bytes) -> np.ndarray:
    planes, n = x[0], int.from_bytes(x[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = np.frombuffer(pa.decompress(x[9:], planes * n, "zstd", asbytes=True), np.uint8).reshape(planes, n).T
    return out.view("<i8").ravel()
