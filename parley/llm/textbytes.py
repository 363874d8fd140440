"""Small numpy helpers for models over text: letters of a text as bytes, batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

# a-z and bytes of non-ASCII characters stay, A-Z become lower case, all else separates words
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def pieces(texts: pa.Array, max_bytes: int = 4 << 20) -> Iterator[list[bytes | None]]:
    """The texts as bytes, in lists of about ``max_bytes``, so that work arrays stay bounded."""
    some, size = [], 0
    for t in texts.cast(pa.binary()):
        some.append(t.as_py())
        size += len(some[-1] or b"") + 16
        if size >= max_bytes:
            yield some
            some, size = [], 0
    if some:
        yield some
