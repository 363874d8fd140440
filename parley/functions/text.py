"""Scalar text functions (Column -> Column), all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters that end a sentence for endpointing: . ! ?
PUNCTUATION = (".", "!", "?")

# Word and sentence patterns (ours; the reference's tokenizers are third-party defaults).
WORD_RE = r"[^ \t\n\r\f]+"
SENTENCE_RE = r"[^.!?]+[.!?]*"


def ends_with_punct(text: Column) -> Column:
    """Last character in . ! ?; false when empty or null."""
    return F.coalesce(F.right(text, F.lit(1)).isin(*PUNCTUATION), F.lit(False))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words (0 for empty / null)."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.regexp_extract_all(text, F.lit(WORD_RE), 0)))


# Whitespace stripped from both ends (as str.strip for ASCII whitespace).
STRIP_RE = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(STRIP_RE), F.lit(""))
