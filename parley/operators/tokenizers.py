"""Tokenizer hooks: sentence, word and hyphenation tokenizers of the caller's, as Python table functions.

A hook is a factory that builds a tokenizer, text -> list of strings, once per partition. ``token_table`` makes a table function of
it that is used in SQL or in a lateral join, ``tokens`` applies it to a column of texts. The hyphenator takes the caller's
patterns; none are shipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

Tokenizer = Callable[[str], Iterable[str]]


def token_table(factory: Callable[[], Tokenizer], token: str = "token"):
    """Table function (text) -> rows (idx from 0, ``token``). Null text gives no rows; any other argument is refused when analyzed."""

    class Tokens:
        def __init__(self):
            self._tokenize = factory()

        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(text.dataType, StringType):
                raise ValueError(f"a tokenizer takes a string, not {text.dataType.simpleString()}")
            return AnalyzeResult(StructType().add("idx", IntegerType()).add(token, StringType()))

        def eval(self, text: str):
            if text is not None:
                yield from enumerate(self._tokenize(text))

    return F.udtf(Tokens)


def tokens(texts: DataFrame, factory: Callable[[], Tokenizer], column: str = "text", token: str = "token") -> DataFrame:
    """``texts`` with a row per token: its columns but ``column``, idx and ``token``. Texts without tokens give no row."""
    table = token_table(factory, token)
    return texts.lateralJoin(table(F.col(column).outer())).drop(column)


class Hyphenator:
    """Hyphenation by patterns: a pattern's letters match anywhere in ``.word.`` (the dots are the word's ends), its digits are
    weights of the places between them; where the largest weight is odd the word may be broken."""

    def __init__(self, patterns: Iterable[str], left: int = 2, right: int = 2):
        self.left, self.right = left, right
        self._trie: dict = {}
        for pattern in patterns:
            letters, weights = [], [0]
            for c in pattern:
                if c.isdigit():
                    weights[-1] = int(c)
                else:
                    letters.append(c)
                    weights.append(0)
            node = self._trie
            for c in letters:
                node = node.setdefault(c, {})
            node[""] = [max(a, b) for a, b in zip(node.get("", [0] * len(weights)), weights)]

    def __call__(self, word: str) -> list[str]:
        """The parts of ``word``, whole if it can't be broken: at least ``left`` characters first and ``right`` last."""
        text = f".{word.lower()}."
        weights = [0] * (len(text) + 1)
        for i in range(len(text)):
            node = self._trie
            for c in text[i:]:
                if c not in node:
                    break
                node = node[c]
                for k, w in enumerate(node.get("", ())):
                    weights[i + k] = max(weights[i + k], w)
        cuts = [k for k in range(max(self.left, 1), len(word) - self.right + 1) if weights[k + 1] % 2] if len(text) == len(word) + 2 else []
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if word else []


def hyphenate_words(words: DataFrame, patterns: list[str], left: int = 2, right: int = 2) -> DataFrame:
    """``words`` (word, any others) with its ``parts``: idx and part, a row each."""
    table = token_table(lambda: Hyphenator(patterns, left, right), "part")
    return words.lateralJoin(table(F.col("word").outer()))
