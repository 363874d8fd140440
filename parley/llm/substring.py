"""Substring dedup by relative Lempel-Ziv parsing.

Documents are cut into reference blocks of a few megabytes. A block's index holds its *stretches*: every window of
``window`` words is owned by the smallest half-window word sequence in it (its anchor), and neighbouring windows with one
anchor form a stretch. A document is parsed against every block: the indexes of all blocks meet by ranges of the
anchor, where each stretch, and then each window of stretches that only partly agree, learns its source, the smallest
earlier document that holds it. The parse of a document is greedy, from the left: a factor starts at a window with a source and runs
on as long as the windows of that source do; the search goes on with the first window that reaches over the factor's
boundary, so that nothing that straddles two factors is lost. Factors of ``window`` words or more are the duplicate spans.

No task holds the owners of a frequent passage: a block sends a stretch once, with its first document, however often
it occurs there, and gets one answer. Work and shuffled data are proportional to the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bounded_batches, materialize
from parley.llm.wordhash import U, Words, byte_classes, chunks, mix, rolling

_CLASSES = byte_classes(b" \t\n\x0b\x0c\r")
OUT = ["n_words", "n_removed", "kept_sha256", "factors"]
_FACTORS = "array<struct<start:long,n_words:long,source:long>>"


@dataclass(frozen=True)
class SubstringDedup:
    window: int = 50                 # words of the shortest duplicate
    block_bytes: int = 4 << 20       # text of a reference block
    range_bytes: int = 64 << 20      # text whose stretches one range of anchors holds


class _Stretches:
    """The stretches of a block: documents' words, and per stretch anchor, hash, owned windows (first, last), document."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], window: int):
        self.words = w = Words(texts, _CLASSES)
        self.per_doc = np.bincount(w.doc, minlength=len(texts))
        n, half = len(w), window // 2
        known = np.fromiter((i is not None for i in ids), bool, len(ids))
        self.ids = np.fromiter((0 if i is None else i for i in ids), np.int64, len(ids))
        s = np.arange(max(0, n - window + 1))
        s = s[(w.doc[s] == w.doc[s + window - 1]) & known[w.doc[s]]] if n else s
        if not len(s):
            self.anchor = self.hash = np.zeros(0, U)
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            return
        gram = rolling(w.hash, np.arange(n - half + 1), np.arange(half, n + 1))
        # the smallest gram of a window, the leftmost of equal ones: position in the low bits, least over window - half + 1 grams
        bits = U(max(1, int(n).bit_length()))
        low = ((gram >> bits) << bits) | np.arange(len(gram), dtype=U)
        span, have = window - half + 1, 1
        while have * 2 <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        low = np.minimum(low[s], low[s + span - have])
        at = (low & ((U(1) << bits) - U(1))).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)])
        self.first, self.last = s[new], s[np.r_[new[1:], len(s)] - 1]
        self.anchor = gram[at[new]]
        self.hash = rolling(w.hash, self.first, self.last + window)
        self.doc = w.doc[self.first]


def _firsts(anchor: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by (anchor, key, doc), their class numbers, and a mask of each class's first entry."""
    order = np.lexsort((doc, key, anchor))
    a, k = anchor[order], key[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (k[1:] != k[:-1])] if len(a) else np.zeros(0, bool)
    return order, np.cumsum(new) - 1, new


def _split(anchor: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by range of the anchor and the bounds of each range. Anchors are smallest values, so they are scrambled first."""
    at = (mix(anchor) >> U(32)) * U(ranges) >> U(32)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(ranges + 1, dtype=U))


_BLOCKS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())),
                     ("texts", pa.binary()), ("anchor", pa.binary()), ("key", pa.binary()), ("doc", pa.binary())])
_ENTRIES = pa.schema([f for f in _BLOCKS if f.name in ("block", "part", "anchor", "key", "doc")])
_ANSWERS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("at", pa.binary()), ("source", pa.binary()), ("open", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _entry_rows(block: int, anchor: np.ndarray, key: np.ndarray, doc: np.ndarray, ranges: int) -> Iterator[dict]:
    order, bounds = _split(anchor, ranges)
    for r in range(ranges):
        some = order[bounds[r]:bounds[r + 1]]
        if len(some):
            yield {"block": block, "part": r, "anchor": anchor[some].tobytes(), "key": key[some].tobytes(), "doc": doc[some].tobytes()}


def _index(p: SubstringDedup, ranges: int):
    """Rows of documents to blocks: one row with the texts (compressed), one per range with the stretches that occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, part in enumerate(chunks(batches, ["doc_id", "text"], "text", p.block_bytes)):
            block = task << 32 | k
            s = _Stretches(part["doc_id"], part["text"], p.window)
            ids = s.ids[s.doc]
            order, _, new = _firsts(s.anchor, s.hash, ids)
            one = order[new]
            whole = b"".join(t or b"" for t in part["text"])
            row = {"block": block, "part": -1, "ids": part["doc_id"], "lens": [len(t or b"") for t in part["text"]],
                   "texts": len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)}
            rows = [row, *_entry_rows(block, s.anchor[one], s.hash[one], ids[one], ranges)]
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCKS)
    return run


def _sources(entries: pa.Table) -> pa.Table:
    """One range: for each block's entries, those with a source in a smaller document, and those that stay open:
    first of their kind, while the anchor occurs with other surroundings too."""
    n = [len(x.as_py()) // 8 for x in entries["anchor"]]
    cols = [np.frombuffer(b"".join(entries[c].to_pylist()), t) for c, t in (("anchor", U), ("key", U), ("doc", np.int64))]
    order, group, new = _firsts(*cols)
    first = cols[2][order][new]
    source = np.empty(len(order), np.int64)
    source[order] = first[group]
    a = cols[0][order][new]
    kinds = np.r_[True, a[1:] != a[:-1]]
    several = np.bincount(np.cumsum(kinds) - 1)[np.cumsum(kinds) - 1] > 1        # per class: its anchor has other classes
    waiting = np.zeros(len(order), bool)
    waiting[order] = several[group]
    later = source < cols[2]
    rows, end = [], np.cumsum(n)
    for block, part, e, m in zip(entries["block"].to_pylist(), entries["part"].to_pylist(), end, n):
        got, opened = np.flatnonzero(later[e - m:e]), np.flatnonzero((waiting & ~later)[e - m:e])
        if len(got) or len(opened):
            rows.append({"block": block, "part": part, "at": got.astype(np.int32).tobytes(),
                         "source": source[e - m:e][got].tobytes(), "open": opened.astype(np.int32).tobytes()})
    return pa.Table.from_pylist(rows, schema=_ANSWERS)


def _answered(answers: pa.Table, order: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(has a source, source, is open) of a block's ``n`` entries in the order they were made."""
    has, source, opened = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, bool)
    for x in answers.to_pylist():
        at = order[bounds[x["part"]] + np.frombuffer(x["at"], np.int32)]
        has[at], source[at] = True, np.frombuffer(x["source"], np.int64)
        opened[order[bounds[x["part"]] + np.frombuffer(x["open"], np.int32)]] = True
    return has, source, opened


class _Block:
    """A block read back, its stretches with what the ranges answered about them."""

    def __init__(self, row: dict, answers: pa.Table, p: SubstringDedup, ranges: int):
        raw = row["texts"]
        whole = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)
        ends = np.cumsum([0, *row["lens"]])
        self.doc_ids, self.texts = row["ids"], [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]
        self.s = s = _Stretches(self.doc_ids, self.texts, p.window)
        self.ids = s.ids[s.doc]
        order, group, new = _firsts(s.anchor, s.hash, self.ids)
        one = order[new]
        has, source, opened = _answered(answers, *_split(s.anchor[one], ranges), len(one))
        smallest = np.where(has, source, self.ids[one])              # the first document of each kind of stretch
        self.source = np.empty(len(order), np.int64)                # per stretch
        self.source[order] = smallest[group]
        self.open = np.zeros(len(order), bool)
        self.open[order] = opened[group]
        self.open &= self.source == self.ids                        # a later document needs no more: all its windows are known
        # windows of open stretches, each kind of stretch once
        self.query = one[opened]
        count = s.last[self.query] - s.first[self.query] + 1
        self.q_of = np.repeat(np.arange(len(self.query)), count)
        self.q_off = np.arange(len(self.q_of)) - np.repeat(np.cumsum(count) - count, count)
        start = s.first[self.query][self.q_of] + self.q_off
        self.q_key = rolling(s.words.hash, start, start + p.window)
        self.q_anchor, self.q_doc = s.anchor[self.query][self.q_of], self.ids[self.query][self.q_of]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = group
        self.number = np.full(len(one), -1)
        self.number[np.flatnonzero(opened)] = np.arange(len(self.query))


def _open_windows(p: SubstringDedup, ranges: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _ENTRIES.empty_table()
        b = _Block(blocks.to_pylist()[0], answers, p, ranges)
        rows = _entry_rows(blocks["block"][0].as_py(), b.q_anchor, b.q_key, b.q_doc, ranges)
        return pa.Table.from_pylist(list(rows), schema=_ENTRIES)
    return run


def parse(n_windows: int, source: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Greedy factors (start, words, source) of one document from the sources of its windows (-1: none): the factor at a
    window runs while the source stays; the next search starts at the first window that the factor doesn't contain."""
    has = source >= 0
    cut = np.flatnonzero(np.r_[True, source[1:] != source[:-1]]) if n_windows else np.zeros(0, np.int64)
    end = np.r_[cut[1:], n_windows]
    return [(int(a), int(b - a) + window - 1, int(source[a])) for a, b in zip(cut, end) if has[a]]


def _parsed(p: SubstringDedup, ranges: int, with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
              ("factors", pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("source", pa.int64())])))]
    schema = pa.schema([*fields, ("kept_text", pa.string()), ("text_key", pa.binary())] if with_text else fields)

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return schema.empty_table()
        second = pa.compute.greater(answers["round"], 1)
        first, second = (answers.filter(m).drop_columns("round") for m in (pa.compute.invert(second), second))
        b = _Block(blocks.to_pylist()[0], first, p, ranges)
        s, w = b.s, b.s.words
        has, source, _ = _answered(second, *_split(b.q_anchor, ranges), len(b.q_key))
        q_start = np.searchsorted(b.q_of, np.arange(len(b.query)))
        per_window = np.full(len(w) + 1, np.iinfo(np.int64).min)      # source of the window at each word
        none = np.iinfo(np.int64).min
        later = np.flatnonzero(b.source < b.ids)
        count = s.last[later] - s.first[later] + 1
        at = np.repeat(s.first[later] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        per_window[at] = np.repeat(b.source[later], count)
        for k in np.flatnonzero(b.open):
            q = q_start[b.number[b.group[k]]]
            m = int(s.last[k] - s.first[k] + 1)
            got = has[q:q + m]
            per_window[s.first[k]:s.last[k] + 1][got] = source[q:q + m][got]
        hit = per_window != none
        ends = np.cumsum(s.per_doc)
        covered = np.zeros(len(w) + 1, np.int64)
        starts = np.flatnonzero(hit)
        np.add.at(covered, starts, 1)
        np.add.at(covered, np.minimum(starts + p.window, len(w)), -1)
        gone = np.cumsum(covered[:-1]) > 0
        rows = []
        for i, (doc, text) in enumerate(zip(b.doc_ids, b.texts)):
            lo, hi = int(ends[i] - s.per_doc[i]), int(ends[i])
            removed = int(gone[lo:hi].sum())
            found = text.split()
            if removed:
                found = [found[j] for j in np.flatnonzero(~gone[lo:hi])]
            kept = b" ".join(found)
            factors = []
            if removed:
                # dense numbers for sources, so that any id is allowed
                names, code = np.unique(per_window[lo:hi], return_inverse=True)
                code = np.where(names[code] == none, -1, code)
                factors = [{"start": a, "n_words": n, "source": int(names[c])} for a, n, c in parse(hi - lo, code, p.window)]
            row = {"doc_id": doc, "n_words": hi - lo, "n_removed": removed, "kept_sha256": hashlib.sha256(kept).hexdigest(), "factors": factors}
            if with_text:
                row |= {"kept_text": kept.decode("utf-8", "replace"), "text_key": hashlib.sha256(text).digest()}
            rows.append(row)
        return pa.Table.from_pylist(rows, schema=schema)
    return run


def _parse_all(docs: DataFrame, p: SubstringDedup, with_text: bool) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 + size // p.range_bytes
    index = materialize(rows.mapInArrow(_index(p, ranges), _ddl(_BLOCKS)), "substring-blocks")
    blocks = index.where(F.col("part") == -1).select("block", "ids", "lens", "texts")
    entries = index.where(F.col("part") >= 0).select("block", "part", "anchor", "key", "doc")
    first = materialize(entries.repartitionById(ranges, "part").groupBy("part").applyInArrow(_sources, _ddl(_ANSWERS)), "substring-sources")
    opened = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_open_windows(p, ranges), _ddl(_ENTRIES))
    second = opened.repartitionById(ranges, "part").groupBy("part").applyInArrow(_sources, _ddl(_ANSWERS))
    answers = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    more = ", kept_text string, text_key binary" if with_text else ""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _parsed(p, ranges, with_text), f"doc_id long, n_words long, n_removed long, kept_sha256 string, factors {_FACTORS}{more}")


def parsed(docs: DataFrame, p: SubstringDedup = SubstringDedup()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, factors (start word, words, source doc_id).

    A word is removed if it lies in a window that also starts in a document with a smaller id. Null or empty text: no
    words. A null id is neither a source nor has one. Repeated rows, and rows with one id and different texts, don't remove each other's
    words, since no id is smaller. Texts of fewer than ``window`` words stay whole. Empty table: no rows. Words are told apart by 64-bit
    hashes, stretches and windows by two of them. Other columns are ignored.
    """
    return _parse_all(docs.select("doc_id", "text"), p, False)


def deduplicated(docs: DataFrame, p: SubstringDedup = SubstringDedup()) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256, factors and kept_text (the words left, joined by one space; null stays null).

    All columns and rows stay; input columns of these names are replaced. Odd input: as ``parsed``.
    """
    docs = docs.drop(*OUT, "kept_text")
    found = _parse_all(docs.select("doc_id", "text"), p, True).dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias("_sd_id"), F.col("text_key").alias("_sd_key"), *OUT, "kept_text")
    keyed = docs.withColumn("_sd_text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    out = keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_sd_id")) & (F.col("_sd_text") == F.col("_sd_key")), "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *OUT, F.when(F.col("text").isNotNull(), F.col("kept_text")).alias("kept_text"))
