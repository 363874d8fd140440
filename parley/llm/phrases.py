"""Phrase collocations by a multikey three-way quicksort of suffix pointers.

Every word starts a suffix of at most four words, cut at the end of its piece and at a word that is itself infrequent. Suffixes go
to tasks by their two leading words, so a task holds all suffixes of the phrases it counts. There pointers to them
are sorted word by word: each segment is split by a pivot into smaller, equal and larger ones; the size of an equal part is the
count of the phrase read so far, it goes on with the next word, and every part below the least count is abandoned unsorted.
All segments of a task take their step together, as numpy arrays.

Blocks of texts send each distinct suffix once, with its number. Two leading words that may both be very frequent are
split further by the third; their own counts are then summed from the parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import bounded_batches, materialize
from parley.llm.wordhash import U, Words, byte_classes, chunks, mix, rolling, squeezed, unsqueezed

_CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
OUT = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@dataclass(frozen=True)
class Phrases:
    longest: int = 4
    least: int = 30                   # occurrences of a candidate
    top: int = 2000                   # phrases reported per language
    inside: int = 80                  # per cent of its occurrences inside one longer candidate that drop a phrase
    block_bytes: int = 4 << 20
    range_bytes: int = 16 << 20       # text whose distinct words, or whose suffixes, one task holds
    split: int = 500_000              # two leading words that may occur more often are split by the third


_LONGS, _STRINGS, _B = pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()
_BLOCKS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("langs", _STRINGS), ("n", _LONGS), ("words", _B), ("lang_of", _B), ("seq", _B), ("hash", _B), ("times", _B)])
_BLOCKS_DDL = "block long, part int, langs array<string>, n array<long>, words binary, lang_of binary, seq binary, hash binary, times binary"
_IDS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("id", _B), ("f", _B), ("speaks", _B)])
_IDS_DDL = "block long, part int, id binary, f binary, speaks binary"
# rows of two kinds: frequent words by name, packed suffixes
_SUFFIXES = pa.schema([("part", pa.int32()), ("w1", _B), ("w2", _B), ("w3", _B), ("w4", _B), ("times", _B), ("split", _B),
                       ("id", _LONGS), ("lang", _STRINGS), ("word", _STRINGS), ("f", _LONGS)])
_SUFFIXES_DDL = ("part int, w1 binary, w2 binary, w3 binary, w4 binary, times binary, split binary, "
                 "id array<long>, lang array<string>, word array<string>, f array<long>")
_COUNTS = pa.schema([*[(c, pa.int64()) for c in ("w1", "w2", "w3", "w4", "a")], ("lang", pa.string()), ("word", pa.string())])


def _range_of(key: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    at = (key >> U(32)) * U(ranges) >> U(32)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(ranges + 1, dtype=U))


def _encode(p: Phrases, ranges: int):
    """Texts to blocks: the words as local numbers with 0 between pieces, and the distinct words by ranges of their hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, part in enumerate(chunks(batches, ["lang", "text"], "text", p.block_bytes)):
            block = task << 32 | k
            w = Words([t.translate(_LOWER) if t else t for t in part["text"]], _CLASSES)
            langs = sorted({x if x is not None else "und" for x in part["lang"]})
            number = {x: i for i, x in enumerate(langs)}
            lang = np.array([number[x if x is not None else "und"] for x in part["lang"]], np.int64)[w.doc]
            salt = np.array([zlib.crc32(x.encode()) for x in langs], U)
            h, at, local, times = np.unique(mix(w.hash + mix(salt + U(1))[lang]), return_index=True, return_inverse=True, return_counts=True)
            # frequent words first: small numbers
            order = np.argsort(-times, kind="stable")
            h, at, times = h[order], at[order], times[order]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            piece = np.searchsorted(w.breaks, w.start)
            cut = np.r_[False, piece[1:] != piece[:-1]] if len(w) else np.zeros(0, bool)
            seq = np.zeros(len(w) + int(cut.sum()), np.int64)
            seq[np.arange(len(w)) + np.cumsum(cut)] = place[local] + 1
            names = b"\n".join(w.text(i) for i in at)
            rows = [{"block": block, "part": -1, "langs": langs, "n": np.bincount(lang, minlength=len(langs)),
                     "words": len(names).to_bytes(8, "little") + pa.compress(names, "zstd", asbytes=True),
                     "lang_of": squeezed(lang[at]), "seq": squeezed(seq)}]
            order, bounds = _range_of(h, ranges)
            rows[0]["hash"] = squeezed(order)               # the order in which the words are sent
            for r in range(ranges):
                some = order[bounds[r]:bounds[r + 1]]
                if len(some):
                    rows.append({"block": block, "part": r, "hash": h[some].tobytes(), "times": squeezed(times[some])})
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCKS)
    return run


def _frequent(least: int):
    """One range of words: an id for each that occurs often enough; one block of those that hold it is to name it."""
    def run(entries: pa.Table) -> pa.Table:
        rows = entries.to_pylist()
        hashes = [np.frombuffer(r["hash"], U) for r in rows]
        found, first, at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        f = np.zeros(len(found), np.int64)
        np.add.at(f, at, np.concatenate([unsqueezed(r["times"]) for r in rows]))
        often = f >= least
        ident = np.where(often, np.cumsum(often) + (rows[0]["part"] << 32), 0)
        speaks = np.zeros(len(at), np.int64)
        speaks[first[often]] = 1
        out, lo = [], 0
        for r, h in zip(rows, hashes):
            mine = at[lo:lo + len(h)]
            out.append({"block": r["block"], "part": r["part"], "id": squeezed(ident[mine]), "f": squeezed(np.where(often[mine], f[mine], 0)),
                        "speaks": squeezed(speaks[lo:lo + len(h)])})
            lo += len(h)
        return pa.Table.from_pylist(out, schema=_IDS)
    return run


def _suffixes(p: Phrases, ranges: int):
    """A block with the ids of its words: its distinct suffixes by range of their leading words, and the words it is to name."""
    def run(blocks: pa.Table, ids: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _SUFFIXES.empty_table()
        row = blocks.to_pylist()[0]
        raw = row["words"]
        names = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True).split(b"\n")
        lang_of = unsqueezed(row["lang_of"])
        n = len(lang_of)
        ident, f, speaks = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
        place, lo = unsqueezed(row["place"]), 0
        for x in sorted(ids.to_pylist(), key=lambda x: x["part"]):
            i = unsqueezed(x["id"])
            some = place[lo:lo + len(i)]
            ident[some + 1], f[some + 1], speaks[some] = i, unsqueezed(x["f"]), unsqueezed(x["speaks"])
            lo += len(i)
        told = np.flatnonzero(speaks)
        out = []
        if len(told):
            out.append({"part": row["block"] % ranges, "id": ident[told + 1], "lang": [row["langs"][lang_of[i]] for i in told],
                        "word": [names[i].decode("utf-8", "replace") for i in told], "f": f[told + 1]})
        seq = np.r_[unsqueezed(row["seq"]), np.zeros(p.longest, np.int64)]
        g = ident[seq]
        at = np.flatnonzero((g[:-p.longest] > 0) & (g[1:1 - p.longest] > 0))
        w = [g[at], g[at + 1], g[at + 2], g[at + 3]]
        w[3] = np.where(w[2] > 0, w[3], 0)
        key = rolling(np.stack(w, 1).astype(U).ravel(), np.arange(len(at)) * 4, np.arange(len(at)) * 4 + 4)
        _, one, times = np.unique(key, return_index=True, return_counts=True)
        w = [x[one] for x in w]
        at = at[one]
        parts = np.minimum(f[seq[at]], f[seq[at + 1]]) // p.split
        lead = mix(mix(w[0].astype(U)) + w[1].astype(U))
        third = mix(w[2].astype(U) + U(7)) % (parts + 1).astype(U)
        order, bounds = _range_of(mix(lead + third * U(0x9E3779B97F4A7C15)), ranges)
        for r in range(ranges):
            some = order[bounds[r]:bounds[r + 1]]
            if len(some):
                out.append({"part": r, **{f"w{k + 1}": squeezed(w[k][some]) for k in range(4)}, "times": squeezed(times[some]),
                            "split": squeezed((parts[some] > 0).astype(np.int64))})
        return pa.Table.from_pylist(out, schema=_SUFFIXES)
    return run


def quicksort_counts(words: np.ndarray, times: np.ndarray, split: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of the prefixes of 2 words and more of all rows of ``words`` (0 ends a row), at least ``least`` each.

    Rows with ``split`` set share their first two words with other tasks: those pairs are reported at any count.
    Returns (pointer to a row with the prefix, length of the prefix, count) arrays.
    """
    depth_max = words.shape[1]
    flat, out = words.ravel(), []
    ptr, lens, depth = np.arange(len(words)), np.array([len(words)]), np.array([0])
    while len(ptr):
        seg = np.repeat(np.arange(len(lens)), lens)
        key = flat[ptr * depth_max + depth[seg]]
        start = np.cumsum(lens) - lens
        pivot = key[start + lens // 2][seg]
        side = np.where(key < pivot, 0, np.where(key == pivot, 1, 2))
        code = seg * 3 + side
        size = np.bincount(code, minlength=3 * len(lens)).reshape(-1, 3)
        count = np.bincount(code, weights=times[ptr], minlength=3 * len(lens)).reshape(-1, 3).astype(np.int64)
        shared = np.bincount(code, weights=split[ptr], minlength=3 * len(lens)).reshape(-1, 3) > 0
        keep = (size > 0) & ((count >= least) | (shared & (depth < 2)[:, None]))
        # the equal part: a phrase of depth + 1 words, unless the rows end here
        one = np.flatnonzero(keep[:, 1])
        which = np.flatnonzero(side == 1)
        first = which[np.searchsorted(seg[which], one)]
        ended = key[first] == 0
        phrase = ~ended & (depth[one] >= 1)
        out.append((ptr[first[phrase]], depth[one[phrase]] + 1, count[one[phrase], 1]))
        keep[one[ended], 1] = False
        keep[:, 1] &= (depth + 1 < depth_max) & ((count[:, 1] >= least) | (depth < 1))
        parts = [np.flatnonzero((side == s) & keep[seg, s]) for s in range(3)]
        ptr = ptr[np.concatenate(parts)]
        lens, depth = (np.concatenate([x[keep[:, s]] for s, x in enumerate(y)]) for y in
                       ((size[:, 0], size[:, 1], size[:, 2]), (depth, depth + 1, depth)))
    return out


def _count_range(least: int):
    """One range: the counts of its phrases, and as rows of one id the words that blocks named to it."""
    def run(rows: pa.Table) -> pa.Table:
        got = rows.to_pylist()
        named = [r for r in got if r["id"] is not None]
        told = [np.array([x for r in named for x in r["id"]], np.int64), *[np.zeros(sum(len(r["id"]) for r in named), np.int64)] * 3,
                np.array([x for r in named for x in r["f"]], np.int64)]
        texts = [pa.array([x for r in named for x in r[c]], pa.string()) for c in ("lang", "word")]
        out = [pa.table([*told, *texts], schema=_COUNTS)]
        got = [r for r in got if r["id"] is None]
        if got:
            words = np.stack([np.concatenate([unsqueezed(r[f"w{k}"]) for r in got]) for k in range(1, 5)], 1)
            times, split = (np.concatenate([unsqueezed(r[c]) for r in got]) for c in ("times", "split"))
            found = quicksort_counts(words, times, split, least)
            at, length, count = (np.concatenate([x[k] for x in found]) for k in range(3))
            cols = [np.where(length > k, words[at, k], 0) for k in range(4)]
            out.append(pa.table([*cols, count, *[pa.nulls(len(at), pa.string())] * 2], schema=_COUNTS))
        return pa.concat_tables(out)
    return run


def counted(docs: DataFrame, p: Phrases = Phrases()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frequent words: id, lang, word, f), (phrases of 2 to 4 words: w1..w4 as ids, 0 for none, a), (lang, n)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    ranges = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // p.range_bytes
    table = materialize(rows.mapInArrow(_encode(p, ranges), _BLOCKS_DDL), "phrases-blocks")
    blocks = table.where(F.col("part") == -1)
    entries = table.where(F.col("part") >= 0).select("block", "part", "hash", "times")
    ids = entries.repartitionById(ranges, "part").groupBy("part").applyInArrow(_frequent(p.least), _IDS_DDL)
    suffixes = (blocks.select("block", "langs", "words", "lang_of", "seq", F.col("hash").alias("place")).groupBy("block")
                .cogroup(ids.groupBy("block")).applyInArrow(_suffixes(p, ranges), _SUFFIXES_DDL))
    counts = materialize(suffixes.repartitionById(ranges, "part").groupBy("part").applyInArrow(
        _count_range(p.least), "w1 long, w2 long, w3 long, w4 long, a long, lang string, word string"), "phrases-counts")
    names = counts.where(F.col("w2") == 0).select(F.col("w1").alias("id"), "lang", "word", F.col("a").alias("f"))
    found = (counts.where(F.col("w2") > 0).groupBy("w1", "w2", "w3", "w4").agg(F.sum("a").alias("a")).where(F.col("a") >= p.least))
    total = blocks.select(F.explode(F.arrays_zip("langs", "n")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n").alias("n"))
    return names, materialize(found, "phrases-found"), total


def _key(words: list[Column], n: int) -> list[Column]:
    return [*words, *[F.lit(0).cast("long")] * (n - len(words))]


def mine(docs: DataFrame, p: Phrases = Phrases()) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, by score and a (descending), phrase.

    Null lang is ``und``, null text empty; neither gives phrases by itself. Repeated rows and rows with any id count
    as often as they are there. Long texts are counted whole. Equal score and a: by the bytes of the phrase. Empty table, or no
    phrase that is frequent enough: no rows. Other columns are ignored. Words are told apart by 64-bit hashes.
    """
    names, found, total = counted(docs, p)
    w = [F.col(f"w{k}") for k in range(1, 5)]
    size = F.when(w[3] > 0, 4).when(w[2] > 0, 3).otherwise(2)
    cuts = []
    for n in (2, 3, 4):
        for k in range(1, n):
            left, right = _key(w[:k], 3), _key(w[k:n], 3)
            cuts.append(F.when(size == n, F.struct(F.lit(k).alias("k"), *[c.alias(f"l{i}") for i, c in enumerate(left)], *[c.alias(f"r{i}") for i, c in enumerate(right)])))
    cut = found.select("w1", "w2", "w3", "w4", "a", F.explode(F.array_compact(F.array(*cuts))).alias("c")).select("w1", "w2", "w3", "w4", "a", "c.*")
    zero = F.lit(0).cast("long")
    parts = names.select(F.col("id").alias("p0"), zero.alias("p1"), zero.alias("p2"), "f").unionByName(
        found.where(F.col("w4") == 0).select(F.col("w1").alias("p0"), F.col("w2").alias("p1"), F.col("w3").alias("p2"), F.col("a").alias("f")))
    for side in "lr":
        cut = cut.join(parts.select(*[F.col(f"p{i}").alias(f"{side}{i}") for i in range(3)], F.col("f").alias(side)), [f"{side}{i}" for i in range(3)])
    wide = F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    cut = cut.withColumn("sum", F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")).withColumn("wide", wide)
    scored = cut.groupBy("w1", "w2", "w3", "w4", "a").agg(F.min(F.struct(F.expr("wide div sum").alias("score"), "k", "l", "r")).alias("m"))
    inside = []
    for n in (3, 4):
        for m in range(2, n):
            for i in range(n - m + 1):
                inside.append(F.when(size == n, F.struct(*[c.alias(f"w{j + 1}") for j, c in enumerate(_key(w[i:i + m], 4))])))
    longer = (found.where(F.col("w3") > 0).select("a", F.explode(F.array_compact(F.array(*inside))).alias("x"))
              .groupBy("x.w1", "x.w2", "x.w3", "x.w4").agg(F.max("a").alias("longer")))
    kept = scored.join(longer, ["w1", "w2", "w3", "w4"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * p.inside))
    word = (kept.select("w1", "w2", "w3", "w4", "a", "m", F.posexplode(F.array(*w)).alias("i", "id")).where(F.col("id") > 0).join(names.drop("f"), "id")
            .groupBy("w1", "w2", "w3", "w4", "a", "m").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("words")))
    named = word.select("lang", F.array_join(F.col("words.word"), " ").alias("phrase"), "a", "m.l", "m.r", "m.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
