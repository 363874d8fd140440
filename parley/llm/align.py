"""Alignment of two tokenizers' tokens over the same bytes.

Both encode ``space + text``. The byte offsets where tokens end are two increasing lists; the shorter one drives a
galloping search (exponential steps from the last hit, then binary) into the longer one. Common ends cut the tokens
into groups; the differences of neighbouring ranks are the ranges of overlapping tokens, the links.

Counts of linked id pairs are summed over the corpus by ranges of the pair: a block of texts sends each of its pairs once and
gets the total back, so a pair that is everywhere costs one entry a block. The highest count of each id of the second
vocabulary is one number per id, the only thing that is broadcast.
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
from parley.llm.wordhash import U, chunks, mix, squeezed, unsqueezed

# fixed values: the splitting rule of byte-level BPE, and the bytes of texts on which every engine reads it alike
# (ASCII, and letters from U+00C0 to U+017F)
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
OUT = [*COUNTS, "n_best", "count_sum", "groups_sha256"]


@dataclass(frozen=True)
class Alignment:
    byte_level: str = "/opt/tokenizers/byte_bpe_50k.json"       # A; both files must be there on every executor
    pieces: str = "/opt/tokenizers/piece_bpe_32k.model"         # B
    block_bytes: int = 8 << 20        # text of a block
    step_bytes: int = 1 << 20         # text tokenized and aligned at once
    range_bytes: int = 32 << 20       # text whose pairs one range holds
    lane: int = 64                    # ends that one cursor searches


class Vocabularies:
    """The two tokenizers and the bytes of each token."""

    def __init__(self, p: Alignment):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(p.byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=p.pieces)
        # byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [x for x in range(256) if x not in plain]
        byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(other)}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in byte_of for c in token)
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        # the same vocabulary as ranks, a several times faster engine, if the ids after the 256 bytes are in the order of the merges
        with open(p.byte_level) as f:
            merges = json.load(f)["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.fast = None
        if all(vocab.get("".join(m)) == 256 + i for i, m in enumerate(pairs)):
            ranks = {b: i for i, b in enumerate(self.bytes_a[:256 + len(pairs)])}
            self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        top = max(len(self.bytes_a), len(self.bytes_b))
        self.written = [b"%d%s" % (i, mark) for i in range(top) for mark in (b",", b"|", b",", b";")]
        self.len_a, self.len_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Token ids of each text in both vocabularies; empty where the text is, or where tokens don't join to its bytes."""
        none = np.zeros(0, np.int64)
        plain = []
        for t in texts:
            try:
                plain.append(t.decode() if t else "")
            except UnicodeDecodeError:
                plain.append("")
        some = [i for i, s in enumerate(plain) if s]
        a = self._encode_a([" " + plain[i] for i in some], [texts[i] for i in some])
        b = self.b.encode([plain[i] for i in some], out_type=int, num_threads=1)
        out = [(none, none)] * len(texts)
        for i, x, y in zip(some, a, b):
            want = b" " + texts[i]
            if b"".join(map(self.bytes_a.__getitem__, x)) == want and b"".join(map(self.bytes_b.__getitem__, y)) == want:
                out[i] = np.array(x, np.int64), np.array(y, np.int64)
        return out


    def _encode_a(self, texts: list[str], raw: list[bytes]) -> list[list[int]]:
        """Plain texts by the fast engine, all others by the tokenizer itself."""
        out = [None if self.fast is None or t.translate(None, PLAIN) else self.fast.encode_ordinary(s) for s, t in zip(texts, raw)]
        slow = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(slow, self.a.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)):
            out[i] = e.ids
        return out


def gallop(short: np.ndarray, long: np.ndarray, lane: int = 64) -> np.ndarray:
    """For each element of ``short`` the number of smaller elements of ``long``; both increase, and the last element of
    ``long`` isn't smaller than that of ``short``. ``lane`` neighbours share a cursor; all cursors advance together."""
    n = len(short)
    rank = np.empty(n, np.int64)
    begin = np.arange(0, n, lane)
    at = np.searchsorted(long, short[begin])
    for t in range(min(lane, n)):
        if begin[-1] + t >= n:
            begin, at = begin[:-1], at[:-1]
        x = short[begin + t]
        far = np.flatnonzero(long[at] < x)
        if len(far):
            want, low = x[far], at[far] + 1
            high, step = low.copy(), 1
            more = np.arange(len(far))
            while len(more):                       # exponential: until the element at ``high`` is large enough
                more = more[long[np.minimum(high[more], len(long) - 1)] < want[more]]
                low[more] = high[more] + 1
                high[more] += step
                step *= 2
            high = np.minimum(high, len(long) - 1)
            while (low < high).any():              # binary, between the last two steps
                mid = (low + high) >> 1
                less = long[mid] < want
                low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
            at[far] = low
        rank[begin + t] = at
    return rank


class Aligned:
    """Alignment of some texts: per text the counts and the digest of its groups; all links (text, A id, B id)."""

    def __init__(self, tokens: list[tuple[np.ndarray, np.ndarray]], v: Vocabularies, lane: int):
        self.n_a, self.n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
        n = len(tokens)
        a, b = (np.concatenate([np.zeros(0, np.int64), *[t[k] for t in tokens]]) for k in (0, 1))
        doc_a, doc_b = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        # one increasing line of byte offsets for all texts: both vocabularies' tokens cover the same bytes of each
        end_a, end_b = np.cumsum(v.len_a[a]), np.cumsum(v.len_b[b])
        by_a = self.n_a <= self.n_b                                    # texts driven by their A ends
        drive = np.concatenate([end_a[by_a[doc_a]], end_b[~by_a[doc_b]]])
        target = np.concatenate([end_b[by_a[doc_b]], end_a[~by_a[doc_a]]])
        # driven and searched tokens by place: their positions among the A and the B tokens
        d_tok = np.concatenate([np.flatnonzero(by_a[doc_a]), np.flatnonzero(~by_a[doc_b])])
        t_tok = np.concatenate([np.flatnonzero(by_a[doc_b]), np.flatnonzero(~by_a[doc_a])])
        d_order, t_order = np.argsort(drive, kind="stable"), np.argsort(target, kind="stable")
        drive, target, d_tok, t_tok = drive[d_order], target[t_order], d_tok[d_order], t_tok[t_order]
        d_is_a = d_order < int(by_a[doc_a].sum())
        rank = gallop(drive, target, lane) if len(drive) else np.zeros(0, np.int64)
        common = target[rank] == drive if len(drive) else np.zeros(0, bool)
        start = np.r_[0, (rank + common)[:-1]] if len(drive) else rank
        count = rank - start + 1                                       # searched tokens that overlap a driven one
        i = np.repeat(np.arange(len(drive)), count)
        j = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        is_a = d_is_a[i]
        tok_a, tok_b = np.where(is_a, d_tok[i], t_tok[j]), np.where(is_a, t_tok[j], d_tok[i])
        self.doc, self.a, self.b = doc_a[tok_a] if len(i) else i, a[tok_a] if len(i) else i, b[tok_b] if len(i) else i
        self.n_links = np.bincount(self.doc, minlength=n)
        # tokens that end a group
        cut_a, cut_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        cut_d, cut_t, which = d_tok[common], t_tok[rank[common]], d_is_a[common]
        cut_a[np.where(which, cut_d, cut_t)] = True
        cut_b[np.where(which, cut_t, cut_d)] = True
        self.n_groups = np.bincount(doc_a[cut_a], minlength=n)
        self._written = self._groups(a, b, cut_a, cut_b)
        self._ends = np.cumsum(self.n_a + self.n_b)

    @staticmethod
    def _groups(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
        """All tokens in writing order, group by group: 4 * id + 2 * (is B) + (ends its side of the group)."""
        in_a, in_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        groups = int(cut_a.sum())
        size_a, size_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[in_a]] = 4 * a + cut_a
        out[np.arange(len(b)) + np.cumsum(size_a)[in_b]] = 4 * b + 2 + cut_b
        return out

    def digests(self, v: Vocabularies) -> list[str]:
        """sha256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; '' for texts without tokens."""
        out, lo = [], 0
        for hi in self._ends.tolist():
            some = self._written[lo:hi].tolist()
            out.append(hashlib.sha256(b"".join(map(v.written.__getitem__, some))[:-1]).hexdigest() if some else "")
            lo = hi
        return out


_LONGS = pa.list_(pa.int64())
_BLOCKS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ids", _LONGS), *[(c, _LONGS) for c in COUNTS],
                     ("sha", pa.list_(pa.string())), ("distinct", _LONGS), ("used", pa.binary()), ("pairs", pa.binary()), ("times", pa.binary())])
_DDL = ("block long, part int, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
        "sha array<string>, distinct array<long>, used binary, pairs binary, times binary")
_TOTALS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("totals", pa.binary()), ("b", pa.list_(pa.int32())), ("most", _LONGS)])
_TOTALS_DDL = "block long, part int, totals binary, b array<int>, most array<long>"


def _parts(pairs: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs by range (ascending within one) and the bounds of each range."""
    at = (mix(pairs.astype(U)) >> U(32)) * U(ranges) >> U(32)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(ranges + 1, dtype=U))


def _align_blocks(p: Alignment, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, v = TaskContext.get().partitionId(), None
        for k, part in enumerate(chunks(batches, ["doc_id", "text"], "text", p.block_bytes)):
            v = v or Vocabularies(p)
            width = U(len(v.bytes_b))
            block, texts, lo = task << 32 | k, part["text"], 0
            cols: dict[str, list] = {c: [] for c in [*COUNTS, "sha", "distinct"]}
            keys, times = [], []
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or b"") <= p.step_bytes):
                    size += len(texts[hi] or b"")
                    hi += 1
                x = Aligned(v.encode(texts[lo:hi]), v, p.lane)
                pair = x.a.astype(U) * width + x.b.astype(U)
                found, n = np.unique(x.doc.astype(U) << U(40) | pair, return_counts=True)
                keys.append(found & U((1 << 40) - 1))
                times.append(n)
                cols["distinct"] += np.bincount((found >> U(40)).astype(np.int64), minlength=hi - lo).tolist()
                for c in COUNTS:
                    cols[c] += getattr(x, c).tolist()
                cols["sha"] += x.digests(v)
                lo = hi
            keys, times = np.concatenate(keys), np.concatenate(times)
            pairs, local = np.unique(keys, return_inverse=True)
            total = np.bincount(local, weights=times, minlength=len(pairs)).astype(np.int64)
            steps = np.diff(local, prepend=0)
            first = np.cumsum(cols["distinct"]) - cols["distinct"]
            first = first[np.array(cols["distinct"]) > 0]
            steps[first] = local[first]                  # each text's pairs from 0 again
            rows = [{"block": block, "part": -1, "ids": part["doc_id"], **cols, "used": squeezed(steps), "pairs": squeezed(np.diff(pairs.astype(np.int64), prepend=0)), "times": squeezed(times)}]
            order, bounds = _parts(pairs, ranges)
            for r in range(ranges):
                some = order[bounds[r]:bounds[r + 1]]
                if len(some):
                    rows.append({"block": block, "part": r, "pairs": squeezed(np.diff(pairs[some].astype(np.int64), prepend=0)), "times": squeezed(total[some])})
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCKS)
    return run


def _sum_range(width: int):
    """One range: corpus totals of its pairs, sent back to each block in the order it sent them, and the highest per B id."""
    def run(entries: pa.Table) -> pa.Table:
        rows = entries.to_pylist()
        got = [(np.cumsum(unsqueezed(r["pairs"])), unsqueezed(r["times"])) for r in rows]
        pairs, inv = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, inv, np.concatenate([g[1] for g in got]))
        b = pairs % width
        most = np.zeros(width, np.int64)
        np.maximum.at(most, b, total)
        ids = np.flatnonzero(most)
        out, lo = [], 0
        for k, (r, g) in enumerate(zip(rows, got)):
            mine = total[inv[lo:lo + len(g[0])]]
            lo += len(g[0])
            out.append({"block": r["block"], "part": r["part"], "totals": squeezed(mine), "b": ids if k == 0 else None, "most": most[ids] if k == 0 else None})
        return pa.Table.from_pylist(out, schema=_TOTALS)
    return run


_RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _per_document(ranges: int, width: int, most: np.ndarray):
    def run(blocks: pa.Table, totals: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _RESULT.empty_table()
        row = blocks.to_pylist()[0]
        pairs = np.cumsum(unsqueezed(row["pairs"]))
        order, bounds = _parts(pairs, ranges)
        total = np.zeros(len(pairs), np.int64)
        for t in totals.to_pylist():
            total[order[bounds[t["part"]]:bounds[t["part"] + 1]]] = unsqueezed(t["totals"])
        best = total == most[pairs % width]
        steps, times = unsqueezed(row["used"]), unsqueezed(row["times"])
        distinct = np.array(row["distinct"], np.int64)
        ends = np.cumsum(distinct)
        run_sum = np.cumsum(steps)
        doc = np.repeat(np.arange(len(distinct)), distinct)
        before = np.r_[0, run_sum][(ends - distinct)]
        local = run_sum - before[doc]
        counted, bested = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        np.add.at(counted, doc, total[local] * times)
        np.add.at(bested, doc, best[local] * times)
        return pa.table([row["ids"], *[row[c] for c in COUNTS], bested, counted, row["sha"]], schema=_RESULT)
    return run


def aligned(docs: DataFrame, p: Alignment = Alignment()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that either vocabulary's tokens don't join to, have no tokens: zeros and ''. Rows with null or
    repeated ids are counted like others (each row is a document of the corpus). Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // p.range_bytes
    table = materialize(rows.mapInArrow(_align_blocks(p, ranges), _DDL), "align-blocks")
    width = len(Vocabularies(p).bytes_b)
    entries = table.where(F.col("part") >= 0).select("block", "part", "pairs", "times")
    totals = materialize(entries.groupBy("part").applyInArrow(_sum_range(width), _TOTALS_DDL), "align-totals")
    # at most one number per id of the second vocabulary
    highest = totals.where(F.col("b").isNotNull()).select(F.explode(F.arrays_zip("b", "most")).alias("x")).groupBy("x.b").agg(F.max("x.most").alias("most"))
    most = np.zeros(width, np.int64)
    for r in highest.collect():
        most[r.b] = r.most
    answers = totals.select("block", "part", "totals")
    blocks = table.where(F.col("part") == -1).drop("part")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _per_document(ranges, width, most), "doc_id long, " + ", ".join(f"{c} long" for c in [*COUNTS, "n_best", "count_sum"]) + ", groups_sha256 string")
