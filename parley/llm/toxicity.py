"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy on all labelled rows.

A word's vector is the sum of hashed embeddings of the word, its beginnings and its endings, so
unseen inflections of a known stem still score. Filters of several widths slide over the words of
the whole text; the maximum of each filter goes into a logistic output. Only the windows of
the maxima get gradients. Every labelled row trains or calibrates. The rows lie in blocks by a hash of the id; in each epoch every block's task
trains a copy of the model on its rows, and the means of the copies (of an embedding: of those that changed it) are the next
epoch's model. Held-out ids, lang, source and doc_id never reach
the score. A share of the rows calibrates: the score is stretched so that 0.7 is the best cut, and each
language gets its own threshold on the score for the ``flagged`` column.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bounded_batches, id_hash, learnable
from parley.llm.textbytes import pieces, words


@dataclass(frozen=True)
class Toxicity:
    buckets: int = 1 << 17
    dim: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8              # of each width
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    block_rows: int = 8192        # expected rows of a block
    blocks: int = 64              # at most; from there on blocks grow with the rows, which a task reads in chunks
    chunk_rows: int = 1024
    chunk_bytes: int = 2 << 20
    slices: int = 64              # of the embeddings, where the blocks' copies meet
    max_bits: int = 27            # the bitmap that spares most texts without a label the shuffle has at most 2 ** max_bits bits
    cells: int = 1024             # of one unit of the logit, between which cuts lie
    calibrate_share: float = 0.25
    cut: float = 0.7
    seed: int = 11


def features(word: bytes, buckets: int) -> list[int]:
    """Buckets of the word, its first 3 to 6 and its last 3 and 4 bytes (whole word where it is shorter)."""
    h = zlib.crc32
    return [h(word) % buckets, h(word[:3], 1) % buckets, h(word[:4], 2) % buckets, h(word[:5], 3) % buckets,
            h(word[:6], 4) % buckets, h(word[-3:], 5) % buckets, h(word[-4:], 6) % buckets]


N_FEATURES = 7


class Cnn:
    def __init__(self, p: Toxicity):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.emb = (rng.standard_normal((p.buckets, p.dim)) * 0.05).astype(np.float32)
        self.conv = [(rng.standard_normal((w, p.dim, p.filters)) * 0.3).astype(np.float32) for w in p.widths]
        self.bias = np.zeros(len(p.widths) * p.filters, np.float32)
        self.out = (rng.standard_normal(len(p.widths) * p.filters) * 0.3).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.mean, self.square, self.step = [np.zeros_like(a) for a in self.flat()], [np.zeros_like(a) for a in self.flat()], 0   # Adam
        self.emb_square = np.zeros(p.buckets, np.float32)   # Adagrad
        self.stretch, self.shift = 1.0, 0.0
        self.thresholds: dict[str | None, float] = {}

    def flat(self) -> list[np.ndarray]:
        return [*self.conv, self.bias, self.out, self.base]

    # A batch lies end to end with ``pad`` zero words around every document, so no window sees two documents.
    def layout(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (0: padding, else 1 + index) and the start of each document."""
        pad = np.zeros(max(self.p.widths) - 1 or 1, np.int64)
        parts, starts, at = [], [], 0
        for d in docs:
            parts += [pad, d + 1, pad]
            starts.append(at)
            at += len(d) + 2 * len(pad)
        return np.concatenate([*parts, pad]), np.array(starts)

    def responses(self, x: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """Filter responses at each window start; x: vector of each word number."""
        out, n = [], len(ids)
        for k, w in enumerate(self.p.widths):
            b = self.bias[k * self.p.filters:(k + 1) * self.p.filters]
            z = np.zeros((n, self.p.filters), np.float32)
            for j in range(w):
                z[: n - j] += (x @ self.conv[k][j])[ids[j:]]
            out.append(z + b)
        return out

    def pooled(self, x: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum.reduceat(z, starts, axis=0) for z in self.responses(x, ids)], 1)

    def pooled_long(self, x: np.ndarray, doc: np.ndarray, piece_words: int) -> np.ndarray:
        """The maxima over one long text, by pieces that overlap by a window less one word."""
        ids, _ = self.layout([doc])
        best, over = np.full(len(self.out), -np.inf, np.float32), max(self.p.widths) - 1
        for a in range(0, len(ids), piece_words):
            part = ids[a:a + piece_words + over]
            ends = a + len(part) >= len(ids)
            zs = self.responses(x, part)
            best = np.maximum(best, np.concatenate([z[: len(z) if ends else piece_words].max(0) for z in zs]))
        return best

    def logits(self, texts: list[bytes | None], piece_words: int = 100_000) -> np.ndarray:
        """Whole texts; a text of more than ``piece_words`` words is pooled over overlapping pieces."""
        index: dict[bytes, int] = {}
        docs = [np.fromiter((index.setdefault(w, len(index)) for w in words(t)), np.int64) for t in texts]
        feats = np.array([features(w, self.p.buckets) for w in index], np.int64).reshape(-1, N_FEATURES)
        x = np.zeros((len(index) + 1, self.p.dim), np.float32)
        for j in range(N_FEATURES):
            x[1:] += self.emb[feats[:, j]]
        best = np.full((len(texts), len(self.out)), -np.inf, np.float32)
        size, some, own = 0, [], []
        for k, d in enumerate(docs):
            if len(d) > piece_words:
                best[k] = self.pooled_long(x, d, piece_words)
                continue
            some.append(d)
            own.append(k)
            size += len(d)
            if size >= piece_words:
                best[own] = self.pooled(x, *self.layout(some))
                size, some, own = 0, [], []
        if some:
            best[own] = self.pooled(x, *self.layout(some))
        return np.maximum(best, 0) @ self.out + self.base[0]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) * self.stretch + self.shift, -30, 30).astype(float)))

    def train(self, texts: list[bytes], toxic: np.ndarray, share: float, epoch: int, rng: np.random.Generator) -> None:
        """One pass over some rows; share: of toxic rows among all that train."""
        p, index = self.p, {}
        docs = [np.fromiter((index.setdefault(w, len(index)) for w in words(t)), np.int64) for t in texts]
        feats = np.array([features(w, p.buckets) for w in index], np.int64).reshape(-1, N_FEATURES)
        weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share))
        rate = p.rate * (1 - epoch / p.epochs)
        order = rng.permutation(len(docs))
        for at in range(0, len(order), p.batch):
            pick = order[at:at + p.batch]
            ids, starts = self.layout([docs[i] for i in pick])
            used, ids = np.unique(ids, return_inverse=True)
            if used[0] != 0:
                used, ids = np.concatenate([[0], used]), ids + 1
            f = feats[used[1:] - 1]
            x = np.zeros((len(used), p.dim), np.float32)
            for j in range(N_FEATURES):
                x[1:] += self.emb[f[:, j]]
            zs = self.responses(x, ids)
            ends = np.append(starts[1:], len(ids))
            top = np.stack([np.concatenate([s + z[s:e].argmax(0) for z in zs]) for s, e in zip(starts, ends)])
            val = np.concatenate([z[top[:, k * p.filters:(k + 1) * p.filters], np.arange(p.filters)] for k, z in enumerate(zs)], 1)
            h = np.maximum(val, 0)
            prob = 1 / (1 + np.exp(-np.clip(h @ self.out + self.base[0], -30, 30)))
            g = ((prob - toxic[pick]) * weight[pick] / len(pick)).astype(np.float32)
            gh = g[:, None] * self.out * (val > 0)
            grads = [np.zeros_like(a) for a in self.conv] + [gh.sum(0), h.T @ g, np.array([g.sum()], np.float32)]
            gx = np.zeros_like(x)
            for k, w in enumerate(p.widths):
                s = slice(k * p.filters, (k + 1) * p.filters)
                for j in range(w):
                    at_word = ids[np.minimum(top[:, s] + j, len(ids) - 1)]
                    grads[k][j] = np.einsum("nf,nfd->df", gh[:, s], x[at_word])
                    np.add.at(gx, at_word.ravel(), (gh[:, s, None] * self.conv[k][j].T[None]).reshape(-1, p.dim))
            self.step += 1
            for a, b, mm, vv in zip(self.flat(), grads, self.mean, self.square):   # Adam
                mm += 0.1 * (b - mm)
                vv += 0.001 * (b * b - vv)
                a -= rate * (mm / (1 - 0.9 ** self.step)) / (np.sqrt(vv / (1 - 0.999 ** self.step)) + 1e-8)
            hot = np.flatnonzero(np.abs(gx[1:]).sum(1) > 0)   # Adagrad for the few touched rows
            fi, gi = f[hot].ravel(), np.repeat(gx[1:][hot], N_FEATURES, axis=0)
            np.add.at(self.emb_square, fi, (gi * gi).mean(1))
            np.add.at(self.emb, fi, -5 * rate * gi / (np.sqrt(self.emb_square[fi]) + 1e-6)[:, None])

    def calibrate(self, cuts: list[tuple[bool, str | None, float]]) -> None:
        """0.7 becomes the best cut of the logits on rows kept from training; then a threshold for each language.
        cuts: (over all languages, language, cut)."""
        cut = next(c for every, _, c in cuts if every)
        self.stretch = 1.0
        self.shift = float(np.log(self.p.cut / (1 - self.p.cut))) - cut
        self.thresholds = {name: float(1 / (1 + np.exp(-np.clip(c + self.shift, -30, 30)))) for every, name, c in cuts if not every}


def best_cut(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, clean: np.ndarray, none: float = -np.inf) -> float:
    """The middle of the gap in the logits with the most right decisions (classes weighing alike). A cell of logits, in
    ascending order, has its lowest and highest one and its rows of each class. If the logit of a text without words lies
    in the gap, only what is above it counts: such a text isn't toxic."""
    if len(low) < 2:
        return float((low[0] + high[0]) / 2)
    right = np.cumsum(clean)[:-1] / max(1, clean.sum()) - np.cumsum(toxic)[:-1] / max(1, toxic.sum())
    k = np.lexsort((low[1:] - high[:-1], np.round(right, 6)))[-1]
    return float(((max(high[k], none) if none < low[k + 1] else high[k]) + low[k + 1]) / 2)


def _likely_marked(docs: DataFrame, marked: DataFrame, n: int, p: Toxicity) -> DataFrame:
    """All rows of ``docs`` with an id in ``marked`` (n ids) and few others, by a bitmap of hashes; it spares the others' texts the shuffle."""
    bits = min(p.max_bits, max(15, (16 * n).bit_length()))
    place = F.shiftrightunsigned(id_hash(p.seed + 2), 64 - bits)
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1))
    maps = marked.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_map"))
    byte = F.substring("_map", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
    held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    # at most 2 ** (max_bits - 15) rows of 4 KB
    return docs.withColumn("_bucket", bucket).join(F.broadcast(maps), "_bucket").where(held).select(*docs.columns)


def examples(docs: DataFrame, marked: DataFrame, n: int, p: Toxicity) -> DataFrame:
    """(block, doc_id, toxic, text, lang, spare): every document of the n marked ids, of an id's texts the smallest; a partition for each block,
    in order of a hash of the id. Spare rows calibrate."""
    blocks = min(p.blocks, -(-n // p.block_rows))
    one = (_likely_marked(docs.select("doc_id", "text", "lang"), marked, n, p).join(marked, "doc_id").groupBy("doc_id", "toxic")
               .agg(F.min(F.struct(F.isnull("text").alias("none"), "text", "lang")).alias("one")))
    place = id_hash(p.seed)
    spare = id_hash(p.seed + 1) / 2.0 ** 64 + 0.5 < p.calibrate_share
    rows = one.select(F.pmod(place, F.lit(blocks)).cast("int").alias("block"), "doc_id", "toxic", "one.text", "one.lang", spare.alias("spare"))
    return rows.repartitionById(blocks, "block").sortWithinPartitions("block", place, "doc_id")


def _chunks(batches: Iterator[pa.RecordBatch], p: Toxicity) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Block, texts and marks of some rows of one block."""
    texts, marks, size, block = [], [], 0, None
    for batch in batches:
        for b, t, y in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            if texts and (b != block or len(texts) >= p.chunk_rows or size >= p.chunk_bytes):
                yield block, texts, np.array(marks, np.float32)
                texts, marks, size = [], [], 0
            block = b
            texts.append(t.as_py() or b"")
            marks.append(y)
            size += len(texts[-1])
    if texts:
        yield block, texts, np.array(marks, np.float32)


_COPY = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("at", pa.binary()), ("value", pa.binary()), ("square", pa.binary())])
_COPY_DDL = "part int, block int, n long, at binary, value binary, square binary"


def _trained(sent, p: Toxicity, epoch: int, share: float):
    """sent: broadcast of the model. Rows of blocks -> each block's copy after the epoch: part -1 has the small arrays, the others the changes of the
    embeddings in a slice, as far as there are any."""
    def out(own: Cnn, block: int, n: int) -> pa.RecordBatch:
        model = sent.value
        small = np.concatenate([a.ravel() for a in [*own.flat(), *own.mean, *own.square]])
        rows = [(-1, block, n, np.int64(own.step).tobytes(), small.tobytes(), b"")]
        at = np.flatnonzero((own.emb != model.emb).any(1) | (own.emb_square != model.emb_square))
        edges = np.searchsorted(at * p.slices // p.buckets, np.arange(p.slices + 1))
        for part in range(p.slices):
            a = at[edges[part]:edges[part + 1]]
            if len(a):
                rows.append((part, block, n, a.astype(np.int32).tobytes(), (own.emb[a] - model.emb[a]).tobytes(),
                             (own.emb_square[a] - model.emb_square[a]).tobytes()))
        return pa.RecordBatch.from_pylist([dict(zip(_COPY.names, r)) for r in rows], _COPY)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, n, rng = None, None, 0, None
        for block, texts, toxic in _chunks(batches, p):
            if block != at:
                if own is not None:
                    yield out(own, at, n)
                own, at, n, rng = copy.deepcopy(sent.value), block, 0, np.random.default_rng([p.seed, epoch, block])
            own.train(texts, toxic, share, epoch, rng)
            n += len(texts)
        if own is not None:
            yield out(own, at, n)

    return f


def _mean_copy(table: pa.Table) -> pa.Table:
    """The copies of one part, weighing by their rows, in order of the blocks."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    part, total = rows[0]["part"], sum(r["n"] for r in rows)
    if part < 0:
        value = sum(np.frombuffer(r["value"], np.float32).astype(float) * (r["n"] / total) for r in rows)
        step = max(int(np.frombuffer(r["at"], np.int64)[0]) for r in rows)
        row = (part, 0, total, np.int64(step).tobytes(), value.astype(np.float32).tobytes(), b"")
    else:
        index = [np.frombuffer(r["at"], np.int32) for r in rows]
        at = np.unique(np.concatenate(index))
        weight = np.zeros(len(at))
        value, square = None, np.zeros(len(at))
        for r, i in zip(rows, index):
            k, d = np.searchsorted(at, i), np.frombuffer(r["value"], np.float32).reshape(len(i), -1)
            value = np.zeros((len(at), d.shape[1])) if value is None else value
            value[k] += d * float(r["n"])
            square[k] += np.frombuffer(r["square"], np.float32) * float(r["n"])
            weight[k] += r["n"]
        row = (part, 0, total, at.astype(np.int32).tobytes(), (value / weight[:, None]).astype(np.float32).tobytes(), (square / weight).astype(np.float32).tobytes())
    return pa.Table.from_pylist([dict(zip(_COPY.names, row))], _COPY)


def _next(model: Cnn, copies: DataFrame) -> None:
    """The mean of the blocks' copies; the driver gets one model, whose size is fixed by the parameters."""
    for r in copies.groupBy("part").applyInArrow(_mean_copy, _COPY_DDL).toArrow().to_pylist():
        value = np.frombuffer(r["value"], np.float32)
        if r["part"] >= 0:
            at = np.frombuffer(r["at"], np.int32)
            model.emb[at] += value.reshape(len(at), -1)
            model.emb_square[at] += np.frombuffer(r["square"], np.float32)
            continue
        model.step, done = int(np.frombuffer(r["at"], np.int64)[0]), 0
        for a in [*model.flat(), *model.mean, *model.square]:
            a[...] = value[done:done + a.size].reshape(a.shape)
            done += a.size


def _cuts(check: DataFrame, model: Cnn) -> list[tuple[bool, str | None, float]]:
    """The best cut over all rows and of each language with both classes; logits meet in cells, a bounded number a language."""
    p, none = model.p, float(model.logits([None])[0])
    logit = F.arrow_udf(lambda t: pa.array([float(x) for some in pieces(t, 1 << 20) for x in model.logits(some)], pa.float64()), "double")
    group = F.explode(F.array(F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang")),
                              F.struct(F.lit(False).alias("every"), F.col("lang").cast("string").alias("lang")))).alias("g")
    cell = F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "logit")) * p.cells).cast("int")
    cells = (check.select("lang", "toxic", logit("text").alias("logit")).select(group, cell.alias("cell"), "logit", "toxic")
                  .groupBy("g.every", "g.lang", "cell").agg(F.min("logit").alias("low"), F.max("logit").alias("high"),
                                                            F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")))

    def f(table: pa.Table) -> pa.Table:
        t = table.sort_by("cell")
        low, high, toxic, clean = (t[c].to_numpy() for c in ("low", "high", "toxic", "clean"))
        cut = best_cut(low, high, toxic, clean, none) if toxic.sum() and clean.sum() else None
        return pa.table({"every": t["every"][:1], "lang": t["lang"][:1], "cut": pa.array([cut], pa.float64())})

    found = cells.groupBy("every", "lang").applyInArrow(f, "every boolean, lang string, cut double")
    return [(r["every"], r["lang"], r["cut"]) for r in found.where(F.col("cut").isNotNull()).orderBy("every", "lang").collect()]


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Cnn | None:
    """Learns ``labels.toxic`` (any 1 makes a document toxic) from all labelled rows; None without both classes."""
    marked = (labels.where(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1))
                    .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    bounded_batches(docs.sparkSession)
    rows = examples(docs, marked, sum(counts.values()), p).persist(StorageLevel.DISK_ONLY)
    try:
        n = {(r["toxic"], r["spare"]): r["count"] for r in rows.groupBy("toxic", "spare").count().collect()}
        if len({toxic for toxic, _ in n}) < 2:
            return None
        train = check = rows
        if len(n) == 4:   # otherwise too few rows to spare any
            train, check = rows.where(~F.col("spare")), rows.where("spare")
            n = {k: v for k, v in n.items() if not k[1]}
        share = sum(v for (toxic, _), v in n.items() if toxic) / sum(n.values())
        model = Cnn(p)
        for epoch in range(p.epochs):
            sent = docs.sparkSession.sparkContext.broadcast(model)
            _next(model, train.select("block", "text", "toxic").mapInArrow(_trained(sent, p, epoch, share), _COPY_DDL))
            sent.destroy()
        model.emb[model.emb_square == 0] = 0   # what no window of a maximum has held says nothing
        model.mean, model.square, model.emb_square = [], [], np.zeros(0, np.float32)   # of the training only
        model.calibrate(_cuts(check, model))
        return model
    finally:
        rows.unpersist()


def score_documents(docs: DataFrame, model: Cnn | None, p: Toxicity = Toxicity()) -> DataFrame:
    """``docs`` with score, predicted (score >= cut), threshold (of the row's lang) and flagged.

    Null, empty and wordless texts get the score of a text without words. Nothing learned: score 0.
    Repeated rows: each scored. Empty table: no rows. Input columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted", "threshold", "flagged")
    if model is None:
        out = docs.withColumn("score", F.lit(0.0))
        limits = {}
    else:
        # the model travels with the function; its size is fixed by the parameters
        score = F.arrow_udf(lambda t: pa.array([float(x) for some in pieces(t, 1 << 20) for x in model.scores(some)], pa.float64()), "double")
        out = docs.withColumn("score", score("text"))
        limits = {k: v for k, v in model.thresholds.items() if k is not None}
    limit = F.lit(p.cut)
    if limits and "lang" in docs.columns:
        limit = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])[F.col("lang")], limit)
    return (out.withColumn("predicted", (F.col("score") >= p.cut).cast("int")).withColumn("threshold", limit)
               .withColumn("flagged", F.col("score") >= F.col("threshold")))
