"""Language identification: nearest centroid of normalised TF-IDF n-gram vectors, with rejection.

Fit: a bounded sample of rows per language (``per_lang``, smallest seeded hashes of the id, cut by a threshold
from the language's count before they meet) becomes hashed byte-n-gram counts on the executors; the driver gets these fixed-size vectors, computes
idf and clusters each language's vectors by spherical k-means. Predict: every whole text, in Arrow
batches, goes to the centroid of the largest cosine. A text whose cosine is below ``reject_share`` of a low
quantile of those seen inside the cluster while fitting is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.common import bounded_batches, id_hash, learnable, smallest_hashes
from parley.llm.textbytes import pieces, words

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageId:
    dims: int = 4096
    clusters: int = 4
    rounds: int = 12
    per_lang: int = 400       # rows to fit on, of each language
    max_fit: int = 8000       # and of all languages; at most so many languages, the most frequent ones
    reject_share: float = 0.25
    floor_quantile: float = 0.05   # of the cosines inside a cluster: a few odd texts don't lower its floor
    seed: int = 7


@dataclass(frozen=True)
class Model:
    dims: int
    langs: list[str]          # of each centroid
    idf: np.ndarray
    centroids: np.ndarray     # one column each
    floor: np.ndarray         # cosine below which the centroid rejects


def counts(text: bytes | None, dims: int) -> np.ndarray:
    """Hashed counts of the 2- and 3-byte n-grams of the text's words, each word between spaces."""
    ws = words(text)
    if not ws:
        return np.zeros(dims, dtype=np.float32)
    b = np.frombuffer(b" " + b" ".join(ws) + b" ", dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - dims.bit_length() + 1)
    return (np.bincount(two >> shift, minlength=dims) + np.bincount(three >> shift, minlength=dims)).astype(np.float32)


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


def has_letter(text: bytes | None, ws: list[bytes]) -> bool:
    if not ws:
        return False
    if any(w[0] < 128 for w in ws[:50]) or any(c < 128 for w in ws for c in w):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def fit(docs: DataFrame, p: LanguageId = LanguageId()) -> Model:
    """Learns from rows with lang and a letter in the text whose id isn't held out. Ids with several texts in one
    language give their smallest text; null ids aren't learned from. Nothing to learn from: a model of no language."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & learnable(F.col("doc_id"))).select("doc_id", "lang", "text")
    ids = docs.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(p.max_fit).collect()
    if not ids:
        return Model(p.dims, [], np.zeros(p.dims, np.float32), np.zeros((p.dims, 0), np.float32), np.zeros(0, np.float32))
    per = max(1, min(p.per_lang, p.max_fit // len(ids)))
    dims = p.dims
    vector = F.arrow_udf(lambda t: pa.array([counts(x, dims).tobytes() for some in pieces(t) for x in some], pa.binary()), "binary")
    few = smallest_hashes(docs, "lang", [(r["lang"], r["n"]) for r in ids], per, p.seed)
    few = few.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "doc_id", vector("text").alias("v"))
    order = Window.partitionBy("lang").orderBy(id_hash(p.seed), "doc_id")   # over some 2 * per rows a language
    rows = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per).orderBy("lang", "doc_id").select("lang", "v").toArrow()
    c = np.frombuffer(b"".join(rows["v"].to_pylist()), dtype=np.float32).reshape(-1, dims)
    lang = np.array(rows["lang"].to_pylist(), dtype=object)
    idf = (np.log((1 + len(c)) / (1 + (c > 0).sum(0))) + 1).astype(np.float32)
    x = weighted(c, idf)
    names, centroids, floors = [], [], []
    rng = np.random.default_rng(p.seed)
    for name in sorted(set(lang)):
        xs = x[lang == name]
        m = xs[rng.permutation(len(xs))[: p.clusters]]
        for _ in range(p.rounds):
            near = (xs @ m.T).argmax(1)
            sums = np.stack([xs[near == k].sum(0) if (near == k).any() else m[k] for k in range(len(m))])
            m = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        cos = xs @ m.T
        near = cos.argmax(1)
        for k in np.unique(near):   # a centroid of no text would reject nothing
            names.append(name)
            centroids.append(m[k])
            floors.append(np.quantile(cos[near == k, k], p.floor_quantile) * p.reject_share)
    return Model(dims, names, idf, np.stack(centroids, 1).astype(np.float32), np.array(floors, np.float32))


def predictor(model: Model):
    """text -> struct(lang_pred, score, rejected)."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def f(texts: pa.Array) -> pa.Array:
        lang, score, rejected = [], [], []
        for some in pieces(texts, 1 << 19):
            c = np.stack([counts(t, model.dims) for t in some])
            known = np.array([has_letter(t, words(t)) for t in some])
            if not model.langs:
                lang += [UNKNOWN] * len(some)
                score += [0.0] * len(some)
                rejected += [True] * len(some)
                continue
            cos = weighted(c, model.idf) @ model.centroids
            k = cos.argmax(1)
            best = np.clip(cos[np.arange(len(k)), k], 0, 1).astype(float)
            lang += [model.langs[i] if ok else UNKNOWN for i, ok in zip(k, known)]
            score += np.where(known, best, 0.0).tolist()
            rejected += (~known | (best < model.floor[k])).tolist()
        return pa.array([{"lang_pred": a, "score": b, "rejected": r} for a, b, r in zip(lang, score, rejected)], kind)

    return F.arrow_udf(f, "lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected; input columns of these names are replaced.

    Null text or text without a letter: ``und``, 0, rejected. With nothing learned: all ``und``.
    Repeated rows: each predicted. Empty table: no rows.
    """
    bounded_batches(docs.sparkSession)
    out = docs.drop("lang_pred", "score", "rejected").withColumn("_li", predictor(model)(F.col("text")))
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c != "_li"], "_li.lang_pred", "_li.score", "_li.rejected")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, unchanged; all rows where nothing is learned, since there is nothing to reject by."""
    if not model.langs:
        return docs
    bounded_batches(docs.sparkSession)
    return docs.where(~predictor(model)(F.col("text"))["rejected"])
