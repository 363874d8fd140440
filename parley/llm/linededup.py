"""Line dedup by a log-template tree of fixed depth.

A line's path in the tree is its token count and its first ``depth`` tokens, with every token that holds
a digit generalised to one variable field. At the leaf lines are compared position by position: a token
is constant where it stands in at least ``min_documents`` lines (of different text or documents) of the leaf, and what
isn't is variable. Lines are dropped if their leaf recurs in ``min_documents`` documents and at
least ``similarity`` percent of their tokens are constant, so lines that only begin alike stay. Lines of
``long_tokens`` and more are dropped too where the very line recurs in two documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import SPACES, materialize

OUT = ["n_lines", "n_dropped", "clean_text"]


@dataclass(frozen=True)
class LineDedup:
    depth: int = 6
    min_documents: int = 3
    similarity: int = 75        # percent of a line's tokens that agree with others at its leaf
    long_tokens: int = 20


def _tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, SPACES, " ")), " ")


def template(tokens: Column, p: LineDedup = LineDedup()) -> Column:
    """Readable form: the leading tokens with ``<*>`` for variable ones, then the token count."""
    lead = F.transform(F.slice(tokens, 1, p.depth), lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t))
    return F.concat(F.array_join(lead, " "), F.lit(" #"), F.size(tokens).cast("string"))


def _lines(docs: DataFrame, p: LineDedup) -> DataFrame:
    """(doc_id, _ld_text, i, t, exact, key): the lines with tokens, twice where they are long: by the leaf's 64-bit hash, and by their own."""
    tokens = _tokens(F.col("line"))
    lead = [F.get("t", F.lit(i)) for i in range(p.depth)]
    lead = [F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(F.coalesce(t, F.lit(""))) for t in lead]
    leaf = F.struct(F.lit(False).alias("exact"), F.xxhash64(F.size("t"), *lead).alias("key"))
    own = F.struct(F.lit(True).alias("exact"), F.xxhash64("t").alias("key"))
    both = F.when(F.size("t") >= p.long_tokens, F.array(leaf, own)).otherwise(F.array(leaf))
    return (docs.select("doc_id", F.xxhash64("text").alias("_ld_text"), F.posexplode_outer(F.split("text", "\n")).alias("i", "line"))
                .where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
                .select("doc_id", "_ld_text", "i", tokens.alias("t"))
                .select("*", F.explode(both).alias("_k")).select("doc_id", "_ld_text", "i", "t", "_k.exact", "_k.key"))


def recurring(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """(exact, key, documents) of leaves and of long lines that recur. A line repeated in one document counts once."""
    enough = F.col("documents") >= F.when(F.col("exact"), 2).otherwise(p.min_documents)
    return (_lines(docs, p).select("exact", "key", "doc_id", "_ld_text").distinct()
            .groupBy("exact", "key").agg(F.count("*").alias("documents")).where(enough))


def _general(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t))


def _dropped(docs: DataFrame, p: LineDedup) -> DataFrame:
    """(doc_id, _ld_text, i) of the lines to drop; a line may come twice.

    Lines alike but for variable fields are one kind. Kinds that ``min_documents`` documents have agree with themselves;
    tokens are only read again for leaves that hold rarer kinds, from one line of each kind.
    """
    line = ["doc_id", "_ld_text", "i"]
    hits = (_lines(docs, p).select(*line, "exact", "key", F.when(~F.col("exact"), F.xxhash64(_general(F.col("t")))).alias("whole"))
            .join(recurring(docs, p).drop("documents"), ["exact", "key"]))
    hits = materialize(hits, "line-hits")
    in_leaf = hits.where("NOT exact")
    kinds = materialize(in_leaf.groupBy("key", "whole", "doc_id", "_ld_text").agg(F.min("i").alias("i"))
                        .groupBy("key", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*line)).alias("at")), "line-kinds")
    rare = kinds.where(F.col("n") < p.min_documents)
    mixed = kinds.join(rare.select("key").distinct(), "key", "left_semi")
    # one row a document with the numbers of its lines to read; the texts are shuffled for it as for the last join, once for both
    ask = (mixed.groupBy(F.col("at.doc_id").alias("_ld_id"), F.col("at._ld_text").alias("_ld_key"))
                .agg(F.collect_list(F.struct("key", "whole", "n", F.col("at.i").alias("i"))).alias("_ld_ask")))
    keyed = docs.withColumn("_ld_text", F.xxhash64("text"))
    texts = keyed.join(ask, F.col("doc_id").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_text") == F.col("_ld_key")))
    asked = (texts.select(F.split("text", "\n").alias("lines"), F.explode("_ld_ask").alias("x"))
                  .select("x.key", "x.whole", "x.n", F.element_at("lines", F.col("x.i") + 1).alias("line"))
                  .groupBy("key", "whole").agg(F.first("n").alias("n"), F.first("line").alias("line")))   # repeated rows ask twice
    tokens = (asked.select("key", "whole", "n", _tokens(F.col("line")).alias("t"))
                   .select("key", "whole", "n", F.size("t").alias("size"), F.posexplode(_general(F.col("t"))).alias("at", "token")))
    constant = tokens.groupBy("key", "at", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= p.min_documents).drop("n")
    alike = (tokens.where(F.col("n") < p.min_documents).drop("n").join(constant, ["key", "at", "token"])
                   .groupBy("key", "whole").agg(F.count("*").alias("agree"), F.first("size").alias("size"))
                   .where(F.col("agree") * 100 >= F.col("size") * p.similarity).select("key", "whole"))
    alike = alike.unionByName(kinds.where(F.col("n") >= p.min_documents).select("key", "whole"))
    return in_leaf.join(alike, ["key", "whole"]).select(*line).unionByName(hits.where("exact").select(*line))


def dedup_lines(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """``docs`` (doc_id, text, any others) with n_lines, n_dropped and clean_text (its other lines, in order).

    Null text: 0 lines, clean_text null. Blank lines aren't counted or dropped. Equal rows (id and text)
    count as one document. Empty table: no rows. Input columns of these names are replaced.
    """
    docs = docs.drop(*OUT)
    drop = _dropped(docs, p).groupBy(F.col("doc_id").alias("_ld_id"), F.col("_ld_text").alias("_ld_key")).agg(F.collect_set("i").alias("_ld_drop"))
    keyed = docs.withColumn("_ld_text", F.xxhash64("text"))
    out = keyed.join(drop, F.col("doc_id").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_text") == F.col("_ld_key")), "left")
    lines_ = F.split("text", "\n")
    n = F.size(F.filter(lines_, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    kept = F.filter(lines_, lambda x, i: ~F.array_contains("_ld_drop", i))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.when(F.col("_ld_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"))
