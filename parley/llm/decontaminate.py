"""Benchmark decontamination: a broadcast hash set of test n-grams against document windows.

A document's word positions are exploded; the hash of the window that starts at each is looked up in
the table of benchmark windows (broadcast while its measured size is under a bound, else a shuffled
join on the hash). A filter behind the join compares the words themselves, so a hash collision is
never a hit. Hits collapse to one row per document before
anything else is done with them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import ascii_lower

OUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
# Neither digits, letters nor non-ASCII characters. Words are split first and lower-cased one by one.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Decontamination:
    window: int = 10
    broadcast_mb: int = 64   # benchmark windows above this are joined by shuffle


def words_of(text: Column) -> Column:
    """Words in order, A-Z lower-cased; null text has none."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != ""), ascii_lower)


def _key(words: Column, pos: Column, size: int) -> Column:
    """Hash of ``size`` words from position ``pos`` (from 1): plain columns, so it compiles to one loop-free expression."""
    return F.xxhash64(F.lit(size), *[F.get(words, pos + (i - 1)) for i in range(size)])


def benchmark_windows(benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """(len, words, items): each distinct window with the ids of its items (null ids aren't listed).

    An item of fewer words than the window is one window; an item without words has none.
    """
    n = F.size("words")
    return (benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(n > 0)
                     .select("item_id", "words", F.least(n, F.lit(p.window)).alias("len"))
                     .select("item_id", "words", "len", F.explode_outer(F.sequence(F.lit(1), n - F.col("len") + 1)).alias("pos"))
                     .select("item_id", "len", F.slice("words", F.col("pos"), F.col("len")).alias("words"))
                     .groupBy("len", "words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")))


def hits(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """(doc_id, _dc_text, copies, n_words, spans): one row per distinct (doc_id, text), with its hit spans.

    spans: sorted array of (first, end, items), word positions from 1, end exclusive.
    """
    windows = benchmark_windows(benchmark, p)
    # a benchmark is small, but that is measured: number of windows, their words, the lengths in use
    n, chars, lengths = windows.agg(F.count("*"), F.sum(F.length(F.concat_ws(" ", "words"))), F.collect_set("len")).first()
    lengths = sorted(lengths)
    by_len = lambda words, pos, size: F.coalesce(F.lit(None).cast("long"), *[F.when(size == x, _key(words, pos, x)) for x in lengths])
    windows = windows.select(by_len(F.col("words"), F.lit(1), F.col("len")).alias("_b_key"), F.col("words").alias("_b_words"), "items")
    small = n * 200 + (chars or 0) * 4 <= p.broadcast_mb << 20

    # Position 0 stands for the document itself, so that documents without hits stay. explode_outer: the
    # filter that explode adds below itself would compute the words a second time.
    words, pos, size = F.col("_dc_words"), F.col("_dc_pos"), F.col("_dc_len")
    rows = (docs.select("doc_id", F.xxhash64("text").alias("_dc_text"), words_of(F.col("text")).alias("_dc_words"))
                .select("*", F.explode_outer(F.sequence(F.lit(0), F.size(words))).alias("_dc_pos")))
    if len(lengths) == 1:
        rows = rows.withColumn("_dc_len", F.lit(lengths[0]))
    else:
        every = F.array(*[F.lit(x) for x in lengths or [p.window]])
        rows = rows.withColumn("_dc_len", F.explode_outer(F.when(pos > 0, every).otherwise(F.slice(every, 1, 1))))
    inside = (pos > 0) & (pos + size - 1 <= F.size(words))
    rows = rows.withColumn("_dc_key", F.when(inside, by_len(words, pos, size)))
    is_doc = pos == 0
    # the words are compared behind the join: as a join condition they would become a second hash key
    window = F.slice(words, F.greatest(pos, F.lit(1)), size)
    if small:
        found = rows.join(F.broadcast(windows), F.col("_dc_key") == F.col("_b_key"), "left").where(
            is_doc | (F.col("_b_key").isNotNull() & (window == F.col("_b_words"))))
    else:
        # a shuffled row takes its own window along, not the text; rows that stand for documents stay out of the join
        each = rows.where(inside).select("doc_id", "_dc_text", "_dc_pos", "_dc_len", "_dc_key", window.alias("_dc_words"))
        each = each.join(windows, F.col("_dc_key") == F.col("_b_key")).where(F.col("_dc_words") == F.col("_b_words"))
        found = rows.where(is_doc).withColumn("items", F.lit(None).cast("array<string>")).unionByName(each.select("doc_id", "_dc_text", "_dc_words", "_dc_pos", "_dc_len", "_dc_key", "items"))
    return (found
                 .select("doc_id", "_dc_text", is_doc.alias("doc"), F.when(is_doc, F.size(words)).alias("n"),
                         F.when(~is_doc, F.struct(pos.alias("first"), (pos + size).alias("end"), "items")).alias("span"))
                 .groupBy("doc_id", "_dc_text")
                 .agg(F.sum(F.col("doc").cast("int")).alias("copies"), F.max("n").cast("long").alias("n_words"),
                      F.array_sort(F.collect_set("span")).alias("spans")))


def _figures(found: DataFrame) -> DataFrame:
    # words inside any span: spans come sorted, each adds what reaches beyond the furthest end so far
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct(
        F.greatest(a["end"], s["end"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["first"]))).cast("long").alias("n")), lambda a: a["n"])
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["items"]))))
    return (found.withColumn("n_hit", covered).withColumn("_dc_items", items)
                 .withColumn("n_items", F.size("_dc_items").cast("long"))
                 .withColumn("items_sha256", F.sha2(F.concat_ws(",", "_dc_items").cast("binary"), 256))
                 .withColumn("contaminated", F.col("n_hit") > 0))


def contamination(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty text: no words, no hit. Empty benchmark: no hit. Repeated rows: one result each.
    Items with a null id hit, but aren't counted or listed. Other columns are ignored.
    """
    found = _figures(hits(docs, benchmark, p))
    again = found.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select("doc_id", *OUT)


def clean_documents(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", p: Decontamination = Decontamination()) -> DataFrame:
    """``docs`` with its columns, without contaminated documents, or (``remove="spans"``) with the hit
    words taken out: the text is then the rest of its normalised words."""
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    bad = (hits(docs, benchmark, p).where(F.size("spans") > 0)
           .select(F.col("doc_id").alias("_dc_id"), F.col("_dc_text").alias("_dc_key"), "spans"))
    same = docs["doc_id"].eqNullSafe(F.col("_dc_id")) & (F.xxhash64(docs["text"]) == F.col("_dc_key"))
    if remove == "documents":
        return docs.join(bad, same, "left_anti")
    out = docs.join(bad, same, "left")
    words = words_of(docs["text"])
    left = F.filter(words, lambda w, i: ~F.exists("spans", lambda s: (s["first"] <= i + 1) & (i + 1 < s["end"])))
    text = F.when(F.col("spans").isNull(), docs["text"]).otherwise(F.array_join(left, " "))
    return out.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
