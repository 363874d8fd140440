"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's documents are dealt by a seeded hash to shards of about ``shard_words`` words, so a hot
source is many shards. In a shard the documents lie end to end in seeded order, and the line is cut
into blocks of ``block_words`` words (of one word in sources whose target is below ``small_blocks`` blocks:
such sources are apportioned among themselves). Blocks are seats: the mix has round(all targets / block)
seats, given to sources by the highest quotients target / (2 k - 1), and each source's seats to its
shards by their sizes in the same way, at most two seats a block. A shard with n blocks and q seats
takes every block q div n times, and those with the q mod n smallest seeded hashes once more.

Only the table of sources is sorted as a whole (one row per source).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.common import SPACES, materialize, n_words

OUT = ["size", "source_size", "target", "taken"]
ROUNDS, PROBES = 4, 24      # each round narrows the bounds of the last quotient to the 25th part
EPS = 1e-12                 # more than the rounding of a quotient


@dataclass(frozen=True)
class Mixing:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)   # of the sources in code-point order, repeating
    share: float = 1.5                             # all targets / all words
    max_repeats: int = 2
    block_words: int = 64
    small_blocks: int = 64                         # sources with targets below so many blocks are dealt word by word
    shard_words: int = 1 << 18
    seed: int = 29


def source_targets(sizes: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """(source, source_size, n_shards, target) from (source, size) rows.

    A target is level * weight, or max_repeats * source_size where that is less; the level is the
    one at which the targets share out ``share`` of all words. In order of cap / weight the sources below
    the level are those whose ratio doesn't exceed what is left for each unit of weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in p.weights])
    every = Window.partitionBy()
    s = (sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
              .withColumn("rank", F.row_number().over(by_name))
              .withColumn("weight", F.element_at(weights, (F.pmod(F.col("rank") - 1, len(p.weights)) + 1).cast("int")))
              .withColumn("cap", F.col("source_size") * float(p.max_repeats))
              .withColumn("want", F.sum("source_size").over(every) * p.share)
              .withColumn("all_weight", F.sum("weight").over(every)))
    lower = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("want") - F.coalesce(F.sum("cap").over(lower), F.lit(0.0))
    left_weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(lower), F.lit(0.0))
    s = s.withColumn("full", F.col("cap") / F.col("weight") <= left / left_weight)
    of_full = lambda c: F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(every), F.lit(0.0))
    level = (F.col("want") - of_full("cap")) / (F.col("all_weight") - of_full("weight"))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / p.shard_words)).cast("int")
    block = F.when(target < p.small_blocks * p.block_words, 1).otherwise(p.block_words)
    return s.select("source", "source_size", n_shards.alias("n_shards"), target.alias("target"), "rank", block.alias("_mx_block"))


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, cap: str, order: str, out: str) -> DataFrame:
    """Sainte-Lague: ``out`` = integer seats of each row, ``seats`` of them in each group, by the highest quotients
    votes / (2 k - 1); equal quotients by ``order``, then k. Nobody gets more than ``cap`` seats.

    A row's quotients of at least q are its first floor(votes / (2 q) + 1/2). The bounds lo and hi of the last quotient
    that wins are narrowed by probes, as many counts in one aggregate of the group; quotients of at least hi win, those
    between the bounds are listed and sorted. Rounds and probes decide how many are listed, not who wins.
    """
    parties, keys = materialize(parties, "mix-parties"), [*group, order]
    won = lambda q: F.when(F.col(votes) > 0, F.least(F.col(cap), F.floor(F.col(votes) / (2 * q) + 0.5))).otherwise(0).cast("long")
    to = [F.col(c).alias(f"_to_{c}") for c in group]
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_to_{c}")) for c in group])
    positive = F.col(votes) > 0
    # at lo everybody has all that cap allows, at hi nobody has a seat
    bounds = (parties.groupBy(*group).agg((F.min(F.when(positive, F.col(votes) / (2.0 * F.col(cap) + 1))) * (1 - EPS)).alias("_lo"),
                                          (F.max(F.when(positive, F.col(votes))) * (1 + 1e-6)).alias("_hi"), F.max(seats).alias("_seats")).select(*to, "_lo", "_hi", "_seats"))
    # probes are a column of the bounds and the seats at them one of the rows: spelled out in every sum they made plans of which the driver's memory was full
    at = lambda i: F.col("_lo") * F.pow(F.col("_hi") / F.col("_lo"), i / (PROBES + 1))
    for _ in range(ROUNDS):
        probes = bounds.withColumn("_probe", F.transform(F.sequence(F.lit(1), F.lit(PROBES)), at))
        counts = (parties.join(probes, same).withColumn("_won", F.transform("_probe", won))
                         .groupBy(*[f"_to_{c}" for c in group], "_lo", "_hi", "_seats")
                         .agg(F.array(*[F.sum(F.col("_won")[i]) for i in range(PROBES)]).alias("_n")))
        counts = counts.withColumn("_at", F.size(F.filter("_n", lambda n: n >= F.col("_seats"))))   # counts fall as probes rise
        bounds = counts.select(*[f"_to_{c}" for c in group], F.when(F.col("_at") <= 0, F.col("_lo")).otherwise(at(F.col("_at"))).alias("_lo"),
                               F.when(F.col("_at") >= PROBES, F.col("_hi")).otherwise(at(F.col("_at") + 1)).alias("_hi"), "_seats")
    a = parties.join(bounds, same, "left").withColumns({
        "_first": F.coalesce(won(F.col("_hi") * (1 + EPS)), F.lit(0)), "_upto": F.coalesce(won(F.col("_lo") * (1 - EPS)), F.lit(0))})
    a = materialize(a.drop("_lo", "_hi", "_seats", *[f"_to_{c}" for c in group]), "mix-bounds")
    sure = a.groupBy(*group).agg((F.max(seats) - F.sum("_first")).alias("_rest")).select(*to, "_rest")
    step = F.when(F.col("_upto") > F.col("_first"), F.sequence(F.col("_first") + 1, F.col("_upto")))
    ranked = Window.partitionBy(*group).orderBy(F.desc("_q"), order, "_j")
    moved = (a.select(*keys, votes, F.explode(step).alias("_j")).withColumn("_q", F.col(votes) / (2 * F.col("_j") - 1))
              .join(sure, same).withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= F.col("_rest"))
              .groupBy(*keys).agg(F.count("*").alias("_moved")))
    moved = moved.select(*[F.col(c).alias(f"_to_{c}") for c in keys], "_moved")
    same_row = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_to_{c}")) for c in keys])
    result = F.col("_first") + F.coalesce(F.col("_moved"), F.lit(0))
    return a.join(moved, same_row, "left").select(*parties.columns, result.cast("long").alias(out))


def _block_hash(p: Mixing, source: Column, shard: Column, block: Column) -> Column:
    return F.xxhash64(F.lit(p.seed), F.lit("block"), source, shard, block)


def _dealt(df: DataFrame, sources: DataFrame, p: Mixing) -> DataFrame:
    """Adds the source's figures, the shard and the seeded order (AQE splits a hot source's join partition)."""
    s = sources.select(F.col("source").alias("_mx_source"), "source_size", "target", "n_shards", "_mx_block")
    return (df.join(s, df["source"].eqNullSafe(s["_mx_source"])).drop("_mx_source")
              .withColumn("_mx_shard", F.pmod(F.xxhash64(F.lit(p.seed), F.lit("shard"), "_mx_tie"), F.col("n_shards")).cast("int")))


def _sized(docs: DataFrame) -> DataFrame:
    plain = [c for c, t in docs.dtypes if not t.startswith(("map", "variant"))]
    return (docs.withColumn("_mx_tie", F.xxhash64(*[F.col(f"`{c}`") for c in plain])).withColumn("size", n_words(F.col("text"))))


def planned(docs: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """``docs`` with size, source_size, target, taken and the private columns that say which words are taken."""
    docs = docs.drop(*OUT)
    slim = materialize(_sized(docs).select("source", "size", "_mx_tie"), "mix-sizes")
    sources = materialize(source_targets(slim, p), "mix-sources")
    # blocks of a source are counted over its shards, so shards come first
    shards = (_dealt(slim, sources, p)
              .groupBy("source", "_mx_shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("_mx_block").alias("_mx_block"))
              .withColumn("blocks", F.ceil(F.col("words") / F.col("_mx_block")).cast("long")))
    shards = materialize(shards, "mix-shards")
    by_source = shards.groupBy("source", "_mx_block").agg(F.first("target").alias("target"), (p.max_repeats * F.sum("blocks")).alias("cap"))
    every = Window.partitionBy("_mx_block")
    by_source = (by_source.withColumn("seats", F.floor(F.sum("target").over(every) / F.col("_mx_block") + 0.5))
                          .withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))))
    quota = apportion(by_source, ["_mx_block"], "target", "seats", "cap", "name", "source_seats").select(
        F.col("source").alias("_q_source"), "source_seats")
    shards = (shards.join(quota, shards["source"].eqNullSafe(F.col("_q_source"))).drop("_q_source")
                    .withColumn("cap", p.max_repeats * F.col("blocks")))
    shards = apportion(shards, ["source"], "words", "source_seats", "cap", "_mx_shard", "quota")
    # the q mod n smallest block hashes of a shard get one more; a shard has about shard_words / block_words blocks
    hashes = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: _block_hash(p, F.col("source"), F.col("_mx_shard"), b)))
    extra = F.pmod("quota", F.col("blocks")).cast("int")
    plan = (shards.where("blocks > 0")
                  .select(F.col("source").alias("_pl_source"), F.col("_mx_shard").alias("_pl_shard"), "quota",
                          F.floor(F.col("quota") / F.col("blocks")).alias("_mx_every"),
                          F.when(extra > 0, F.element_at(hashes, F.greatest(extra, F.lit(1)))).alias("_mx_upto")))
    plan = materialize(plan, "mix-plan")

    line = (Window.partitionBy("source", "_mx_shard").orderBy(F.xxhash64(F.lit(p.seed), "_mx_tie"), "doc_id")
                  .rowsBetween(Window.unboundedPreceding, -1))
    out = _dealt(_sized(docs), sources, p).withColumn("_mx_at", F.coalesce(F.sum("size").over(line), F.lit(0)))
    out = out.join(plan, out["source"].eqNullSafe(plan["_pl_source"]) & (out["_mx_shard"] == plan["_pl_shard"]), "left")
    times = lambda b: (F.col("_mx_every") + F.when(_block_hash(p, F.col("source"), F.col("_mx_shard"), b) <= F.col("_mx_upto"), 1).otherwise(0)).cast("long")
    end = F.col("_mx_at") + F.col("size")
    w = F.col("_mx_block").cast("long")
    blocks = F.sequence(F.floor(F.col("_mx_at") / w), F.floor((end - 1) / w))
    pieces = F.transform(blocks, lambda b: F.struct(
        (F.greatest(F.col("_mx_at"), b * w) - F.col("_mx_at")).cast("int").alias("first"),
        (F.least(end, (b + 1) * w) - F.greatest(F.col("_mx_at"), b * w)).cast("int").alias("n"),
        times(b).alias("times")))
    out = out.withColumn("_mx_pieces", F.when(F.col("size") > 0, pieces))
    taken = F.aggregate("_mx_pieces", F.lit(0).cast("long"), lambda t, x: t + x["n"] * x["times"])
    return out.withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long"))


def mix_sources(docs: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """``docs`` (doc_id, text, source, any others) with size, source_size, target and taken.

    size = words of the text (null or blank: 0, nothing taken). Null is a source of its own, last in
    order. Repeated rows are records of their own (equal ones are interchangeable). Empty table: no
    rows. Input columns with the names of results are replaced by them.
    """
    keep = [c for c in docs.columns if c not in OUT]
    return planned(docs, p).select(*[F.col(f"`{c}`") for c in keep], *OUT)


def mixed_documents(docs: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that words of a document are taken.

    Where a whole document is taken its text stays as it is; else it holds the words of the taken
    blocks, and n_chars, if there, their length.
    """
    full = planned(docs, p)
    passes = F.explode(F.sequence(F.lit(1), F.lit(p.max_repeats))).alias("_mx_pass")
    out = full.where("taken > 0").select("*", passes)
    mine = F.filter("_mx_pieces", lambda x: x["times"] >= F.col("_mx_pass"))
    out = out.withColumn("_mx_mine", mine).where(F.size("_mx_mine") > 0)
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    # the lambda's argument holds the words: a column would be inlined and the text split again for every block
    cut = F.element_at(F.transform(F.array(words), lambda ws: F.array_join(
        F.flatten(F.transform("_mx_mine", lambda x: F.slice(ws, x["first"] + 1, x["n"]))), " ")), 1)
    whole = F.size("_mx_mine") == F.size("_mx_pieces")
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
