"""The chat context itself: a fingerprint per turn, a store of blocks from which any turn's context is read.

The context at a turn is all messages up to it; a table of all contexts is quadratic. Two things stand in for it:

* a fingerprint, the polynomial hash ``F(k) = F(k-1) * base + h(message k)`` modulo a prime, which depends on the order. Written as
  ``base^k * sum(h(i) * base^-i)`` it is a running sum, so the bucketed scan gives it for every turn and nothing is collected;
* blocks of ``block`` consecutive messages. Contexts share them: a turn's context is its session's blocks before its own, and
  its own up to the turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.scan import run_sum, scan
from parley.params import Params

# fixed values: the prime 2^31 - 1 and two bases below it; products of two residues fit 64 bits
PRIME = 2_147_483_647
BASES = (1_000_003, 998_244_353)
POWERS = 40            # messages of a session: below 2^40


def _power(base: int, n: Column) -> Column:
    """base^n modulo the prime, by the bits of ``n``."""
    squares, x = [], base
    for _ in range(POWERS):
        squares.append(x)
        x = x * x % PRIME
    bits = F.array(*[F.struct(F.lit(1 << k).cast("bigint").alias("bit"), F.lit(q).cast("bigint").alias("q")) for k, q in enumerate(squares)])
    return F.aggregate(bits, F.lit(1).cast("bigint"), lambda acc, b: F.when(n.bitwiseAND(b["bit"]) != 0, acc * b["q"] % PRIME).otherwise(acc))


def message_hash(role: Column, text: Column, part: int) -> Column:
    """28 bits of a message's md5; a null role or text counts as its own mark."""
    whole = F.md5(F.concat(F.coalesce(role, F.lit("\x01")), F.lit("\x1f"), F.coalesce(text, F.lit("\x01"))))
    return F.conv(F.substring(whole, 1 + 7 * part, 7), 16, 10).cast("bigint")


def numbered(chat: DataFrame, p: Params) -> DataFrame:
    """Messages with ``idx``, their place in the session from 1 on (rows at one turn: by role and text)."""
    return scan(chat.select("session_id", "turn", "role", "text"), ["session_id"], ["turn", "role", "text"],
                {"idx": run_sum(F.lit(1).cast("bigint"))}, p.turn_bucket)


def context_fingerprint(chat: DataFrame, p: Params) -> DataFrame:
    """session_id, turn, n_messages and the fingerprint (62 bits: two residues) of the context at every message."""
    r = numbered(chat, p)
    for k, base in enumerate(BASES):
        r = r.withColumn(f"_h{k}", message_hash(F.col("role"), F.col("text"), k) * _power(pow(base, -1, PRIME), F.col("idx")) % PRIME)
    s = scan(r.drop("text"), ["session_id"], ["turn", "idx"], {f"_s{k}": run_sum(F.col(f"_h{k}")) for k in range(2)}, p.turn_bucket)
    f = [F.col(f"_s{k}") % PRIME * _power(base, F.col("idx")) % PRIME for k, base in enumerate(BASES)]
    return s.select("session_id", "turn", F.col("idx").alias("n_messages"), (f[0] * F.lit(1 << 31) + f[1]).alias("fingerprint"))


def context_blocks(chat: DataFrame, p: Params, block: int = 256) -> DataFrame:
    """session_id, block, messages (idx, turn, role, text, in order): the store. A group is at most ``block`` messages."""
    r = numbered(chat, p).withColumn("block", F.expr(f"(idx - 1) div {block}"))
    g = r.groupBy("session_id", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "turn", "role", "text"))).alias("messages"))
    return g.select("session_id", "block", "messages")


def contexts_at(places: DataFrame, blocks: DataFrame, block: int = 256, last_n: int | None = None) -> DataFrame:
    """The contexts at some places (session_id, at_idx), message by message: session_id, at_idx, idx, turn, role, text. A place's
    blocks are named from its number, so that the join is one of equal keys; with ``last_n`` only those that hold the last
    messages are. A null session is one like others."""
    first = F.lit(0).cast("bigint") if last_n is None else F.greatest(F.lit(0), F.expr(f"(at_idx - {last_n}) div {block}")).cast("bigint")
    wanted = places.select("session_id", "at_idx", F.explode(F.sequence(first, F.expr(f"(at_idx - 1) div {block}"))).alias("block"))
    got = wanted.alias("w").join(blocks.alias("b"), F.col("w.session_id").eqNullSafe(F.col("b.session_id")) & (F.col("w.block") == F.col("b.block")))
    low = F.lit(0) if last_n is None else F.col("at_idx") - last_n
    inside = F.filter("messages", lambda m: (m["idx"] <= F.col("at_idx")) & (m["idx"] > low))
    return got.select("w.session_id", "at_idx", F.explode(inside).alias("m")).select("session_id", "at_idx", "m.*")
