"""N-gram Jaccard join: a grouped prefix join over sets of 5-word shingles.

1. Documents with equal sets collapse to one *set* (key: 64-bit hash of set and size).
2. The shingles of every set are counted: each task deals its shingles by hash range as packed arrays,
   so a hot group of copies is one entry. Shingles in one set only can't link anything; the others come back to
   their sets in global order, rare first (class of the count, then hash). Very frequent shingles, found in a bounded
   sample of sets, have their class from there and go to their sets directly, so no range holds all their sets.
   The order is the same for all sets, which is all that the result needs of it.
3. Prefix filter: of n shingles, n - ceil(3n/4) + 1 rarest ones contain a common one for any linked
   pair. Sets whose prefix holds no shared shingle are done.
4. Sets with identical prefix and size collapse into a group. Members linked to their group's leader stay
   collapsed as one unit; the others stand alone.
5. Units that share a prefix shingle, with fitting sizes and positions, are candidate pairs. Small buckets list all
   pairs. Large ones are compared with a few leaders per window and round, as long as that
   helps; a window of two neighbouring size classes holds every pair that can be linked. Members in the window's
   largest component need no further pair with it, so only stragglers are compared with the whole window in the end.
   No pair between different components is left out.
6. Candidate units are expanded to members and verified on the whole shared sets.

Shingles are told apart by 40 bits beside the bits of the range number (46 bits at least), sets by 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.common import bounded_batches, materialize, materialize_with


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 75
    range_shingles: int = 1_000_000   # shingles of one range, in one task's memory
    flush_shingles: int = 500_000     # a task deals its shingles after so many
    sample_sets: int = 10_000         # expected size of the sample that finds the frequent shingles
    frequent: float = 0.002           # share of the sampled sets from which a shingle is frequent, at least 3 sets
    most_frequent: int = 200_000      # of them at most so many skip the ranges, the others are counted there
    bucket: int = 16                  # sets in a bucket that lists all its pairs
    leaders: int = 3                  # of a large bucket in each round
    listed: float = 1.0               # pairs that may be listed, times the prefix entries


class _Words(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, hashes: _Words, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer than k words: the whole sequence is one."""
    ws = text.lower().split() if text else []   # bytes: A-Z and ASCII white space only
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    k = min(k, len(h))
    factor = np.uint64(0x9E3779B97F4A7C15)
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = s * factor + h[i:len(h) - k + 1 + i]
    return np.unique(_mix(s))


def _set_key(s: np.ndarray) -> int:
    both = s.sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return int(_mix(both).view(np.int64)[0])


def sets_of(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """(doc_id, text_key, n, ent): size and key of each row's set; ent is null for an empty one."""
    kind = pa.struct([("n", pa.int64()), ("ent", pa.int64())])
    k = p.words

    def f(texts: pa.Array) -> pa.Array:
        hashes, out = _Words(), []
        for t in texts.cast(pa.binary()):
            s = shingles(t.as_py(), hashes, k)
            out.append({"n": len(s), "ent": _set_key(s) if len(s) else None})
        return pa.array(out, kind)

    return (docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.arrow_udf(f, "n long, ent long")("text").alias("s"))
                .select("doc_id", "text_key", "s.n", "s.ent"))


def _pack(ents: list, lens: list, n: list, tokens: np.ndarray) -> dict:
    """Arrays of one range: per set its key, how many shingles follow, its size; and 40 bits of each shingle."""
    return {"ents": np.array(ents, np.int64).tobytes(), "lens": np.array(lens, np.uint32).tobytes(), "sizes": np.array(n, np.uint32).tobytes(),
            "low": tokens.astype(np.uint32).tobytes(), "high": (tokens >> np.uint64(32)).astype(np.uint8).tobytes()}


PACKED = "part int, ents binary, lens binary, sizes binary, low binary, high binary"


def _frequent(docs: DataFrame, members: DataFrame, p: Join) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the frequent shingles and the classes of their estimated counts."""
    n_sets = members.agg(F.approx_count_distinct("ent")).first()[0]
    place = F.xxhash64(F.lit("sample"), "text") / 2.0 ** 64 + 0.5
    texts = docs.where(F.col("text").isNotNull() & (place * n_sets < p.sample_sets)).select("text").distinct()
    k = p.words

    def f(texts: pa.Array) -> pa.Array:
        hashes = _Words()
        return pa.array([shingles(t.as_py(), hashes, k).view(np.int64) for t in texts.cast(pa.binary())], pa.list_(pa.int64()))

    count = F.count("*").alias("count")
    tokens = texts.select(F.explode(F.arrow_udf(f, "array<long>")("text")).alias("token")).groupBy("token").agg(count)
    sampled = min(n_sets, p.sample_sets)
    rows = tokens.where(F.col("count") >= max(3, p.frequent * sampled)).orderBy(F.desc("count"), "token").limit(p.most_frequent).toArrow()
    token = rows["token"].to_numpy().view(np.uint64)
    class_ = np.ceil(np.log2(rows["count"].to_numpy() * (n_sets / max(1, sampled)))).astype(np.uint64)
    order = np.argsort(token)
    return token[order], class_[order]


def _ident(part: np.ndarray, body: np.ndarray, bits: int) -> np.ndarray:
    """58 bits of a shingle: its range and what is left of its 40 bits."""
    return ((part << np.uint64(40)) | body) >> np.uint64(max(0, bits - 18))


def _deal(docs: DataFrame, bits: int, p: Join, frequent: tuple[np.ndarray, np.ndarray], n_out: int) -> DataFrame:
    """The shingles of the task's distinct sets, one row per range (and ``flush_shingles``). Frequent ones have
    part -1 - t, for the sets dealt to t, and come as class and id, 8 bytes each in ``low``."""
    k, flush_at = p.words, p.flush_shingles
    hot, hot_class = frequent
    schema = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("ents", "lens", "sizes", "low", "high")]])

    def flush(sets: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        ents = np.array([e for e, _ in sets], np.int64)
        n = np.array([len(s) for _, s in sets], np.int64)
        tokens = np.concatenate([s for _, s in sets])
        part = (tokens >> np.uint64(64 - bits)).astype(np.int64)
        body = (tokens >> np.uint64(24 - bits)) & np.uint64((1 << 40) - 1)
        owner = np.repeat(np.arange(len(sets)), n)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
            is_hot = hot[at] == tokens
            body[is_hot] = hot_class[at[is_hot]] << np.uint64(58) | _ident(part[is_hot].astype(np.uint64), body[is_hot], bits)
            part[is_hot] = -1 - (ents[owner[is_hot]].view(np.uint64) % np.uint64(n_out)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, body, owner = part[order], body[order], owner[order]
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        rows = []
        for a, b in zip(edge, np.append(edge[1:], len(part))):
            o = owner[a:b]
            at = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
            row = {"part": int(part[a]), **_pack(ents[o[at]], np.diff(np.append(at, len(o))), n[o[at]], body[a:b])}
            rows.append(row if row["part"] >= 0 else {**row, "low": body[a:b].tobytes(), "high": b""})
        return pa.RecordBatch.from_pylist(rows, schema)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, sets, size = _Words(), set(), [], 0
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                s = shingles(t.as_py(), hashes, k)
                if not len(s) or (e := _set_key(s)) in seen:
                    continue
                seen.add(e)
                sets.append((e, s))
                size += len(s)
                if size >= flush_at:
                    yield flush(sets)
                    sets, size = [], 0
        if sets:
            yield flush(sets)

    return docs.select("text").mapInArrow(f, PACKED)


def _unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of all rows of a group: set keys, lengths and sizes per entry, 40-bit shingles or frequent ones as dealt."""
    joined = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
    if table["part"][0].as_py() < 0:
        return joined("ents", np.int64), joined("lens", np.uint32).astype(np.int64), joined("sizes", np.uint32), joined("low", np.uint64)
    tokens = joined("low", np.uint32).astype(np.uint64) | (joined("high", np.uint8).astype(np.uint64) << np.uint64(32))
    return joined("ents", np.int64), joined("lens", np.uint32).astype(np.int64), joined("sizes", np.uint32), tokens


def _shared(dealt: DataFrame, bits: int, n_out: int) -> DataFrame:
    """Shingles in two sets or more, as class of the count (6 bits) and id (58 bits), dealt by set."""
    schema = pa.schema([("to", pa.int32()), ("ents", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])

    def f(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        ents, lens, sizes, tokens = _unpack(table)
        if part < 0:
            row = {"to": -1 - part, "ents": np.repeat(ents, lens).tobytes(), "sizes": np.repeat(sizes, lens).tobytes(), "ids": tokens.tobytes()}
            return pa.Table.from_pylist([row], schema)
        first = np.zeros(len(ents), bool)
        first[np.unique(ents, return_index=True)[1]] = True   # copies of a set seen by several tasks
        keep = np.repeat(first, lens)
        ents, sizes, owner, tokens = ents[first], sizes[first], np.repeat(np.arange(first.sum()), lens[first]), tokens[keep]
        order = np.argsort(tokens, kind="stable")
        sorted_ = tokens[order]
        edge = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, int)
        count = np.diff(np.append(edge, len(sorted_)))
        class_ = np.zeros(len(tokens), np.uint64)
        class_[order] = np.repeat(np.ceil(np.log2(count)).astype(np.uint64), count)
        keep = class_ > 0
        packed = (class_ << np.uint64(58) | _ident(np.uint64(part), tokens, bits))[keep]
        owner = owner[keep]
        out = (ents.view(np.uint64) % np.uint64(n_out)).astype(np.int64)[owner]
        order = np.argsort(out, kind="stable")
        out, owner, packed = out[order], owner[order], packed[order]
        edge = np.flatnonzero(np.append(True, out[1:] != out[:-1])) if len(out) else np.zeros(0, int)
        rows = [{"to": int(out[a]), "ents": ents[owner[a:b]].tobytes(), "sizes": sizes[owner[a:b]].tobytes(), "ids": packed[a:b].tobytes()}
                for a, b in zip(edge, np.append(edge[1:], len(out)))]
        return pa.Table.from_pylist(rows, schema)

    return dealt.groupBy("part").applyInArrow(f, "to int, ents binary, sizes binary, ids binary")


def _prefixed(shared: DataFrame, percent: int) -> DataFrame:
    """(ent, n, alone, prefix, ids): sets whose prefix holds a shared shingle.

    alone: shingles of no other set, they fill the prefix first; ids: all shared shingles in order, 8 bytes each.
    """
    def f(table: pa.Table) -> pa.Table:
        joined = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
        ents, sizes, ids = joined("ents", np.int64), joined("sizes", np.uint32), joined("ids", np.uint64)
        order = np.lexsort((ids, ents))
        ents, ids = ents[order], ids[order]
        new = np.append(True, (ents[1:] != ents[:-1]) | (ids[1:] != ids[:-1]))[:len(ents)]   # frequent shingles of copies seen by several tasks
        ents, sizes, ids = ents[new], sizes[order][new].astype(np.int64), ids[new]
        edge = np.flatnonzero(np.append(True, ents[1:] != ents[:-1])) if len(ents) else np.zeros(0, int)
        rows = []
        for a, b in zip(edge, np.append(edge[1:], len(ents))):
            n = int(sizes[a])
            alone = n - int(b - a)
            rest = n - -(-n * percent // 100) + 1 - alone
            if rest > 0:
                rows.append({"ent": int(ents[a]), "n": n, "alone": alone, "prefix": ids[a:a + rest].view(np.int64), "ids": ids[a:b].tobytes()})
        return pa.Table.from_pylist(rows, pa.schema([("ent", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()),
                                                     ("prefix", pa.list_(pa.int64())), ("ids", pa.binary())]))

    return shared.groupBy("to").applyInArrow(f, "ent long, n long, alone long, prefix array<long>, ids binary")


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    ids = lambda x: np.frombuffer(x.as_py(), np.uint64)
    return pa.array([len(np.intersect1d(ids(x), ids(y), assume_unique=True)) for x, y in zip(a, b)], pa.int64())


def _enough(common: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * common >= percent * (n + m - common)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of (a, b). AQE splits the pairs of a leader that many sets are compared with."""
    one = lambda x: sets.select(F.col("ent").alias(x), F.col("n").alias(f"n_{x}"), F.col("ids").alias(f"ids_{x}"))
    both = pairs.select("a", "b").distinct().join(one("a"), "a").join(one("b"), "b")
    common = F.arrow_udf(_common, "long")
    return both.withColumn("common", common("ids_a", "ids_b")).where(_enough(F.col("common"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(ent, label): each linked set with the smallest key it can reach. Neighbours' minima and
    label jumps alternate until nothing changes; all state stays in tables."""
    # both directions of a link from one pass, so that what finds the links runs once without a table of them
    one = lambda x, y: F.struct(F.col(x).alias("ent"), F.col(y).alias("other"))
    edges = materialize(links.select(F.explode(F.array(one("a", "b"), one("b", "a"))).alias("l")).select("l.ent", "l.other").distinct(), "jaccard-edges")
    labels = materialize(edges.groupBy("ent").agg(F.least("ent", F.min("other")).alias("label")), "jaccard-labels")
    while True:
        near = edges.join(labels.select(F.col("ent").alias("other"), "label"), "other").groupBy("ent").agg(F.min("label").alias("near"))
        step = labels.join(near, "ent").select("ent", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col("ent").alias("label"), F.col("label").alias("far"))
        new, seen = materialize_with(step.join(jump, "label", "left").select("ent", F.least("label", "far").alias("label"), "was"), "jaccard-labels",
                                     changed=F.count_if(F.col("label") != F.col("was")))
        labels = new.select("ent", "label")
        if not seen.get("changed"):
            return labels


def _size_class(n: Column, percent: int) -> Column:
    """Sets that can be linked are in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) - 1e-9).cast("int")


def linked_sets(docs: DataFrame, members: DataFrame, p: Join = Join()) -> DataFrame:
    """(ent, label) of the sets with candidates."""
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(20, max(6, int(total // p.range_shingles).bit_length()))
    dealt = _deal(docs, bits, p, _frequent(docs, members, p), 1 << bits)
    shared = _shared(dealt.repartition(1 << bits, "part"), bits, 1 << bits)
    sets = materialize(_prefixed(shared.repartition(1 << bits, "to"), p.percent), "jaccard-sets")

    # groups: identical prefix and size; each member against the leader
    group = F.xxhash64("n", "prefix")
    grouped = sets.select("ent", "n", "alone", "prefix", group.alias("gid"))
    leaders = grouped.groupBy("gid").agg(F.min("ent").alias("a"), F.count("*").alias("size")).where("size > 1")
    first = _verify(grouped.join(leaders, "gid").where("ent <> a").select("a", F.col("ent").alias("b")), sets, p.percent)
    first = materialize(first, "jaccard-links")
    units = materialize(grouped.join(first.select(F.col("b").alias("ent"), F.col("a").alias("unit")), "ent", "left")
                        .withColumn("unit", F.coalesce("unit", "ent")), "jaccard-units")
    weight = units.groupBy("unit").agg(F.count("*").alias("weight"))
    entry = (units.where("ent = unit").join(weight, "unit")
                  .select("unit", "n", "alone", "weight", _size_class(F.col("n"), p.percent).alias("class"), F.posexplode("prefix").alias("i", "token"))
                  .select("token", "class", "unit", "n", "weight", (F.col("alone") + F.col("i")).alias("pos")))
    entry = materialize(entry, "jaccard-entries")
    buckets = entry.groupBy("token").agg(F.sum("weight").alias("sets"), F.count("*").alias("units")).where("units > 1")
    buckets = materialize(buckets, "jaccard-buckets")
    told, seen = materialize_with(entry.join(buckets.select("token", (F.col("sets") > p.bucket).alias("large")), "token"), "jaccard-bucketed", large=F.count_if("large"))
    small, large, n_large = told.where("not large").drop("large"), told.where("large").drop("large"), seen.get("large") or 0

    def fits(x: str, y: str) -> Column:
        """Sizes within the threshold, and enough shingles from the common one on: a linked pair passes
        this at its first common shingle."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        most = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
        return (100 * F.least(n, m) >= p.percent * F.greatest(n, m)) & _enough(most, n, m, p.percent)

    def expanded(pairs: DataFrame) -> DataFrame:
        """Pairs of units to pairs of their members."""
        of = lambda x, y: units.select(F.col("unit").alias(x), F.col("ent").alias(y))
        return pairs.distinct().join(of("u", "a"), "u").join(of("v", "b"), "v").select("a", "b")

    near = expanded(small.alias("x").join(small.alias("y"), F.col("x.token") == F.col("y.token"))
                    .where((F.col("x.unit") < F.col("y.unit")) & fits("x", "y")).select(F.col("x.unit").alias("u"), F.col("y.unit").alias("v")))
    links = first.union(_verify(near, sets, p.percent))
    labels = materialize(grouped.select("ent").join(components(links), "ent", "left").select("ent", F.coalesce("label", "ent").alias("label")), "jaccard-labels")
    if not n_large:
        return labels

    def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
        """Labels after new links; of links between the same two components one is as good as all."""
        of = lambda x: labels.select(F.col("ent").alias(x), F.col("label").alias(f"l_{x}"))
        between = found.join(of("a"), "a").join(of("b"), "b").select(F.col("l_a").alias("a"), F.col("l_b").alias("b")).distinct()
        to = components(between).select(F.col("ent").alias("label"), F.col("label").alias("to"))
        return materialize(labels.join(to, "label", "left").select("ent", F.coalesce("to", "label").alias("label")), "jaccard-labels")

    # window w of a bucket holds the size classes w and w + 1 and compares the pairs whose smaller class is w
    windows = F.explode(F.array(F.col("class") - 1, F.col("class"))).alias("w")
    before, r = float("inf"), 0
    while True:
        large_now = materialize(large.join(labels.withColumnRenamed("ent", "unit"), "unit"), "jaccard-large")
        wide = large_now.select("token", windows, "class", "unit", "n", "pos", "label")
        # the largest component of each window, with other leaders each round
        leaders = F.array(*[F.min_by("unit", F.xxhash64(F.lit(r * p.leaders + i), "unit")) for i in range(p.leaders)])
        by_label = wide.groupBy("token", "w", "label").agg(F.count("*").alias("k"), F.count_if(F.col("class") == F.col("w")).alias("k_low"), leaders.alias("leaders"))
        main = materialize(by_label.groupBy("token", "w").agg(F.max(F.struct("k", "label", "leaders")).alias("m"), F.sum("k").alias("all"), F.sum("k_low").alias("low"))
                           .where("low > 0").select("token", "w", "all", "low", "m.leaders", F.col("m.label").alias("main")), "jaccard-main")
        # of two units of different components at least one is outside the window's largest
        stray, seen = materialize_with(wide.join(main, ["token", "w"]).where("label <> main")
                                       .withColumn("meets", F.when(F.col("class") == F.col("w"), F.col("all")).otherwise(F.col("low"))),
                                       "jaccard-strays", left=F.sum("meets"))
        left = seen.get("left") or 0
        if left <= p.listed * n_large or left > 0.9 * before:   # few pairs are left, or leaders no longer help
            break
        before, r = left, r + 1
        pairs = stray.select(F.col("unit").alias("a"), F.explode("leaders").alias("b"))
        labels = merged(labels, _verify(pairs, sets, p.percent))
    # whoever is outside the largest component of a window meets all of the window
    rest = (stray.alias("x").join(wide.alias("y"), ["token", "w"])
            .where((F.col("x.label") != F.col("y.label")) & (F.least("x.class", "y.class") == F.col("w")) & fits("x", "y"))
            .select(F.least("x.unit", "y.unit").alias("u"), F.greatest("x.unit", "y.unit").alias("v")))
    return merged(labels, _verify(expanded(rest), sets, p.percent))


def near_duplicates(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id): one row per row of ``docs`` (doc_id, text).

    Null text and text without words: empty set, linked with nothing, its own component. Repeated rows are
    copies of each other. A component of null ids only has a null id. Empty table: no rows.
    """
    bounded_batches(docs.sparkSession)
    members = materialize(sets_of(docs, p), "jaccard-members")
    labels = linked_sets(docs, members, p)
    labelled = members.join(labels, "ent", "left").withColumn("label", F.coalesce("label", "ent"))
    smallest = labelled.where(F.col("ent").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = labelled.where(F.col("ent").isNotNull()).join(smallest, "label").select("doc_id", "text_key", "n", "component_id")
    empty = members.where(F.col("ent").isNull()).select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumnRenamed("n", "n_shingles")


def one_of_each(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """``docs`` without near duplicates: of each component the row of the smallest id (one of repeated rows);
    rows without words stay."""
    found = near_duplicates(docs, p)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(
        F.col("doc_id").alias("_jj_id"), F.col("text_key").alias("_jj_key")).agg(F.max("n_shingles").alias("_jj_n"))
    keyed = docs.withColumn("_jj_text", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_jj_id")) & (F.col("_jj_text") == F.col("_jj_key"))
    again = Window.partitionBy("doc_id", "_jj_text").orderBy(F.lit(0))
    out = keyed.join(keep, same).withColumn("_jj_row", F.row_number().over(again)).where((F.col("_jj_row") == 1) | (F.col("_jj_n") == 0))
    return out.select(*[docs[c] for c in docs.columns])
