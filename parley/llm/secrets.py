"""Secret scan with multipart credential linking.

Strong spans are reported as they are. Weak parts (short access identifiers, short assigned values,
long mixed tokens, endpoints) are reported only when a part of another role (identifier, secret,
endpoint) stands within ``scope`` code points in the same text and doesn't overlap them: parts and the scopes of the weak
ones are dealt to blocks of that length and joined by block, then by distance. A hex run doesn't complement an
endpoint: hashes stand near URLs in ordinary texts. Equal texts are linked once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import materialize

OUT = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]

ASSIGN_START = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"                       # maximal runs, so the same as runs of 16 or more
KEY = r"([A-Za-z0-9+/]{32,}={0,2})"
# \w is ASCII in every Java version, \b isn't.
ENDPOINT = r"(https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|(?<!\w)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?!\w))"

# In the order of kinds that start at the same place; role of each.
KINDS = ["assign", "access", "hex", "short_assign", "short_access", "key", "endpoint"]
ROLES = ["secret", "identifier", "hex", "secret", "identifier", "secret", "endpoint"]
# Roles that complement each other.
PARTNERS = {"secret": ["identifier", "endpoint"], "hex": ["identifier"], "identifier": ["secret", "hex", "endpoint"], "endpoint": ["secret", "identifier"]}
SPAN = "array<struct<start:int,end:int,kind:int>>"


@dataclass(frozen=True)
class Secrets:
    assign_chars: int = 12
    access_chars: int = 18
    weak_assign_chars: int = 6
    weak_access_chars: int = 12
    scope: int = 256


def _matches(text: Column, pattern: str, group: int, guard: str | None = None) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, size of the group, value): lengths of
    what lies between them, added up. Most texts fail the guard and cost one search."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,size:int,part:string>>").alias("found"))
    found = F.aggregate(F.filter(zipped, lambda x: x["all"].isNotNull()), start, lambda a, x: F.struct(
        (a["at"] + F.length(x["gap"]) + F.length(x["all"])).alias("at"),
        F.concat(a["found"], F.array(F.struct(
            (a["at"] + F.length(x["gap"])).alias("start"), (a["at"] + F.length(x["gap"]) + F.length(x["all"])).alias("end"),
            F.length(x["part"]).alias("size"), x["part"].alias("part")))).alias("found")), lambda a: a["found"])
    return F.when(text.rlike(guard or pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,size:int,part:string>>"))


def _of_kind(found: str, kind: str, test) -> Column:
    k = KINDS.index(kind)
    return F.transform(F.filter(found, test), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(k).alias("kind")))


def parts_of(docs: DataFrame, p: Secrets = Secrets()) -> DataFrame:
    """(doc_id, key, base, weak): strong and weak spans of each text; the key is null where nothing can be linked."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"), _matches(text, ASSIGN, 2, ASSIGN_START).alias("assign"), _matches(text, ACCESS, 1).alias("access"),
                        _matches(text, HEX, 1).alias("hex"), _matches(text, KEY, 1).alias("key_"), _matches(text, ENDPOINT, 1).alias("endpoint"))
    base = F.concat(_of_kind("assign", "assign", lambda x: x["size"] >= p.assign_chars),
                    _of_kind("access", "access", lambda x: x["size"] >= p.access_chars),
                    _of_kind("hex", "hex", lambda x: F.lit(True)))
    mixed = lambda x: x["part"].rlike("[A-Z]") & x["part"].rlike("[a-z]") & x["part"].rlike("[0-9]")
    weak = F.concat(_of_kind("assign", "short_assign", lambda x: (x["size"] < p.assign_chars) & (x["size"] >= p.weak_assign_chars)),
                    _of_kind("access", "short_access", lambda x: (x["size"] < p.access_chars) & (x["size"] >= p.weak_access_chars)),
                    _of_kind("key_", "key", mixed), _of_kind("endpoint", "endpoint", lambda x: F.lit(True)))
    out = found.select("doc_id", "text", base.cast(SPAN).alias("base"), weak.cast(SPAN).alias("weak"))
    linkable = (F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1)
    return out.select("doc_id", F.when(linkable, F.md5(F.col("text").cast("binary"))).alias("key"), "base", "weak")


def linked(parts: DataFrame, p: Secrets = Secrets()) -> DataFrame:
    """(key, linked): the weak spans with a complementary part in scope."""
    texts = parts.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("s.kind") + 1)
    spans = lambda c: texts.select("key", F.explode(c).alias("s")).select("key", "s", role.alias("role"))
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.greatest(a, F.lit(0)) / p.scope), F.floor(b / p.scope))).alias("block")
    every = spans(F.concat("base", "weak")).select("key", "s", "role", blocks(F.col("s.start"), F.col("s.end") - 1))
    scopes = spans("weak").select("key", "s", "role", blocks(F.col("s.start") - p.scope, F.col("s.end") + p.scope))
    x, y = F.col("x.s"), F.col("y.s")
    near = (x["start"] - y["end"] <= p.scope) & (y["start"] - x["end"] <= p.scope)
    apart = (x["start"] >= y["end"]) | (y["start"] >= x["end"])
    partners = F.create_map(*[c for r, others in PARTNERS.items() for c in (F.lit(r), F.array(*[F.lit(o) for o in others]))])
    pairs = scopes.alias("x").join(every.alias("y"), ["key", "block"]).where(F.array_contains(partners[F.col("x.role")], F.col("y.role")) & near & apart)
    return pairs.groupBy("key").agg(F.collect_set(x).alias("linked"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, p: Secrets = Secrets()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Null text is empty: no spans. Positions are code points, end exclusive. Spans of several
    kinds may overlap; order is start, then kind. Repeated rows: one result each. Empty table: no rows.
    """
    parts = materialize(parts_of(docs, p), "secret-parts")
    none = F.array().cast(SPAN)
    plain = parts.where(F.col("key").isNull()).select("doc_id", "base", none.alias("linked"))
    some = parts.where(F.col("key").isNotNull()).join(linked(parts, p), "key", "left").select("doc_id", "base", F.coalesce("linked", none).alias("linked"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return plain.unionByName(some).select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"))


def redacted(docs: DataFrame, p: Secrets = Secrets(), mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of its texts replaced by ``mark``; overlapping spans become one.

    Spans depend on the text alone and are joined by it, so null and repeated ids, with equal or different texts, don't matter. All rows and
    columns stay; null texts stay null, empty ones empty. Empty table: no rows.
    """
    spans = F.transform(F.split("_sr_spans", ","), lambda s: F.struct(
        F.element_at(F.split(s, ":"), 2).cast("int").alias("start"), F.element_at(F.split(s, ":"), 3).cast("int").alias("end")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate(spans, start, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    keyed = docs.withColumn("_sr_key", F.sha2(F.col("text").cast("binary"), 256))
    found = scan(keyed.select(F.col("_sr_key").alias("doc_id"), "text"), p).where("spans <> ''")
    found = found.select(F.col("doc_id").alias("_sr_key"), F.col("spans").alias("_sr_spans")).distinct()
    out = keyed.join(found, "_sr_key", "left")
    return out.select(*[F.when(F.col("_sr_spans").isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
