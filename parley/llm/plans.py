"""Registered queries of the numbered operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (align, decontaminate, jaccard, langid, linededup, mixing, phrases, search, secrets, sharding, substring, toxicity,
                        warc)
from parley.llm.common import held_out, scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op6_mix_sources")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", *mixing.OUT, "source")


@query("op7_shard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_records(docs).select("doc_id", *sharding.OUT)


OP2_SQL = r"""
WITH words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM words WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT rid, i, dw.n, item_id FROM dw JOIN win USING (n, g)),
pos AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN items USING (rid)
"""


@query("op2_decontaminate", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "threshold", "flagged")


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, min(r.b)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n
"""


@query("op4_jaccard_join", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


OP1_PATTERNS = [
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2),
    ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]{16,}", 0), ("key", "[A-Za-z0-9+/]{32,}={0,2}", 0),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?\b", 0)]
# Matches and the gaps between them give positions; weak spans meet every other span of their row. The patterns spell
# both cases out: RE2's (?i) also folds letters outside ASCII.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS (""" + " UNION ALL ".join(
    f"SELECT rid, '{kind}' AS kind, string_split_regex(t, '{x}') AS g, regexp_extract_all(t, '{x}', 0) AS a, regexp_extract_all(t, '{x}', {group}) AS v\n"
    f"  FROM d WHERE regexp_matches(t, '{x}')" for kind, x, group in OP1_PATTERNS) + r"""),
o AS (SELECT rid, kind, unnest(list_zip(g[1:len(a)], a, v, range(len(a)))) AS z, g, a FROM m),
s AS (SELECT rid, kind, (list_sum(list_transform(g[1:z[4] + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(a[1:z[4]], lambda x: length(x))), 0))::BIGINT AS b,
  length(z[2]) AS len, z[3] AS v, length(z[3]) AS size FROM o),
k AS (SELECT rid, b, b + len AS e, CASE
    WHEN kind = 'assign' THEN CASE WHEN size >= 12 THEN 'assign' WHEN size >= 6 THEN 'short_assign' END
    WHEN kind = 'access' THEN CASE WHEN size >= 18 THEN 'access' WHEN size >= 12 THEN 'short_access' END
    WHEN kind = 'hex' THEN 'hex'
    WHEN kind = 'key' THEN CASE WHEN regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]') THEN 'key' END
    ELSE 'endpoint' END AS kind FROM s),
r AS (SELECT k.*, nr, role, nr >= 3 AS weak FROM k JOIN (VALUES ('assign', 0, 's'), ('access', 1, 'i'), ('hex', 2, 'h'), ('short_assign', 3, 's'),
    ('short_access', 4, 'i'), ('key', 5, 's'), ('endpoint', 6, 'e')) AS n(kind, nr, role) USING (kind)),
linked AS (SELECT x.* FROM r AS x WHERE weak AND EXISTS (SELECT 1 FROM r AS y WHERE y.rid = x.rid AND (x.b >= y.e OR y.b >= x.e)
    AND x.b - y.e <= 256 AND y.b - x.e <= 256 AND (x.role || y.role) IN ('si', 'is', 'se', 'es', 'hi', 'ih', 'ie', 'ei'))),
base AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, nr) AS digest FROM r WHERE NOT weak GROUP BY rid),
every AS (SELECT rid, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, nr) AS spans, count(*) FILTER (weak) AS n_linked
  FROM (SELECT * FROM r WHERE NOT weak UNION ALL SELECT * FROM linked) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(digest, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0)::BIGINT AS n_linked
FROM d LEFT JOIN base USING (rid) LEFT JOIN every USING (rid)
"""


@query("op1_secret_scan", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text, i, line FROM (SELECT doc_id, text, unnest(range(len(x))) AS i, unnest(x) AS line
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM d)) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
t AS (SELECT doc_id, text, i, string_split(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS t FROM l),
g AS (SELECT *, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS g FROM t),
k AS (SELECT doc_id, text, i, t, g, len(t) || ' ' || array_to_string(g[1:6], ' ') AS k FROM g),
leaf AS (SELECT k FROM (SELECT DISTINCT k, doc_id, text FROM k) GROUP BY k HAVING count(*) >= 3),
c AS (SELECT k, g, count(DISTINCT (doc_id, text)) AS n FROM k SEMI JOIN leaf USING (k) GROUP BY k, g),
p AS (SELECT k, g, n, unnest(range(len(g))) AS j, unnest(g) AS x FROM c),
q AS (SELECT k, j, x FROM p GROUP BY k, j, x HAVING sum(n) >= 3),
alike AS (SELECT k, g FROM p SEMI JOIN q USING (k, j, x) GROUP BY k, g HAVING 100 * count(*) >= 75 * len(g)),
own AS (SELECT t FROM (SELECT DISTINCT t, doc_id, text FROM k WHERE len(t) >= 20) GROUP BY t HAVING count(*) >= 2),
dropped AS (SELECT doc_id, text, i FROM k SEMI JOIN alike USING (k, g) UNION SELECT doc_id, text, i FROM k SEMI JOIN own USING (t)),
x AS (SELECT doc_id, text, list(i) AS i FROM dropped GROUP BY doc_id, text),
n AS (SELECT doc_id, text, count(*) AS n FROM l GROUP BY doc_id, text)
SELECT o.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(len(x.i), 0)::BIGINT AS n_dropped,
  CASE WHEN x.i IS NULL THEN o.text ELSE coalesce((SELECT string_agg(line, chr(10) ORDER BY j) FROM
    (SELECT unnest(range(len(y))) AS j, unnest(y) AS line FROM (SELECT string_split(o.text, chr(10)) AS y)) WHERE NOT list_contains(x.i, j)), '') END AS clean_text
FROM documents o LEFT JOIN x ON x.doc_id = o.doc_id AND x.text = o.text LEFT JOIN n ON n.doc_id = o.doc_id AND n.text = o.text
"""


@query("op3_line_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", *linededup.OUT)


OP10_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS s FROM p),
g AS (SELECT page_id, n, s, min(page_id) OVER (PARTITION BY s) AS first FROM h)
SELECT page_id, n AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (j // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31)::INT + 1, 1), '' ORDER BY j)
   FROM (SELECT unnest(range(32)) AS j)) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


@query("op10_warc", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read(spark, path, payloads=False).drop("url")


OP9_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT rid, doc_id, len, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
g AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
q AS (SELECT DISTINCT doc_id AS query_id, term FROM t WHERE doc_id % 50 = 0),
s AS (SELECT query_id, rid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM q JOIN t USING (term) JOIN df USING (term), g GROUP BY query_id, rid, doc_id)
SELECT query_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


@query("op9_topk_search", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, queries)


OP11_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, w[i:i + k - 1] AS g FROM
    (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))) GROUP BY lang, g HAVING count(*) >= 30),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
cut AS (SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c) AS c
  JOIN f AS x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f AS y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
s AS (SELECT lang, g, a, l, r, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, g[i:i + k - 1] AS g, max(a) AS longer FROM (SELECT lang, g, a, k, unnest(range(1, len(g) - k + 2)) AS i
  FROM c, (SELECT unnest([2, 3]) AS k) WHERE k < len(g)) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(array_to_string(s.g, ' '))) AS rank,
    array_to_string(s.g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
  FROM s JOIN n USING (lang) LEFT JOIN inner_ AS i ON i.lang = s.lang AND i.g = s.g WHERE i.longer IS NULL OR 100 * i.longer < 80 * a)
WHERE rank <= 2000
"""


@query("op11_phrases", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents").select("text", "lang"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS i FROM win JOIN f USING (g) WHERE first < doc_id),
kept AS (SELECT rid, count(g.i) AS n, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY w.i) AS t
  FROM (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d) AS w LEFT JOIN gone AS g USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""


@query("op12_substring_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.parsed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("factors")


@query("op13_align_tokens")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *align.OUT)
