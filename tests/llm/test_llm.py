"""Operators of the training-data pipeline on small hand tables, against plain Python."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import common, decontaminate, jaccard, langid, linededup, mixing, search, secrets, sharding, toxicity, warc
from parley.llm.common import id_hash, learnable, scratch_path, small_table, smallest_hashes

DOCS = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def edge_rows():
    return [(1, None, "en", "a"), (2, "", "en", None), (3, "   ", None, "a"), (None, "one two three", "en", "b"),
            (4, "one two three", "en", "b"), (4, "one two three", "en", "b"), (5, "word " * 30_000, "en", "a")]


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_secrets(spark, empty):
    long_key = "Ab3" * 14
    rows = [(1, 'x password = "abcdefghijkl" and token:short1', "", ""), (2, "AKIA" + "Z" * 14 + " é " + "0" * 16, "", ""), (3, None, "", ""),
            (4, f"alone {long_key}", "", ""), (5, f"https://h.example.org:80/ {long_key}", "", ""), (6, f"{long_key}" + " x" * 300 + " https://h.org", "", ""),
            (7, "password: token = abcdefghijklmnop", "", ""), (8, "1.2.3.4 AKIAABCDEFGHIJ", "", ""), (8, "1.2.3.4 AKIAABCDEFGHIJ", "", "")]
    got = {r.doc_id: r for r in secrets.scan(docs_of(spark, rows)).collect()}
    assert (got[1].n_assign, got[2].n_access, got[2].n_hex, got[3].spans) == (1, 1, 1, "")
    assert got[1].spans == "assign:2:26" and got[1].base_sha256 == hashlib.sha256(b"assign:2:26").hexdigest()
    assert got[2].spans == "access:0:18,hex:21:37"
    assert got[4].spans == "" and got[6].spans == "" and got[7].spans == ""      # weak and alone, out of scope, consumed
    assert got[5].spans == f"endpoint:0:24,key:26:{26 + len(long_key)}" and got[8].n_linked == 2
    assert secrets.scan(docs_of(spark, rows)).count() == len(rows) and secrets.scan(empty).count() == 0
    clean = {r.doc_id: r.text for r in secrets.redacted(docs_of(spark, rows[:2])).collect()}
    assert clean[1] == "x [secret]\" and token:short1"


def brute_spans(text):
    """All spans that the scan reports, by plain loops over ``re`` matches."""
    t, found = text or "", []
    for m in re.finditer(r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        n = len(m[1])
        found += [("assign" if n >= 12 else "short_assign", *m.span())] if n >= 6 else []
    for m in re.finditer("AKIA[A-Z0-9]+", t):
        found += [("access" if len(m[0]) >= 18 else "short_access", *m.span())] if len(m[0]) >= 12 else []
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    found += [("key", *m.span()) for m in re.finditer("[A-Za-z0-9+/]{32,}={0,2}", t) if all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    ends = r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?\b"
    found += [("endpoint", *m.span()) for m in re.finditer(ends, t, re.ASCII)]
    strong, who = {"assign", "access", "hex"}, {"access": "i", "short_access": "i", "endpoint": "e", "hex": "h"}
    role = lambda s: who.get(s[0], "s")
    near = lambda x, y: (x[1] >= y[2] and x[1] - y[2] <= 256) or (y[1] >= x[2] and y[1] - x[2] <= 256)
    kept = [x for x in found if x[0] in strong or any(
        role(x) != role(y) and {role(x), role(y)} not in ({"h", "e"}, {"h", "s"}) and near(x, y) for y in found)]
    kept.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    digest = ",".join(f"{k}:{a}:{b}" for k, a, b in kept if k in strong)
    n = [sum(k == kind for k, *_ in kept) for kind in ("assign", "access", "hex")]
    return (*n, hashlib.sha256(digest.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in kept), sum(k not in strong for k, *_ in kept))


def secret_texts(n=300):
    rnd = random.Random(11)
    some = lambda chars, a, b: "".join(rnd.choice(chars) for _ in range(rnd.randint(a, b)))
    up, low, dig = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    make = [lambda: rnd.choice(["password", "PassWd", "api_key", "APIKEY", "toKen", "secret", "to\u212aen", "\u017fecret"]) + rnd.choice([": ", "=", '" : "', "'='", " "]) + some(up + low + dig + "+/_.=-", 3, 20),
            lambda: "AKIA" + some(up + dig, 4, 20), lambda: some("0123456789abcdef", 10, 40), lambda: some(up + low + dig + "+/", 28, 60) + rnd.choice(["", "=", "=="]),
            lambda: rnd.choice(["http://", "https://"]) + some(low + ".-", 1, 12) + rnd.choice(["", ":80", ":123456.1.2.3"]), lambda: ".".join(some(dig, 1, 4) for _ in range(4)),
            lambda: "x " * rnd.randint(0, 200), lambda: rnd.choice(["é", "\U0001f600", "\n", "_", "AKIA", "token="])]
    return ["".join(rnd.choice(make)() + rnd.choice(["", " ", " ", "é"]) for _ in range(rnd.randint(0, 9))) for _ in range(n)]


def test_secrets_brute_force(spark):
    texts = [*secret_texts(), None, "", "word " * 30_000 + "AKIAABCDEFGHIJ 10.0.0.1", "0" * 100_000]
    rows = [(None if k % 50 == 7 else k // 2, t, "", "") for k, t in enumerate(texts)] * 2       # null ids, two texts under one id, repeated rows
    got = sorted(map(str, (tuple(r) for r in secrets.scan(docs_of(spark, rows).withColumn("key", F.lit(1)).withColumn("spans", F.lit("x"))).collect())))
    assert got == sorted(str((i, *brute_spans(t))) for i, t, *_ in rows)
    assert sum("short_access" in r or "endpoint" in r for r in got) > 50


def test_secrets_of_ordinary_texts(spark):
    """A URL beside a commit hash, or with a long token in its own path, isn't a credential in parts."""
    rows = [(1, "see commit " + "0123456789abcdef" * 2 + " at https://git.example.org/x", "", ""), (2, "https://h.example.org/" + "Ab3" * 12, "", "")]
    got = {r.doc_id: r.spans for r in secrets.scan(docs_of(spark, rows)).collect()}
    assert got[1] == "hex:11:43" and got[2] == ""


def test_redaction_by_text(spark, empty):
    rows = [(None, "password=abcdefghijklmnop x", "", ""), (1, "token: abcdefghijklmnop!", "", ""), (1, "a password=abcdefghijklmnop", "", ""),
            (1, "a password=abcdefghijklmnop", "", ""), (2, None, "", ""), (3, "", "", ""), (None, "nothing here", "", ""), (4, "é" * 40_000 + " secret=abcdefghijklmnop " + "z " * 9, "", "")]
    df = docs_of(spark, rows).withColumn("spans", F.lit("1:2:3"))
    got = sorted((str(r.doc_id), str(r.text), r.spans) for r in secrets.redacted(df).collect())
    want = [("None", "[secret] x"), ("1", "[secret]!"), ("1", "a [secret]"), ("1", "a [secret]"), ("2", "None"), ("3", ""), ("None", "nothing here"),
            ("4", "é" * 40_000 + " [secret] " + "z " * 9)]
    assert got == sorted((*w, "1:2:3") for w in want)
    assert secrets.redacted(empty).count() == 0


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    hit, found = set(), set()
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            for b in range(len(words) - n + 1):
                if words[b:b + n] == w[a:a + n]:
                    hit.update(range(b, b + n))
                    if i is not None:
                        found.add(i)
    ids = ",".join(sorted(map(str, found)))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_decontamination(spark, empty):
    rnd = random.Random(1)
    items = [(i, " ".join(rnd.choice("abcÄé") * rnd.randint(1, 2) for _ in range(n))) for i, n in enumerate([25, 12, 3, 10, 0])] + [(None, "Q r S"), (9, None), (2, "zz yy"), (2, "zz yy")]
    texts = [f"X-{items[0][1].upper()} end", items[1][1] + " " + items[1][1], items[2][1], "q R s, zz! YY", "plain", items[3][1][:-1]]
    rows = [(k, t, "", "") for k, t in enumerate(texts)] + edge_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for p in (decontaminate.Decontamination(), decontaminate.Decontamination(broadcast_mb=0)):
        got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs_of(spark, rows), bench, p).collect()]
        assert sorted(map(str, got)) == sorted(str((i, *brute_hits(t, items))) for i, t, *_ in rows)
    df = docs_of(spark, rows)
    kept = decontaminate.clean_documents(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not brute_hits(t, items)[4] for _, t, *_ in rows)
    spans = decontaminate.clean_documents(df, bench, remove="spans")
    assert spans.count() == len(rows) and decontaminate.contamination(spans, bench).where("contaminated").count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_lines(spark, empty):
    note = "Order 17 was sent on 3 May"
    rows = [(k, f"own line {'abcdef'[k]} here\n{note.replace('17', str(k))}\n\n{note}", "", "") for k in range(5)] + edge_rows()
    got = {r.doc_id: r for r in linededup.dedup_lines(docs_of(spark, rows)).where("doc_id < 3 and n_lines > 1").collect()}
    assert {k: (r.n_lines, r.n_dropped, r.clean_text) for k, r in got.items()} == {k: (3, 2, f"own line {'abcdef'[k]} here\n") for k in range(3)}
    assert linededup.dedup_lines(docs_of(spark, rows)).count() == len(rows) and linededup.dedup_lines(empty).count() == 0
    assert linededup.dedup_lines(docs_of(spark, edge_rows())).where("n_dropped > 0").count() == 0


def brute_lines(rows, p):
    """doc_id, text -> dropped line numbers by the rule of the leaf, token by token."""
    lines = {}
    for doc in {(i, t) for i, t, *_ in rows if t is not None}:
        for n, line in enumerate(doc[1].split("\n")):
            t = tuple(x for x in re.split(r"[\x20\x09-\x0D]+", line) if x)
            if t:
                lines[doc, n] = t, tuple("<*>" if re.search("[0-9]", x) else x for x in t)
    leaf = lambda g: (len(g), g[:p.depth])
    docs, owners, at = {}, {}, {}
    for (doc, _), (t, g) in lines.items():
        docs.setdefault(leaf(g), set()).add(doc)
        owners.setdefault(t, set()).add(doc)
        for j, x in enumerate(g):
            at.setdefault((leaf(g), j, x), set()).add((doc, g))
    out = {doc: [] for doc, _ in lines}
    for (doc, n), (t, g) in lines.items():
        agree = sum(len(at[leaf(g), j, x]) >= p.min_documents for j, x in enumerate(g))
        if len(docs[leaf(g)]) >= p.min_documents and 100 * agree >= p.similarity * len(g) or len(t) >= p.long_tokens and len(owners[t]) >= 2:
            out[doc].append(n)
    return out


def test_lines_by_the_whole_template(spark):
    lead = "the six leading words are equal"
    tail = lambda c, n=40: " ".join(c + "abcdefghij"[k % 10] * (1 + k // 10) for k in range(n))
    rows = [(k, f"{lead} {tail(c)}", "", "") for k, c in enumerate("xyz")]                       # only begin alike
    rows += [(10 + k, f"head {'pq'[k]}\n{tail('same', 27)}", "", "") for k in range(2)]          # a long line in two documents
    rows += [(20 + k, f"{lead} {tail('n', 9)} {c}", "", "") for k, c in enumerate("uvw")]         # one variable field at the end
    rows += [(30, "very " * 30_000 + "long", "", ""), (31, "very " * 30_000 + "long", "", "")]
    docs = docs_of(spark, rows).withColumn("clean_text", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = {r.doc_id: (r.n_dropped, r.clean_text) for r in linededup.dedup_lines(docs).collect()}
    assert all(got[k][0] == 0 for k in range(3)) and got[10] == (1, "head p") and got[11] == (1, "head q")
    assert all(got[20 + k] == (1, "") for k in range(3)) and got[30] == got[31] == (1, "")


def test_lines_brute_force(spark):
    rnd = random.Random(8)
    line = lambda: " ".join(["a", rnd.choice("ab"), rnd.choice(["b", "7"]), *[rnd.choice(["c", "d", "e", "12", "9x"]) for _ in range(rnd.randint(0, 4))]])
    rows = [(k, "\n".join(rnd.choice(["", " ", line(), line() + "\t\x0b" + line()]) for _ in range(rnd.randint(0, 6))), "", "") for k in range(60)]
    rows += rows[:6] + [(3, "a b c\nother text of this id", "", ""), (None, "a b c", "", ""), (99, None, "", "")]
    p = linededup.LineDedup(depth=2, long_tokens=7)
    want = brute_lines(rows, p)
    got = linededup.dedup_lines(docs_of(spark, rows), p).select("doc_id", "text", "n_dropped", "clean_text").collect()
    assert len(got) == len(rows)
    for r in got:
        gone = want.get((r.doc_id, r.text), [])
        kept = None if r.text is None else "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone)
        assert (r.n_dropped, r.clean_text) == (len(gone), kept), r


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [y if v == x else v for v in label]
    out = []
    for a in range(len(rows)):
        ids = [rows[b][0] for b in range(len(rows)) if label[b] == label[a] and rows[b][0] is not None]
        out.append((rows[a][0], len(sets[a]), (min(ids) if ids else None) if sets[a] else rows[a][0]))
    return sorted(map(str, out))


@pytest.mark.parametrize("p", [jaccard.Join(), jaccard.Join(bucket=1, listed=0.0), jaccard.Join(bucket=2, range_shingles=50),
                               jaccard.Join(frequent=0.0), jaccard.Join(sample_sets=40, most_frequent=30, range_shingles=50), jaccard.Join(sample_sets=0)])
def test_jaccard(spark, empty, p):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 400)) for _ in range(n))
    rows, passage = [], text(40)
    for base in [text(n) for n in (60, 60, 90, 200)]:
        for _ in range(25):
            w = base.split()
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = "new" + str(rnd.randint(0, 9999))
            rows.append((1000 - len(rows), " ".join(w) if rnd.random() < 0.9 else " ".join(w).upper(), "", ""))
    rows += [(2000 + k, passage + " " + text(rnd.choice([5, 8, 40])), "", "") for k in range(30)] + edge_rows() + [(9, "Same Text", "", ""), (8, "same\ttext", "", "")]
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.near_duplicates(docs_of(spark, rows), p).collect())
    assert got == brute_components(rows)


def test_jaccard_frequent_shingles_pass_by_the_ranges(spark):
    """A passage in half of all texts: no range gets its shingles, their sets do, whichever task saw a copy."""
    rnd = random.Random(4)
    text = lambda n: " ".join("w" + str(rnd.randint(0, 10_000)) for _ in range(n))
    passage = text(50)
    rows = [(k, (passage + " " if k % 2 else "") + text(20), "", "") for k in range(400)]
    docs, p = docs_of(spark, rows + rows), jaccard.Join()
    frequent = jaccard._frequent(docs, jaccard.sets_of(docs, p), p)
    dealt = jaccard._deal(docs, 6, p, frequent, 64).selectExpr("part", "octet_length(high) AS n", "octet_length(low) AS low").toPandas()
    assert len(frequent[0]) == 46 and set(frequent[1]) <= {7, 8}
    assert dealt[dealt.part < 0].low.sum() >= 200 * 46 * 8 and dealt.n.sum() <= 2 * (200 * 16 + 200 * 20)
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.near_duplicates(docs_of(spark, rows), p).collect())
    assert got == brute_components(rows)


def test_jaccard_only_link_across_size_classes(spark):
    """In the large buckets of a passage, A leads one size class and B the next lower one. A's only unit of the
    lower class and B's only unit of the upper one are the only link between the two."""
    word = (f"v{k}" for k in range(100_000))
    some = lambda n: [next(word) for _ in range(n)]
    passage, stream, mark_a, mark_b = some(29), some(118), some(6), some(6)
    rows, tails = [], []
    for at, mark, extra, copies in [(0, mark_a, 3, 10), (6, mark_a, 1, 1), (12, mark_b, 3, 1), (18, mark_b, 1, 10)]:   # 134, 132, 134, 132 shingles
        for _ in range(copies):
            tails.append(mark[-4:] + some(extra))
            rows.append((len(rows), " ".join(passage + stream[at:at + 100] + mark + tails[-1][4:]), "", ""))
    # other texts make the stream's shingles more frequent than the passage's, and each tail no longer its text's own
    rows += [(100 + k, " ".join(stream + some(90) + tails[k % len(tails)]), "", "") for k in range(40)]
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.near_duplicates(docs_of(spark, rows)).collect())
    assert got == brute_components(rows) and str((21, 132, 0)) in got


def test_jaccard_writes_few_tables(spark):
    """Each table is a plan, threads and classes that stay in the driver's memory."""
    rnd = random.Random(6)
    text = lambda n: " ".join("w" + str(rnd.randint(0, 10_000)) for _ in range(n))
    rows = [(k, x, "", "") for k, x in enumerate(t + end for t in [text(40) for _ in range(10)] for end in ("", " a b"))]
    before = len(common._written)
    found = jaccard.near_duplicates(docs_of(spark, rows))
    assert len(common._written) - before <= 11   # 14 before
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found.collect()) == brute_components(rows)


def test_figures_of_a_written_table(spark):
    some, seen = common.materialize_with(spark.range(10), "figures", odd=F.count_if(F.expr("id % 2 = 1")), all=F.sum("id"))
    assert (seen, some.count()) == ({"odd": 5, "all": 45}, 10)
    none, seen = common.materialize_with(spark.range(10).where("id < 0"), "figures", odd=F.count_if(F.expr("id % 2 = 1")))
    assert not seen.get("odd") and none.count() == 0


def test_jaccard_keeps_one(spark, empty):
    rows = edge_rows() + [(9, "Same Text", "", ""), (8, "same\ttext", "", "")]
    df = docs_of(spark, rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str((r.doc_id, (r.text or "")[:9])) for r in kept.collect()) == sorted(map(str, [(1, ""), (2, ""), (3, "   "), (4, "one two t"), (5, "word word"), (8, "same\ttext")]))
    assert jaccard.one_of_each(empty).count() == 0 and jaccard.near_duplicates(empty).count() == 0


def labelled(n=240):
    rnd = random.Random(5)
    good = {"en": ["the", "house", "walks", "and", "river", "green"], "de": ["das", "haus", "läuft", "und", "fluss", "grün"]}
    rows, marks = [], []
    for k in range(n):
        lang = rnd.choice(["en", "de"])
        w = [rnd.choice(good[lang]) for _ in range(rnd.randint(5, 40))]
        toxic = int(rnd.random() < 0.3)
        if toxic:
            w.insert(rnd.randrange(len(w)), "vilest" if lang == "en" else "garst" + rnd.choice(["ig", "iger", "iges"]))
        rows.append((k, " ".join(w), lang, "s"))
        marks.append((k, toxic))
    return rows, marks


def test_toxicity(spark, empty):
    rows, marks = labelled()
    labels = spark.createDataFrame([*marks, (None, 1), (7000, None)], "doc_id long, toxic int")
    p = toxicity.Toxicity(buckets=1 << 12, epochs=12)
    model = toxicity.fit(docs_of(spark, rows), labels, p)
    got = {r.doc_id: r for r in toxicity.score_documents(docs_of(spark, rows), model, p).collect()}
    held = [k for k, _ in marks if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([got[k].predicted == dict(marks)[k] for k in held]) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    edge = toxicity.score_documents(docs_of(spark, edge_rows()), model, p).collect()
    assert len(edge) == len(edge_rows()) and not any(r.predicted for r in edge)
    assert toxicity.score_documents(empty, model, p).count() == 0
    assert toxicity.fit(empty, labels, p) is None and toxicity.score_documents(docs_of(spark, rows[:2]), None).collect()[0].score == 0.0
    # a text longer than a piece is pooled over all its pieces
    long = b"house " * 500 + b"vilest " + b"river " * 500
    assert abs(model.logits([long], piece_words=100)[0] - model.logits([long])[0]) < 1e-4


def test_toxicity_learns_from_every_row(spark, empty):
    """No sample: all learnable rows that aren't spare train in each epoch, and a word of few rows counts."""
    rare = [k for k in range(7000) if zlib.crc32(str(k).encode()) % 3 != 1][::300]
    rows = [(k, "house river " + ("garstig" if k in rare else "vilest" if k % 7 == 0 else "walks"), "en", "s") for k in range(7000)]
    labels = spark.createDataFrame([(k, int("vilest" in t or "garstig" in t)) for k, t, _, _ in rows], "doc_id long, toxic int")
    p = toxicity.Toxicity(buckets=1 << 10, epochs=2, block_rows=1000, chunk_rows=100)
    docs, seen = docs_of(spark, rows), []
    marked = labels.where(learnable(F.col("doc_id")))
    parts = toxicity.examples(docs, marked, marked.count(), p).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.doc_id for r in parts) == sorted(r.doc_id for r in marked.collect())
    few = toxicity._likely_marked(docs, marked.where("doc_id < 900"), 600, p).select("doc_id").collect()
    assert {r.doc_id for r in few} >= {r.doc_id for r in parts if r.doc_id < 900} and len(few) < 1500
    assert len({(r.block, r.task) for r in parts}) == 5 and 0.2 < np.mean([r.spare for r in parts]) < 0.3
    trained = toxicity._next
    try:
        toxicity._next = lambda model, copies: (seen.append(copies.where("part = -1").agg(F.sum("n"), F.count("*")).first()), trained(model, copies))
        model = toxicity.fit(docs, labels, p)
    finally:
        toxicity._next = trained
    assert seen == [(sum(not r.spare for r in parts), 5)] * 2
    assert min(model.scores([b"house river vilest", b"house river garstig"])) > 0.7 > max(model.scores([b"house river walks", b"", b"unseen"]))


def test_toxicity_cut_by_cells():
    rnd = np.random.default_rng(3)
    logit, toxic = rnd.normal(size=400), rnd.integers(0, 2, 400)
    logit[toxic == 1] += 2
    order = np.argsort(logit)
    s, t = logit[order], toxic[order]
    cut = toxicity.best_cut(s, s, t, 1 - t)
    right = lambda c: np.mean(logit[toxic == 0] < c) - np.mean(logit[toxic == 1] < c)
    assert abs(right(cut) - max(map(right, (s[1:] + s[:-1]) / 2))) < 1e-5
    assert toxicity.best_cut(s[:1], s[:1], t[:1], 1 - t[:1]) == s[0]


def test_language(spark, empty):
    rows, _ = labelled()
    model = langid.fit(docs_of(spark, rows))
    got = {r.doc_id: r for r in langid.identify(docs_of(spark, rows), model).collect()}
    assert all(got[k].lang_pred == lang and not got[k].rejected for k, _, lang, _ in rows)
    odd = docs_of(spark, [(1, None, "x", ""), (2, "12 !?", "x", ""), (3, "", "x", ""), (4, "ß", "x", ""), (5, "qqqq xxxx zzzz", "x", "")])
    out = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred != "und" and out[5].rejected
    assert langid.accepted(odd, model).columns == odd.columns and langid.identify(empty, model).count() == 0
    assert langid.identify(docs_of(spark, rows[:1]), langid.fit(empty)).collect()[0].lang_pred == "und"


def test_fits_on_text_ids_and_repeated_ids(spark):
    """Ids of any type; of several texts under one id the smallest is learned from, so reruns learn the same."""
    rows, marks = labelled()
    docs = docs_of(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    twice = docs.unionByName(docs.withColumn("text", F.concat(F.lit("zz "), "text"))).withColumn("text", F.when(F.col("doc_id") != "d3", F.col("text")))
    labels = spark.createDataFrame([(f"d{k}", t) for k, t in [*marks, *marks]], "doc_id string, toxic long")
    p = toxicity.Toxicity(buckets=1 << 10, epochs=2)
    a, b = (toxicity.fit(twice.repartition(n, "text"), labels, p) for n in (2, 5))
    assert a.scores([b"the vilest house"]) == b.scores([b"the vilest house"])
    a, b = (langid.fit(twice.repartition(n, "text")) for n in (2, 5))
    assert a.langs == b.langs and np.array_equal(a.centroids, b.centroids)
    assert set(langid.fit(docs, langid.LanguageId(max_fit=2)).langs) == {"de", "en"}


def test_sample_by_threshold_holds_the_smallest_hashes(spark):
    rows = [(k, "t", "a" if k % 10 else "b", "") for k in range(5000)] + [(None, "t", "a", ""), (7, "u", "a", ""), (7, "t", None, "")]
    df = docs_of(spark, rows)
    got = smallest_hashes(df, "lang", [("a", 4500), ("b", 500)], 40, 3)
    got = got.withColumn("h", id_hash(3)).select("lang", "doc_id", "h").distinct().collect()
    every = df.where("doc_id IS NOT NULL AND lang IS NOT NULL").withColumn("h", id_hash(3)).select("lang", "doc_id", "h").distinct().collect()
    for lang in "ab":
        few, all_ = (sorted((r.h, r.doc_id) for r in x if r.lang == lang) for x in (got, every))
        assert few[:40] == all_[:40] and 40 <= len(few) < 200


def test_language_fit_on_odd_rows(spark):
    rows, _ = labelled()
    rnd = random.Random(8)
    noise = docs_of(spark, [(k, " ".join("".join(rnd.choice("jkqxyz") for _ in range(rnd.randint(4, 8))) for _ in range(8)), "", "") for k in range(100)])
    learnt = [k for k in range(5000, 5100) if zlib.crc32(str(k).encode()) % 3 != 1]
    blank = [(k, ["", "  ", "12 34 - 5", "٣٤ €"][k % 4], lang, "s") for k, lang in zip(learnt[:16], ["en", "de"] * 8)]
    plain, model = langid.fit(docs_of(spark, rows)), langid.fit(docs_of(spark, rows + blank))
    assert plain.langs == model.langs and np.array_equal(plain.floor, model.floor) and (model.floor > 0).all()
    odd = langid.fit(docs_of(spark, rows + [(learnt[20], "qx zj", "en", "s"), (learnt[21], "kqy", "de", "s")]))
    for m in (plain, model, odd):
        assert langid.accepted(noise, m).count() == 0
        assert langid.accepted(docs_of(spark, rows), m).count() == len(rows)


def test_mixing(spark, empty):
    rnd = random.Random(2)
    rows = [(k, "w " * rnd.randint(0, 300), "", rnd.choice(["a", "a", "a", "b", "c", "D", None])) for k in range(300)] + [(k, None, "", "null only") for k in range(3)]
    rows += rows[:5]
    p = mixing.Mixing(block_words=16, shard_words=4000)
    got = mixing.mix_sources(docs_of(spark, rows), p).collect()
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full, want = {}, set(), 1.5 * sum(size.values())
    while True:
        left = want - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in size if x not in full) for s in size}
        above = {s for s in size if s not in full and target[s] > 2 * size[s]}
        if not above:
            break
        full |= above
    assert len(got) == len(rows)
    for s in size:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 32 * (1 + size[s] // 4000) + 16
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs_of(spark, rows[::-1]), p).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    mixed = mixing.mixed_documents(docs_of(spark, rows), p)
    assert mixed.columns == ["doc_id", "text", "lang", "source"]
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix_sources(empty, p).count() == 0 and mixing.mix_sources(docs_of(spark, edge_rows()), p).count() == 7


def sainte_lague(votes, caps, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max((i for i in range(len(votes)) if won[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * won[i] + 1), -i), default=None)
        if best is None:
            break
        won[best] += 1
    return won


@pytest.mark.parametrize("rounds", [0, 4])
def test_seats_are_those_of_the_loop(spark, monkeypatch, rounds):
    monkeypatch.setattr(mixing, "ROUNDS", rounds)   # without rounds all quotients are listed: the same seats
    rnd = random.Random(17)
    groups = [([50.0] + [0.05] * 300, [1000] * 301, 100),            # one large party, a long tail that rounds to nothing
              ([1.0] * 40, [3] * 40, 65),                            # ties everywhere
              ([5.0, 1.0, 0.0], [2, 2, 9], 4),                       # all that caps allow, no votes no seats
              ([3.0, 2.0], [9, 9], 0), ([7.0], [4], 9),              # no seats, more seats than caps
              ([0.0, 0.0], [5, 5], 3)]
    groups += [([rnd.paretovariate(0.5) for _ in range(60)], [rnd.randint(0, 40) for _ in range(60)], 200) for _ in range(4)]
    rows = [(g, i, v, c, n) for g, (votes, caps, n) in enumerate(groups) for i, (v, c) in enumerate(zip(votes, caps))]
    df = spark.createDataFrame(rows, "g int, i int, votes double, cap long, seats long")
    got = {(r.g, r.i): r.won for r in mixing.apportion(df, ["g"], "votes", "seats", "cap", "i", "won").collect()}
    assert got == {(g, i): x for g, (votes, caps, n) in enumerate(groups) for i, x in enumerate(sainte_lague(votes, caps, n))}


def test_plans_of_seats_hold_their_probes_once(spark, monkeypatch):
    plans, write = {}, mixing.materialize

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(mixing, "materialize", noted)
    df = spark.createDataFrame([(0, i, float(i), 9, 40) for i in range(30)], "g int, i int, votes double, cap long, seats long")
    assert mixing.apportion(df, ["g"], "votes", "seats", "cap", "i", "won").agg(F.sum("won")).first()[0] == 40
    assert 0 < plans["mix-bounds"].lower().count("pow") <= 4 * mixing.ROUNDS   # spelled out in the sums they were two for each probe


def test_mixing_of_tiny_sources(spark):
    rows = [(1, "w " * 20_000, "", "a"), (2, "x " * 15, "", "b"), (3, "y", "", "c"), (4, "", "", "d"), (5, "z " * 7, "", "e")]
    got = mixing.mix_sources(docs_of(spark, rows).withColumn("taken", F.lit("clash"))).collect()
    assert len(got) == 5 and all(abs(r.taken - r.target) <= 64 for r in got) and all(abs(r.taken - r.target) <= 1 for r in got if r.source != "a")
    assert {r.source: r.taken for r in got}["b"] > 0


def test_sharding(spark, empty):
    rnd = random.Random(4)
    rows = [(k, "x" * rnd.randint(0, 500), "", "s") for k in range(900)] + [(5000 + k, "hot copy", "", "s") for k in range(600)] + edge_rows()[:6] + [(None, None, None, None)]
    df = docs_of(spark, rows).withColumn("slot", F.lit("clash"))
    got = sharding.shard_records(df, sharding.Sharding(n_shards=7)).collect()
    assert len(got) == len(rows)
    sizes = [sum(r["size"] for r in got if r.shard == k) for k in range(7)]
    assert max(sizes) - min(sizes) <= 2 * 516 + 0.04 * sum(sizes) / 7
    for k in range(7):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert all(r["size"] == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    again = sharding.shard_records(df.repartition(5), sharding.Sharding(n_shards=7)).collect()
    assert sorted(str((r.doc_id, r.shard, r.slot)) for r in got) == sorted(str((r.doc_id, r.shard, r.slot)) for r in again)
    assert sharding.shard_records(empty).count() == 0


def test_sharding_and_samples_hold_one_python_worker_a_task(spark):
    """Peak memory of the pipeline: no second copy of the range's call, no RDD of Python rows."""
    df = docs_of(spark, [(k, f"text {k}", "en", "s") for k in range(300)])
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    table = spark.read.schema(DOCS).parquet(write_docs(spark, df))
    assert plan(sharding.shard_records(table)).count("ArrowEvalPython") == 1
    for d in (sharding.shard_records(table), smallest_hashes(table, "lang", [("en", 300), (None, 2)], 5, 1)):
        assert "LogicalRDD" not in plan(d)
    assert [tuple(r) for r in small_table(spark, [("a", 1, True), (None, 2, None)], "x string, y int, z boolean").collect()] == [("a", 1, True), (None, 2, None)]
    assert small_table(spark, [], "x string, y int").dtypes == [("x", "string"), ("y", "int")] and small_table(spark, [], "x long").count() == 0


def write_docs(spark, df):
    path = scratch_path(spark, "docs")
    df.write.parquet(path)
    return path


def test_sharding_keeps_copies_together(spark):
    # groups of four copies a little larger than a range: few draws make many ranges overfull
    rows = [(4 * g + c, f"{g:05d}" + "x" * 95, "", "s") for g in range(2100) for c in range(4)]
    got = sharding.shard_records(docs_of(spark, rows), sharding.Sharding(ranges_per_shard=60, draws_per_range=2)).collect()
    at, sizes = {}, {}
    for r in got:
        at.setdefault(r.text, set()).add(r.shard)
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert len(got) == len(rows) and all(len(shards) == 1 for shards in at.values())
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * 4 * 116


def test_search(spark, empty):
    rnd = random.Random(6)
    vocab = ["w" + "abcdefghij"[k % 10] + "abcdefghij"[k // 10 % 10] + "abcdefghij"[k // 100] for k in range(300)]
    text = lambda: " ".join(vocab[min(299, int(rnd.paretovariate(0.7)))] for _ in range(rnd.randint(1, 60)))
    rows = [(k, text(), "", "") for k in range(400)] + [(k + 400, rnd.choice(["", None, "777"]), "", "") for k in range(4)]
    rows += [(1000 + k, rows[k][1], "", "") for k in range(20)]
    docs = docs_of(spark, rows)
    words = {i: re.findall("[a-z]+", t or "") for i, t, *_ in rows}
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    n, mean = len(rows), sum(map(len, words.values())) / len(rows)
    p = search.Bm25(k=5, shard_words=1500, block=4, batch=3, first=2)
    got = {}
    for r in search.top_k(docs, docs.where("doc_id % 50 = 0").selectExpr("doc_id AS query_id", "text"), p).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for q in (i for i, *_ in rows if i % 50 == 0 and words[i]):
        s = {d: sum(np.log1p((n - df[t] + .5) / (df[t] + .5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (.25 + .75 * len(w) / mean)) for t in set(words[q]) if t in w) for d, w in words.items()}
        best = sorted(((-round(v, 6), d) for d, v in s.items() if v > 0))[:5]
        assert [d for _, d, _ in sorted(got[q])] == [d for _, d in best]
        assert np.allclose([x for *_, x in sorted(got[q])], [-v for v, _ in best], atol=1e-5)
    assert search.top_k(empty, docs.selectExpr("doc_id AS query_id", "text"), p).count() == 0


def shard_of(texts, p):
    """A shard of (id, {term: count}) texts, and the plain scores of a query in it."""
    posts = sorted((t, d, c) for d, (_, x) in enumerate(texts) for t, c in x.items())
    terms, counts = np.unique([t for t, *_ in posts], return_counts=True)
    lens = np.array([sum(x.values()) for _, x in texts], np.int64)
    row = {"terms": terms, "counts": counts, "docs": np.array([d for _, d, _ in posts], np.uint32).tobytes(), "tfs": np.array([c for *_, c in posts], np.uint32).tobytes(),
           "lens": lens.tobytes(), "ids": np.array([i for i, _ in texts], np.int64).tobytes()}
    return search._Shard(row, float(lens.mean()), p), lens


def test_search_walk_skips_and_is_exact():
    rng = np.random.default_rng(4)
    topic = lambda k: {int(t): int(c) for t, c in zip(100 * (k % 20) + rng.integers(0, 60, 12), rng.integers(1, 5, 12))} | {int(t): 1 for t in rng.integers(5000, 5040, 6)}
    texts = sorted([(i, topic(i)) for i in range(900)], key=lambda x: min(x[1]))
    texts += [(2000 + i, dict(texts[5][1])) for i in range(40)]            # a group of copies: ties by id
    p = search.Bm25(k=7, block=8, batch=16, frequent=1 / 100)
    shard, lens = shard_of(texts, p)
    queries = [texts[i][1] for i in range(0, 900, 15)]
    owner = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
    terms, idf = np.concatenate([sorted(q) for q in queries]).astype(np.int64), rng.random(len(owner)) * 5 + 0.01
    want = {}
    for n in range(len(queries)):
        w = dict(zip(terms[owner == n].tolist(), idf[owner == n]))
        s = [(-round(sum(w[t] * c * 2.2 / (c + 1.2 * (.25 + .75 * lens[d] / lens.mean())) for t, c in sorted(x.items()) if t in w), 6), i) for d, (i, x) in enumerate(texts)]
        want[n] = sorted(x for x in s if x[0] < 0)[:7]
    for floor in (0.0, 0.7):                                               # a floor below the k-th best changes nothing
        floors = np.array([-floor * want[n][-1][0] for n in range(len(queries))])
        q, ids, score = shard.search(len(queries), owner, terms, idf, floors)
        for n in want:
            assert ids[q == n].tolist() == [i for _, i in want[n]]
            assert np.allclose(score[q == n], [-x for x, _ in want[n]], atol=2e-6)
    assert shard.scored < 0.5 * shard.bounds


def test_search_scores_adjacent_blocks_in_one_product(monkeypatch):
    """Blocks that the same queries reach are scored together; a block scored ahead isn't found twice."""
    rng = np.random.default_rng(6)
    texts = [(i, {int(t): int(c) for t, c in zip(rng.integers(0, 200, 30), rng.integers(1, 5, 30))}) for i in range(640)]
    shard, lens = shard_of(texts, search.Bm25(k=6, block=8, batch=64))
    products, tile = [], search._Shard._tile
    monkeypatch.setattr(search._Shard, "_tile", lambda self, *blocks: products.append(blocks) or tile(self, *blocks))
    queries = [texts[i][1] for i in range(0, 640, 10)]
    owner = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
    terms, idf = np.concatenate([sorted(q) for q in queries]).astype(np.int64), rng.random(len(owner)) * 5 + 0.01
    want = []
    for n in range(len(queries)):
        w = dict(zip(terms[owner == n].tolist(), idf[owner == n]))
        s = [(-round(sum(w[t] * c * 2.2 / (c + 1.2 * (.25 + .75 * lens[d] / lens.mean())) for t, c in sorted(x.items()) if t in w), 6), i) for d, (i, x) in enumerate(texts)]
        want.append(sorted(x for x in s if x[0] < 0)[:6])
    for share in (0.0, 0.9):
        q, ids, score = shard.search(len(queries), owner, terms, idf, np.array([-share * w[-1][0] for w in want]))
        assert all(ids[q == n].tolist() == [i for _, i in w] and np.allclose(score[q == n], [-x for x, _ in w], atol=2e-6) for n, w in enumerate(want))
    assert len(products) < 150, len(products)        # 80 blocks, two searches; the first also scores each query's best block


def test_search_long_query_is_bounded():
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [(i, dict.fromkeys(rng.integers(0, 40_000, 60).tolist(), 1)) for i in range(8000)]
    shard, _ = shard_of(texts, search.Bm25())
    terms = np.arange(30_000)
    tracemalloc.start()
    q, ids, _ = shard.search(2, np.repeat([0, 1], 30_000), np.concatenate([terms, terms]), np.ones(60_000), np.zeros(2))
    assert tracemalloc.get_traced_memory()[1] < 500 << 20 and (q == 0).sum() == (q == 1).sum() == 10
    tracemalloc.stop()


def test_search_odd_queries(spark, empty):
    rows = [(1, "alpha beta", "", ""), (2, "alpha", "", ""), (3, None, "", ""), (None, "alpha", "", ""), (2, "alpha", "", "")]
    ask = spark.createDataFrame([(7, "alpha"), (7, "beta"), (8, None), (9, ""), (None, "alpha"), (10, "gamma")], "query_id long, text string")
    got = search.top_k(docs_of(spark, rows).withColumn("score", F.lit("clash")), ask).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.doc_id) for r in got] == [(7, 1, 1), (7, 2, 2), (7, 3, 2)] and got[1].score == got[2].score
    assert search.top_k(docs_of(spark, rows), ask.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rnd = random.Random(7)
    rows = [(k, f"http://x/{k}", rnd.choice(["same", "", None, "é" * 200, "".join(rnd.choice("01") for _ in range(rnd.randint(0, 3000)))])) for k in range(80)]
    rows += [(None, None, "same"), (3, "a\r\nb", "twice"), (3, "a", "twice"), (90, "big", rnd.randbytes(9 << 20).hex())]   # 18 MiB payload
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = scratch_path(spark, "test-warc")
    p = warc.Warc(range_bytes=700)
    warc.write(pages.where("page_id is null or page_id < 90"), path, p)
    warc.write(pages.where("page_id = 90"), path + "-big")
    got = warc.read(spark, path, p).union(warc.read(spark, path + "-big")).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted(str((i, len((h or "").encode()), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""])) for i, _, h in rows)
    assert sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in got) == want
    assert all(bytes(r.payload).decode() == {i: h or "" for i, _, h in rows}[r.page_id] for r in got if r.record_type == "response")
    warc.write(pages.limit(0), path + "-none")
    assert warc.read(spark, path + "-none").count() == 0


def test_warc_damage_is_never_passed_over(spark, tmp_path):
    rnd = random.Random(3)
    pages = spark.createDataFrame([(k, f"http://x/{k}", "".join(rnd.choices("abcdefgh 123", k=rnd.randint(0, 900)))) for k in range(30)],
                                  "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "whole")
    warc.write(pages, path)
    name = next(x for x in __import__("os").listdir(path) if x.startswith("part-"))
    data = open(f"{path}/{name}", "rb").read()
    starts = [at for at, _ in warc.records(warc._File(f"{path}/{name}"), 0, len(data))]
    assert len(starts) == 30
    hurt = {"magic": (starts[7], b"\0\0\0"), "header": (starts[12] + 12, b"\xff\xff\xff\xff"), "body": (starts[20] + 260, b"\xff\0\xff\0"), "first": (0, b"no!"), "cut": (len(data) - 9, None)}
    for kind, (at, new) in hurt.items():
        bad = data[:at] if new is None else data[:at] + new + data[at + len(new):]
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "part-0.gz").write_bytes(bad)
        for size in (300, 1 << 20):
            p = warc.Warc(range_bytes=size)
            assert warc.damages(spark, path, p).count() == 0
            found = warc.damages(spark, str(tmp_path / kind), p).collect()
            assert found and all(r.path.endswith("part-0.gz") for r in found), (kind, size)
            with pytest.raises(Exception, match="damaged record at offset"):
                warc.read(spark, str(tmp_path / kind), p).collect()
            assert warc.read(spark, str(tmp_path / kind), p, intact_only=True).count() == 29, (kind, size)


def test_language_stage_keeps_documents_when_nothing_is_labelled(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * 3, None, "s") for i in range(30)], DOCS)
    assert langid.accepted(docs, langid.fit(docs)).count() == 30


def brute_contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    w = words(text)
    for item in items:
        b = words(item)
        n = min(10, len(b))
        windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        if any(tuple(w[i:i + n]) in windows for i in range(len(w) - n + 1)):
            return True
    return False


def pipeline_tables(spark, path, rows, items):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline(spark, tmp_path):
    """Stage by stage against plain Python on planted rows: unknown languages, copies, benchmark passages, odd rows."""
    rows, _ = labelled(160)
    rnd = random.Random(2)
    rows = [(k, t + " " + " ".join(f"{t.split()[0]}{rnd.randint(0, 999)}" for _ in range(30)), lang, rnd.choice(["s", "u", None])) for k, t, lang, _ in rows]
    item = "the river walks and the green house walks and the river " + "green " * 3
    rows += [(300 + k, rows[k][1] + (" the" if k % 2 else ""), rows[k][2], "s") for k in range(20)]                     # copies and near copies
    rows += [(400 + k, rows[k + 50][1] + " " + item + rows[k + 51][1], rows[k + 50][2], "s") for k in range(5)]         # benchmark passages
    rows += [(500, None, "en", "s"), (501, "", None, None), (502, "zq xk " * 40, None, "s"), (503, "12 34", "de", "u"), (None, "das haus läuft und das haus", "de", "s")]
    sf_dir = pipeline_tables(spark, tmp_path / "a", rows, [(1, item), (2, None), (3, "")])
    docs, kept, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), [], []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source"], name
        kept.append({(r.doc_id, r.text) for r in docs.collect()})
        seen.append(docs.count())
    known = {(i, t) for i, t, *_ in rows if t and i not in (502, 503)}
    assert kept[0] == known and seen[0] == len(known)
    label = {(i, t): c for (i, t), c in zip(sorted(known, key=lambda x: str(x)), brute_labels(sorted(known, key=lambda x: str(x))))}
    assert kept[1] == {(i, t) for (i, t), c in label.items() if i == c} and seen[1] == len(kept[1]) < seen[0] - 15
    assert kept[2] == {(i, t) for i, t in kept[1] if not brute_contaminated(t, [item])} and seen[2] == len(kept[2]) < seen[1]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} <= {i for i, _ in kept[2]}
    for shard in range(40):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    words = lambda t: len(t.split())
    total = sum(words(t) for _, t in kept[2])
    assert total < sum(words(r.text) for r in out) <= 2 * total


def brute_labels(rows):
    """The smallest id of each row's component, row by row."""
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (ascii_lower(t).split() for _, t in rows)]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [y if v == x else v for v in label]
    ids = lambda a: [rows[b][0] for b in range(len(rows)) if label[b] == label[a] and rows[b][0] is not None]
    return [min(ids(a), default=None) for a in range(len(rows))]


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, pipeline_tables(spark, tmp_path, [], [])).count() == 0
