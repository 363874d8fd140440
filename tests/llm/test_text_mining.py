"""Phrases, substring dedup and token alignment against plain Python on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import align, phrases, substring

DOCS = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "s") for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- phrases --------------------------------------------------------------------------
def brute_phrases(rows, p):
    f, n, out = defaultdict(Counter), Counter(), []
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    for lang, c in f.items():
        some = {g: a for g, a in c.items() if len(g) > 1 and a >= p.least}
        found = []
        for g, a in some.items():
            score, _, l, r = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            inside = [h for h, b in some.items() if len(h) > len(g) and 100 * b >= p.inside * a
                      and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if not inside:
                found.append((-score, -a, " ".join(g).encode(), l, r))
        for i, (s, a, g, l, r) in enumerate(sorted(found)[:p.top]):
            out.append((lang, i + 1, g.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def phrase_rows(seed):
    rnd = random.Random(seed)
    words = ["the", "of", "The", "a", "x1", "über", "naïve", "q"] + [f"w{i}" for i in range(25)]
    rows = []
    for d in range(200):
        t = " ".join(rnd.choices(words, [9, 8, 5, 4, 3, 2, 2, 2] + [1] * 25, k=rnd.randint(0, 200)))
        t = re.sub(r" (w\d) ", lambda m: rnd.choice([" w1. ", ", ", "\n ", " w2  ", "\tw3\r"]), t)
        rows.append((d, t, rnd.choice(["en", "de", None, "und"])))
    return rows + [(None, None, "en"), (500, "", "en"), (501, "a a a a " * 500, "fr"), (502, "New York City " * 100, "en"), (502, "New York City " * 100, "en")]


@pytest.mark.parametrize("p", [phrases.Phrases(), phrases.Phrases(block_bytes=5000, range_bytes=8000, split=200, least=8, top=50)])
def test_phrases(spark, p):
    rows = phrase_rows(p.least)
    df = docs_of(spark, rows).withColumn("a", F.lit("x")).withColumn("n", F.lit(None)).withColumn("f", F.lit(1))
    assert sorted(tuple(r[c] for c in phrases.OUT) for r in phrases.mine(df, p).collect()) == brute_phrases(rows, p)


def test_phrases_of_nothing(spark, empty):
    assert phrases.mine(empty).count() == 0
    assert phrases.mine(docs_of(spark, [(1, None, None), (2, "one two", "en")])).count() == 0


def test_quicksort_counts_any_matrix():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        words = rnd.integers(1, 5, (rnd.integers(1, 400), 4))
        for k in (2, 3):
            words[rnd.random(len(words)) < 0.2, k:] = 0
        times = rnd.integers(1, 4, len(words))
        got = {}
        for at, length, count in phrases.quicksort_counts(words, times, np.zeros(len(words), int), 6):
            got |= {tuple(words[i, :m]): int(c) for i, m, c in zip(at, length, count)}
        want = Counter()
        for row, t in zip(words, times):
            for m in (2, 3, 4):
                if row[m - 1]:
                    want[tuple(row[:m])] += int(t)
        assert got == {g: c for g, c in want.items() if c >= 6}


# --- substring dedup --------------------------------------------------------------------
def brute_substrings(rows, k=50):
    first, out = {}, []
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows]
    for d, w in words:
        for i in range(len(w) - k + 1 if d is not None else 0):
            g = tuple(w[i:i + k])
            first[g] = min(first.get(g, d), d)
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1 if d is not None else 0):
            if first[tuple(w[i:i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def passage_rows():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    passages, rows = [text(n) for n in (49, 50, 51, 60, 75, 130, 400)], []
    for _ in range(150):
        w = text(rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 4)):
            q = rnd.choice(passages)
            a = rnd.randint(0, min(20, len(q) - 1))
            w += q[a:len(q) - rnd.randint(0, min(20, len(q) - a - 1))] + text(rnd.choice([0, 0, 1, 30]))
        rows.append((rnd.randint(-20, 130), " ".join(w), "en"))
    long = " ".join(text(30_000))
    more = [(None, rows[0][1]), (900, None), (901, ""), (902, "a " * 400), (903, "a " * 300), (903, "a " * 300), (903, " ".join(passages[-1])),
            (904, "a b " * 200), (905, "b\t\na  " * 200), (906, long), (907, long[5000:90_000] + " é")]
    return rows + [(*r, "en") for r in more]


@pytest.mark.parametrize("p", [substring.SubstringDedup(), substring.SubstringDedup(block_bytes=3000, range_bytes=5000)])
def test_substrings(spark, p):
    rows = passage_rows()
    df = docs_of(spark, rows).withColumn("n_words", F.lit("x")).withColumn("block", F.lit(None))
    want = brute_substrings(rows)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.parsed(df, p).collect()]
    assert sorted(got, key=str) == [w[:4] for w in want]
    whole = substring.deduplicated(df, p).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text or "") for r in whole), key=str) == want
    assert all((r.text is None) == (r.kept_text is None) and r.source == "s" for r in whole)
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(" ".join((t or "").split()))
    for r in whole:      # each factor stands in its source
        words = (r.text or "").split()
        for f in r.factors:
            assert f.n_words >= 50 and f.source < r.doc_id
            assert any(" ".join(words[f.start:f.start + 50]) in t for t in texts[f.source])


def test_substrings_of_nothing(spark, empty):
    assert substring.parsed(empty).count() == 0 and substring.deduplicated(empty).count() == 0


# --- token alignment ----------------------------------------------------------------------
def brute_alignment(rows, v):
    per, total = [], Counter()
    for d, t, _ in rows:
        a = v.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = v.b.encode(t) if t else []
        whole = (" " + t).encode() if t else b""
        if b"".join(v.bytes_a[i] for i in a) != whole or b"".join(v.bytes_b[i] for i in b) != whole:
            a, b = [], []
        spans = []
        for ids, names in ((a, v.bytes_a), (b, v.bytes_b)):
            ends = np.cumsum([len(names[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends], ends, ids)))
        links = [(x, y) for s, e, x in spans[0] for o, u, y in spans[1] if s < u and o < e] if len(a) < 3000 else None
        if links is None:                                        # long texts: a merge instead of all pairs
            links, i, j = [], 0, 0
            while i < len(a) and j < len(b):
                links.append((a[i], b[j]))
                e, u = spans[0][i][1], spans[1][j][1]
                i, j = i + (e <= u), j + (u <= e)
        common = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        groups, lo = [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for s, u, i in side if lo <= s and u <= e) for side in spans) if len(a) < 3000 else "")
            lo = e
        total.update(links)
        per.append((d, a, b, len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, y), n in total.items():
        most[y] = max(most.get(y, 0), n)
    return [(d, len(a), len(b), g, len(k), sum(total[x] == most[x[1]] for x in k), sum(total[x] for x in k), s if len(a) < 3000 else None)
            for d, a, b, g, k, s in per]


@pytest.mark.parametrize("p", [align.Alignment(), align.Alignment(block_bytes=30_000, step_bytes=7000, range_bytes=40_000, lane=7)])
def test_alignment(spark, p):
    v = align.Vocabularies(p)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    odd = [None, "", "a▁b", "<|endoftext|> <s> <0x41>", "\x00 é́ 😀😀 日本語テキスト  \n\t x", " " * 2000, "x" * 2000, "again and again " * 3000]
    rows += [(900 + i // 2, t, None) for i, t in enumerate(odd)] + [(None, "hello", "en"), (1, "hello", "en")]
    df = docs_of(spark, rows).withColumn("n_a", F.lit("x")).withColumn("block", F.lit(None))
    got = [(r.doc_id, *[r[c] for c in align.OUT]) for r in align.aligned(df, p).collect()]
    want = brute_alignment(rows, v)
    key = lambda r: str(r[:7])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7])


def test_alignment_of_nothing(spark, empty):
    assert align.aligned(empty).count() == 0


def test_gallop_equals_search():
    rnd = np.random.default_rng(2)
    for lane in (1, 3, 256):
        for _ in range(10):
            long = np.unique(rnd.integers(0, 5000, rnd.integers(1, 900)))
            short = np.unique(np.r_[rnd.choice(long, rnd.integers(0, 20)), rnd.integers(0, long[-1] + 1, rnd.integers(0, 300))])
            assert (align.gallop(short, long, lane) == np.searchsorted(long, short)).all()


def test_both_engines_of_the_byte_level_vocabulary_agree():
    v = align.Vocabularies(align.Alignment())
    assert v.fast is not None
    rnd = random.Random(4)
    alphabet = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xC0, 0x180)]]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rnd.choices(" abcs'tllre\n1é", k=rnd.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        assert not t.encode().translate(None, align.PLAIN)
        assert v.fast.encode_ordinary(" " + t) == v.a.encode(" " + t, add_special_tokens=False).ids
