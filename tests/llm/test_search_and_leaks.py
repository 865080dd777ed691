"""Lexical search, fill-in-the-middle and decontamination against plain models."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from lodestone.llm import decontaminate, fim, lexical
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def letters(r, n, some="ab\n\n \té日😀<S>P"):
    return "".join(r.choice(some) for _ in range(n))


# ---------------------------------------------------------------- cuts
UNIT = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "chars": r"(?s)."}


@pytest.mark.parametrize("unit", fim.UNITS)
def test_places_are_ends_of_units(unit):
    r = random.Random(5)
    texts = [letters(r, r.randint(0, 40)) for _ in range(200)] + ["", "\n", "x", "\n\n\n", "a\n" * 50]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    runs = fim.runs(np.frombuffer(b"".join(raw), np.uint8), off, unit)
    for i, t in enumerate(texts):
        units = re.findall(UNIT[unit], t)
        assert runs.units[i] == len(units) and "".join(units) == t
        ks = np.arange(len(units) + 1)
        want = off[i] + np.cumsum([0, *(len(u.encode()) for u in units)])
        assert runs.place(np.full(len(ks), i), ks).tolist() == want.tolist()


@pytest.mark.parametrize(("unit", "rates"), [("lines", (100, 50)), ("words", (70, 0)), ("chars", (30, 100))])
def test_transform_reads_back(spark, unit, rates):
    r = random.Random(6)
    rows = [(i, letters(r, r.randint(0, 60))) for i in range(300)] + [(None, "a\nb\nc"), (7, None), (8, ""), (9, "long\n" * 50_000), (9, "long\n" * 50_000), (10, "has <M> in it\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("fim_text", F.lit("own"))
    out = fim.transform(df, unit, fim_percent=rates[0], spm_percent=rates[1])
    out = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows)
    forms = Counter(x.form for x in out)
    for x in out:
        assert x.back == (x.text or "") and x.n_units == len(re.findall(UNIT[unit], x.text or "")) and x.fim_text == "own"
        assert (x.form == "plain") == (x.prefix_chars is None)
        if x.form == "plain":
            assert x.output == (x.text or "")
        else:
            pre, mid = x.text[: x.prefix_chars], x.text[x.prefix_chars : x.prefix_chars + x.middle_chars]
            suf = x.text[len(pre) + len(mid) :]
            assert x.output == (f"<P>{pre}<S>{suf}<M>{mid}" if x.form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}")
            for k in (len(pre), len(pre) + len(mid)):  # both cuts lie between units
                assert "".join(re.findall(UNIT[unit], x.text[:k])) == x.text[:k] and (k == 0 or re.findall(UNIT[unit], x.text)[: len(re.findall(UNIT[unit], x.text[:k]))] == re.findall(UNIT[unit], x.text[:k]))
    assert (forms["spm"] == 0) == (rates[1] == 0) and (forms["psm"] == 0) == (rates[1] == 100)
    assert sorted(map(repr, out)) == sorted(map(repr, fim.transform(df.repartition(7), unit, fim_percent=rates[0], spm_percent=rates[1]).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()))


def test_sentinels_must_not_overlap(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("aa", "<S>", "<M>"), ("<P>", "P><", "<M>"), ("", "<S>", "<M>"), ("<S", "<S>", "<M>")):
        with pytest.raises(ValueError, match="overlap"):
            fim.transform(df, sentinels=bad)
    with pytest.raises(ValueError, match="unit"):
        fim.transform(df, "pages")


# ---------------------------------------------------------------- leaks
def plain_leaks(docs, items, window):
    out = []
    grams = [(i, terms(t)) for i, t in items if t is not None]
    for d, t in docs:
        w, hit, met = terms(t), set(), set()
        for i, g in grams:
            k = min(window, len(g))
            for q in range(len(g) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == g[q : q + k]:
                        hit.update(range(p, p + k))
                        met.add(i)
        out.append((d, len(w), len(hit), tuple(sorted(str(i) for i in met if i is not None))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaks():
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(60)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, text(r.choice([1, 2, 3, 7, 10, 11, 30, 60]))) for i in range(30)]
    items += [(30, items[5][1]), (31, ["v1"] * 25), (32, ["V2", "v2"] * 9)]
    docs = []
    for d in range(120):
        w = text(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            g = r.choice(items)[1]
            lo = r.randint(0, len(g) - 1)
            at = r.randint(0, len(w))
            w[at:at] = g[lo : lo + r.randint(1, 25)]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(w)))
    docs += [(200, None), (None, ""), (201, "v1 " * 3000), (5, docs[5][1]), (202, "--- !!")]
    items = [(i, "-".join(w)) for i, w in items] + [(40, None), (41, "!"), (None, docs[3][1] + " v9 v8 v7"), (30, "other v3 v4")]
    return docs, items


@pytest.mark.parametrize(("window", "block"), [(10, 1 << 20), (10, 400), (4, 1 << 20), (1, 300)])
def test_leaks_equal_the_plain_search(spark, leaks, window, block):
    docs, items = leaks
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash")).withColumn("more", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.annotate(d, b, window, block_bytes=block).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got], key=repr) == plain_leaks(docs, items, window)
    for r in got:
        assert r.n_hit == sum(s.hi - s.lo for s in r.spans) and all(a.hi < c.lo for a, c in zip(r.spans, r.spans[1:]))
    kept = decontaminate.decontaminate(d, b, window, block_bytes=block)
    assert kept.dtypes == d.dtypes and kept.count() == sum(r.n_hit == 0 for r in got)


def test_longest_matches(spark, leaks):
    docs, items = leaks
    docs = [(d, t) for d, t in docs if d is not None]
    rows = decontaminate.annotate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.item_id: r for r in decontaminate.longest_matches(rows).collect()}
    words = {}
    for d, t in docs:
        words.setdefault(d, terms(t))
    seen = 0
    for i in {str(i) for i, t in items if i is not None and t}:
        best = 0
        for g in (terms(t) for j, t in items if str(j) == i and t):
            k = min(10, len(g))
            for q in range(len(g) if k else 0):
                for w in words.values():
                    for p in range(len(w)):
                        n = 0
                        while q + n < len(g) and p + n < len(w) and g[q + n] == w[p + n]:
                            n += 1
                        best = max(best, n if n >= k else 0)
        assert (got[i].n_words if i in got else 0) == best, i
        if best:
            r = got[i]
            g = next(terms(t) for j, t in items if str(j) == i and t and terms(t)[r.item_start : r.item_start + best] == words[r.document][r.doc_start : r.doc_start + best])
            assert len(g) >= r.item_start + best
            seen += 1
    assert seen > 5


def test_one_long_item_and_document(spark):
    r = random.Random(3)
    w = [f"x{r.randrange(5000)}" for _ in range(40_000)]
    docs = [(1, " ".join(w)), (2, " ".join(w[100:30_000])), (3, "x1 x2")]
    out = {r.doc_id: r for r in decontaminate.annotate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")).collect()}
    assert (out[1].n_hit, out[2].n_hit, out[3].n_hit) == (40_000, 29_900, 0)


# ---------------------------------------------------------------- search
def plain_search(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    full = [b for _, b in bags if b]
    n, total = len(full), sum(sum(b.values()) for b in full)
    df = Counter(t for b in full for t in b)
    out = []
    for i, t in items:
        scores = []
        for at, (d, b) in enumerate(bags):
            s, m = 0, (25 + (75 * sum(b.values()) * n) // total) if total else 0
            for x, c in Counter(terms(t)).items():
                if b[x]:
                    s += c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * b[x]) // (1000 * b[x] + 8 * m))
            if s:
                scores.append((-s, d is None, d or 0, at, d))
        out += [(i, rank, x[4], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("few", "k"), [(True, 10), (False, 3)])
def test_search_equals_all_scores(spark, monkeypatch, few, k):
    if not few:  # joins instead of broadcasts, many blocks of items
        monkeypatch.setattr(lexical, "FEW_TERMS", 0)
        monkeypatch.setattr(lexical, "FEW_LISTS", 0)
    r = random.Random(k)
    word = lambda: f"t{int(r.paretovariate(0.6)) % 300}"
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(3, "T1 t2"), (None, "t5 t6 t7"), (None, docs[9][1]), (2000, None), (2001, "?"), (2002, "t1 " * 20_000)]
    r.shuffle(docs)
    items = [(i, " ".join(word() for _ in range(r.randint(0, 25)))) for i in range(40)] + [(50, docs[7][1]), (50, "t1"), (None, "t2 t2 t3"), (51, None), (52, "absent"), (53, "t1 t1 absent")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash")).repartition(6)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    out = lexical.search(d, b, k, item_block=256 if few else 7)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain_search(docs, items, k)


def test_small_parts(spark, monkeypatch):
    """Parts of a few documents: every bound is put to work."""
    part = lexical._Part()
    part.add([5, None, 2], *lexical.terms(np.frombuffer(b"b a aab c", np.uint8), np.array([0, 5, 6, 9])), None)
    rows = [x for b in part.rows(9) for x in b.to_pylist()]
    assert rows[-1]["ids"] == [2, 5, None] and rows[-1]["sizes"] == [2, 3, 0] or rows[-1]["sizes"]
    docs = [(i, f"u{i % 7} u{i % 11} u{i % 13} rare{i // 30}") for i in range(400)]
    items = [(1, "u1 u2 rare3"), (2, "u6 u10 u12 rare0 rare1")]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = lexical.search(make(docs, "doc_id long, text string").repartition(40), make(items, "item_id long, text string"), 4)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, 4)


def test_a_forest_is_trained_on_the_same_findings_however_they_lie(spark):
    from lodestone.llm import secrets

    r = random.Random(4)
    rows = [("key = ", "".join(r.choice("abcdef0123456789") for _ in range(24)), "", 1) for _ in range(60)] + [("the ", r.choice(["river", "mountain", "window"]) + str(i), " is", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "before string, value string, after string, label int")
    texts = spark.createDataFrame([(i, f"{b}{v}{a}") for i, (b, v, a, _) in enumerate(rows)], "doc_id long, text string")
    found = [sorted(map(str, secrets.annotate(texts, secrets.train(df.repartition(n), max_train=50), keep=["doc_id"]).collect())) for n in (1, 7)]
    assert found[0] == found[1]
