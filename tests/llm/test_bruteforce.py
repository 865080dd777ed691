"""Language ID and the quality classifier against models of dictionaries and plain sums."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from lodestone.llm import langid, quality
from lodestone.llm.queries import QUERIES
from pyspark.sql import functions as F


def fold_of(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


# ---------------------------------------------------------------- language models
def units(text):
    out = [1]
    for ch in text:
        if ch.isalpha() or unicodedata.category(ch).startswith("M"):
            low = ch.lower() if len(ch.lower()) == 1 else ch
            raw = low.encode("utf-16-le", "surrogatepass")
            out += [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]
        elif out[-1] != 1:
            out.append(1)
    return out if out[-1] == 1 and len(out) > 1 else [*out, 1]


def fourgrams(text):
    s = [1, 1, *units(text)]
    return [tuple(s[i : i + 4]) for i in range(len(s) - 3)]


class PlainModel:
    def __init__(self, texts):
        self.counts = {4: Counter(g for t in texts for g in fourgrams(t))}
        for n in (3, 2, 1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.total, self.kinds = {n: Counter() for n in self.counts}, {n: Counter() for n in self.counts}
        for n, c in self.counts.items():
            for g, k in c.items():
                self.total[n][g[:-1]] += k
                self.kinds[n][g[:-1]] += 1

    def p(self, gram, alphabet):
        out = 1 / alphabet
        for n in (1, 2, 3, 4):
            g = gram[4 - n :]
            total = self.total[n][g[:-1]]
            if total:
                out = max(self.counts[n][g] - 0.75, 0) / total + 0.75 * self.kinds[n][g[:-1]] / total * out
        return out

    def entropy(self, text, alphabet):
        g = fourgrams(text)
        return -sum(math.log(self.p(x, alphabet)) for x in g) / len(g)


def has_letter(text):
    return any(u != 1 for u in units(text or ""))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    r = random.Random(11)
    words = {"aa": ["the", "of", "Thing", "house", "und", "ʼn"], "bb": ["de", "la", "casa", "und", "él", "cosa"], "cc": ["日本", "語の", "です", "𐐷𐐨"], "dd": ["der", "und", "Haus", "ÜBER"]}
    text = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", "", ",", ". 12 "]) for _ in range(n))
    rows = []
    for lang, n in (("aa", 60), ("bb", 52), ("cc", 25), ("dd", 4)):
        rows += [(text(lang, r.randint(1, 30)), lang) for _ in range(n)]
    rows += [(text("aa", 9), None), ("?! 12", "aa"), ("", "bb"), (None, "aa"), ("the casa 日本", None), ("x", None), ("ПриветЖ", None), ("zz" * 2000, None)]
    r.shuffle(rows)
    d = tmp_path_factory.mktemp("corpus")
    ids = [None if i == 17 else i for i in range(len(rows))]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([t for t, _ in rows], pa.string()), "lang": pa.array([x for _, x in rows], pa.string()), "source": pa.array(["s"] * len(rows)), "n_chars": pa.array([len(t or "") for t, _ in rows], pa.int64())}), f"{d}/documents.parquet")
    return str(d), [(i, t, x) for i, (t, x) in zip(ids, rows)]


def test_language_query_equals_a_plain_model(spark, corpus):
    folder, rows = corpus
    known = [(i, t, x) for i, t, x in rows if fold_of(i, 5) not in (0, None) and x is not None and t is not None]
    sizes = Counter(x for _, _, x in known)
    # which texts calibrate is a draw, not a model: it is taken from where it is made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    drawn = {(r.lang, r.text): r.part for r in langid.sample(langid.labelled(docs, ~langid.held_out("doc_id", 5, 0)), dict(sizes), "doc_id", 600).collect()}
    assert len(drawn) == len({(x, t) for _, t, x in known}) and 2 in drawn.values() and sizes["dd"] <= 5
    names = sorted(sizes)
    models = [PlainModel([t for _, t, x in known if x == lang and drawn[x, t] < 2]) for lang in names]
    alphabet = len({g[-1] for m in models for g in m.counts[4]}) + 1
    entropies = lambda t: [m.entropy(t, alphabet) for m in models]
    # calibration
    right, gaps = defaultdict(list), []
    for _, t, x in known:
        if drawn[x, t] == 2 and has_letter(t):
            h = entropies(t)
            best = names[int(np.argmin(h))]
            gaps.append((sorted(h)[1] - sorted(h)[0], best == x))
            if best == x:
                right[x].append(min(h))
    limits = {x: float(np.quantile(v, 0.998)) + 0.6 for x, v in right.items() if len(v) >= 5}
    loss = lambda s: np.mean([math.log1p(math.exp(-s * g)) if ok else math.log1p(math.exp(min(s * g, 500))) for g, ok in gaps])
    scale = min((2.0**k for k in range(9)), key=loss)
    got = {(r.doc_id, r.lang_pred): r for r in QUERIES["op9_language_id"](spark, folder).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        if not has_letter(t):
            want, score, no = "und", 0.0, True
        else:
            h = entropies(t)
            k = int(np.argmin(h))
            want, score = names[k], 1 / sum(math.exp(-(x - h[k]) * scale) for x in h)
            no = h[k] > limits.get(want, math.inf) + 4 / math.sqrt(len(t))
        r = got[i, want]
        assert r.held_out == (fold_of(i, 5) in (0, None)) and r.rejected == no, (i, t)
        assert abs(r.score - score) < 1e-9


# ---------------------------------------------------------------- quality
SETS = [b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b".,;:'\"?", b"!", b"#$%&*@^~+=<>", b"|_-/\\()[]{}", b"\n", bytes(range(128, 256))]


def plain_statistics(text):
    b = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    n, size = len(w), [len(x) for x in w]
    n1, b1 = max(n, 1), max(len(b), 1)
    mean = sum(size) / n1
    out = [math.log1p(n), math.log1p(len(b)), mean, math.sqrt(max(sum(s * s for s in size) / n1 - mean * mean, 0)), math.log1p(max(size, default=0))]
    out += [sum(x in s for x in b) / b1 for s in SETS]
    out += [len(set(w)) / n1, max(Counter(w).values(), default=0) / n1, sum(x == y for x, y in zip(w, w[1:])) / n1]
    for k in (2, 5):
        g = [tuple(w[i : i + k]) for i in range(n - k + 1)]
        out.append(len(set(g)) / len(g) if g else 1.0)
    out += [sum(x[-1] in SETS[5] + SETS[4] for x in w) / n1, sum(x[-1] in SETS[1] for x in w) / n1, math.log1p(n / (b.count(b"\n") + 1))]
    return out


def plain_pav(n, hits):
    """Monotone rates by the largest mean of what lies before over the least of what lies behind."""
    at = [i for i in range(len(n)) if n[i]]
    rate = {}
    for i in at:
        rate[i] = max(min(sum(hits[a] for a in at if lo <= a <= hi) / sum(n[a] for a in at if lo <= a <= hi) for hi in at if hi >= i) for lo in at if lo <= i)
    return np.interp(np.arange(len(n)), at, [rate[i] for i in at])


def test_quality_query_equals_plain_normal_equations(spark, tmp_path):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["alpha", "beta", "gamma,", "delta.", "Omega", "of", "a"]) for _ in range(r.randint(5, 60)))
    junk = lambda: " ".join(r.choice(["$$$", "BUY", "now!", "1234", "###"]) for _ in range(r.randint(3, 40)))
    texts = [(good() if i % 2 else junk()) if i % 11 else good() + junk() + "\n" for i in range(220)] + ["", None, "é " * 50, "one"]
    labels = [(i, int(i % 2) if r.random() > 0.15 else int(not i % 2)) for i in range(0, 220) if i % 4]
    labels += [(3, None), (9999, 1)]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["x"] * len(texts)), "source": pa.array(["s"] * len(texts))}), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in labels], pa.int64()), "quality": pa.array([q for _, q in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), f"{tmp_path}/labels.parquet")
    x = np.array([plain_statistics(t) for t in texts])
    mean, std = x.mean(0), x.std(0)
    z = np.clip((x - mean) / np.where(std > 1e-9, std, 1), -6, 6)
    draw = np.random.default_rng(23)
    turn, shift = draw.normal(size=(len(mean), 256)) / 4.0, draw.uniform(0, 2 * np.pi, 256)
    f = np.concatenate([np.cos(z @ turn + shift) * math.sqrt(2 / 256), np.ones((len(x), 1))], 1)
    y = {i: q for i, q in labels if q is not None and i < len(texts) and fold_of(i, 4) != 2}
    rows = sorted(y)
    assert len(rows) > 80 and {fold_of(i, 4) for i in rows} == {0, 1, 3}

    def weights(some):
        a = sum(np.outer(f[i], f[i]) for i in some)
        return np.linalg.solve(a + np.diag([0.3] * 256 + [1e-9]), sum(f[i] * y[i] for i in some))

    bins = lambda v: np.clip((v + 0.5) / 2 * 512, 0, 511)
    n, hits = np.zeros(512), np.zeros(512)
    for k in (0, 1, 3):
        w = weights([i for i in rows if fold_of(i, 4) != k])
        for i in rows:
            if fold_of(i, 4) == k:
                at = int(bins(f[i] @ w))
                n[at] += 1
                hits[at] += y[i]
    rates, w = plain_pav(n, hits), weights(rows)
    want = np.clip(np.interp(bins(f @ w) - 0.5, np.arange(512), rates), 0, 1)
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and len({round(v, 6) for v in want}) > 5
    for i in range(len(texts)):
        assert got[i].held_out == (fold_of(i, 4) == 2)
        assert abs(got[i].score - want[i]) < 1e-9 and got[i].predicted == int(got[i].score >= 0.7)


# ---------------------------------------------------------------- the pipeline
def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Plain models, SQL and the tokenizers library, stage after stage; what a secret is, is the forest's own."""
    import duckdb
    from lodestone.llm import secrets
    from lodestone.llm.oracle import ORACLE_SQL

    P = pytest.importorskip("corpus_pipeline")
    tokenizers = pytest.importorskip("tokenizers")
    from lodestone.llm.bpe import default_path

    r = random.Random(21)
    words = {"aa": [f"w{chr(97 + i)}th" for i in range(26)] + ["the", "and"], "bb": [f"{chr(97 + i)}ción" for i in range(26)] + ["el", "una"]}
    text = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = []
    for i in range(50):
        lang = "aa" if i % 2 else "bb"
        rows.append((text(lang, r.randint(1, 40)), lang, f"s{i % 4}" if i % 7 else None))
    base = text("aa", 60)
    for _ in range(6):  # near copies, and exact ones
        w = base.split()
        w[r.randrange(60)] = "other"
        rows.append((" ".join(w), "aa", "s1"))
    rows += [rows[0], rows[1], ('the and password = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" and the', "aa", "s2"), ("!? 12", "aa", "s1"), (None, None, "s0"), ("", "bb", "s0"), ("日本語の文字だけ", None, "s3")]
    rows = [(i, t, x, s, len(t or "")) for i, (t, x, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")

    def sql(query, docs):
        db = duckdb.connect()
        db.register("d", pa.table({"doc_id": pa.array([x[0] for x in docs], pa.int64()), "text": pa.array([x[1] for x in docs], pa.string()), "source": pa.array([x[3] for x in docs], pa.string())}))
        db.sql("CREATE VIEW documents AS SELECT * FROM d")
        got = db.sql(query)
        return [dict(zip(got.columns, x, strict=True)) for x in got.fetchall()]

    # language: labelled texts of more than 30 give a part to calibration, the others none
    known = [(i, t, x) for i, t, x, _, _ in rows if x is not None and t is not None]
    sizes = Counter(x for _, _, x in known)
    drawn = {(q.lang, q.text): q.part for q in langid.sample(langid.labelled(df, F.lit(True)), dict(sizes), "doc_id", 600).collect()}
    names = sorted(sizes)
    models = [PlainModel([t for _, t, x in known if x == lang and drawn[x, t] < 2]) for lang in names]
    alphabet = len({g[-1] for m in models for g in m.counts[4]}) + 1
    entropies = lambda t: [m.entropy(t, alphabet) for m in models]
    right = defaultdict(list)
    for _, t, x in known:
        if drawn[x, t] == 2 and has_letter(t):
            h = entropies(t)
            if names[int(np.argmin(h))] == x:
                right[x].append(min(h))
    limits = {x: float(np.quantile(v, 0.998)) + 0.6 for x, v in right.items() if len(v) >= 5}
    stays = lambda t: has_letter(t) and min(h := entropies(t)) <= limits.get(names[int(np.argmin(h))], math.inf) + 4 / math.sqrt(len(t))
    one = [x for x in rows if stays(x[1])]
    assert 50 < len(one) < len(rows)
    # near duplicates
    first = {x["doc_id"] for x in sql(ORACLE_SQL["op7_ngram_join"], one) if x["doc_id"] == x["component_id"]}
    two = [x for x in one if x[0] in first]
    assert len(one) - len(two) >= 7
    # secrets, row by row
    kept = spark.createDataFrame(two, df.schema)
    forest = secrets.train(words=secrets.common_words(kept))
    masked = {q.doc_id: q.redacted for q in secrets.annotate(kept.repartition(5), forest).collect()}
    three = [(i, masked[i], x, s, n) for i, _, x, s, n in two]
    assert sum(a[1] != b[1] for a, b in zip(two, three)) >= 1 and not any("9233a8" in x[1] for x in three)
    # mixing and tokens
    copies = {x["doc_id"]: x["taken"] // x["size"] if x["size"] else 0 for x in sql(ORACLE_SQL["op3_mix_sources"], three)}
    library = tokenizers.Tokenizer.from_file(default_path())
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t, x, s, _ in three:
        ids = library.encode(t, add_special_tokens=False).ids
        want += [(i, s, x, len(ids), np.array(ids, "<u4").tobytes())] * copies[i]
    got = [(q.doc_id, q.source, q.lang, q.n_tokens, bytes(q.token_ids)) for q in P.run(spark, str(tmp_path)).collect()]
    assert len(set(copies.values())) > 1 and sorted(got, key=repr) == sorted(want, key=repr)
