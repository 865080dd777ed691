"""Language identification with interpolated Kneser-Ney character models.

One model per language, of order 4, over the UTF-16 units of the text: letters are case-folded,
everything else is one separator, and no letter is folded away, so four symbols fill a 64-bit key
(a letter beyond U+FFFF is two symbols).  The n-gram counts are summed in Spark from a bounded sample of labelled
texts; a model is kept as hash arrays: sorted 64-bit keys of n-grams with their interpolated
log-probabilities beside them.  A text gets the language of least cross-entropy per character.

Rejection is calibrated on sampled labelled texts that the models did not see: per language the
`keep` quantile of the cross-entropy, plus a margin and an allowance for short texts, is the
highest that is accepted.

Training sample: texts are drawn by a hash of id and text at the rate that gives about
`sample_docs` texts a language (documented bound; whole texts), two thirds for the models, one
third for calibration.  A language of at most SMALL labelled texts uses all of them for its model,
one that the draw left without a text takes one, and one with fewer than FEWEST texts that
calibration got right rejects nothing.  Prediction covers every text, whole.

Defined results: null texts and texts without a letter are `und` with score 0 and are rejected;
rows without a label are not learned from; with no labelled text at all everything is `und`;
equal entropies go to the language that sorts first; repeated rows are predicted alike; texts of
any length are read whole; an empty table gives an empty result; extra columns pass through, those
named like the results are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, pieces, text_column, with_text

ORDER = 4
SEP = 1  # everything that is no letter
SMALL = 30  # labelled texts up to which a language has none for calibration
FEWEST = 5  # calibration texts a rejection limit rests on
BITS = 16  # of a symbol in a packed n-gram
DISCOUNT = 0.75
SHORT = 4.0  # a mean over n letters strays by about this over the root of n
SALT = [np.uint64(x) for x in (0x1F83D9AB, 0x5BE0CD19, 0x9B05688C, 0x510E527F, 0x3C6EF372)]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Case-folded code point of every letter, 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha() or unicodedata.category(ch).startswith("M"):
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """letters() with the separator for all else."""
    return np.maximum(letters(), np.uint32(SEP))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def squeeze(codes: np.ndarray) -> np.ndarray:
    """One separator at most between words, one before and one after."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SEP) | (codes[:-1] != SEP)
    out = codes[keep]
    return np.concatenate([[SEP], out[(1 if len(out) and out[0] == SEP else 0) : (-1 if len(out) > 1 and out[-1] == SEP else None)], [SEP]])


def symbols(text: str) -> np.ndarray:
    """Case-folded letters and separators of a text as UTF-16 units."""
    codes = squeeze(folded()[points(text)])
    if (codes > 0xFFFF).any():
        return np.frombuffer(codes.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-16-le"), np.uint16)
    return codes.astype(np.uint16)


def runs(text: str) -> np.ndarray:
    """The packed n-grams of a text, whose first letter follows separators."""
    return grams(np.concatenate([np.full(ORDER - 2, SEP, np.uint16), symbols(text)]), ORDER, BITS)


def grams(codes: np.ndarray, n: int, bits: int = 8) -> np.ndarray:
    """Packed runs of n codes; a run ends at each place after the first n - 1."""
    k = len(codes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(k, np.uint64)
    for i in range(n):
        out = (out << np.uint64(bits)) | codes[i : i + k].astype(np.uint64)
    return out


def hashed(packed: np.ndarray, n: int) -> np.ndarray:
    return mix(packed ^ (SALT[n - 1] << np.uint64(32)))


class HashArray:
    """Values by 64-bit key: sorted keys, found by bisection."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        if len(self.keys) == 0:
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], default)


class KneserNey:
    """Interpolated model from counts of packed n-grams of the highest order."""

    def __init__(self, top: np.ndarray, counts: np.ndarray, alphabet: int, order: int = ORDER, bits: int = 8):
        self.order, self.bits = order, bits
        g, c = top, counts.astype(np.float64)
        levels = []
        for n in range(order, 0, -1):
            ctx, inv = np.unique(g >> np.uint64(bits), return_inverse=True)
            total = np.bincount(inv, c, len(ctx))
            kinds = np.bincount(inv, minlength=len(ctx)).astype(np.float64)
            levels.append((n, g, np.maximum(c - DISCOUNT, 0) / total[inv], ctx, DISCOUNT * kinds / total))
            # a lower order counts the different letters an n-gram follows
            mask = np.uint64((1 << (bits * (n - 1))) - 1)
            g, c = np.unique(g & mask, return_counts=True) if n > 1 else (g, c)
            c = c.astype(np.float64)
        self.floor = 1.0 / alphabet
        self.share, self.back = {}, {}
        for n, g, share, ctx, gamma in levels:
            self.share[n] = HashArray(hashed(g, n), share)
            self.back[n] = HashArray(hashed(ctx, n - 1) if n > 1 else np.zeros(1, np.uint64), gamma[: len(ctx)])

    def logp(self, packed: np.ndarray) -> np.ndarray:
        """Log-probability of the last letter of each packed n-gram after the others."""
        p = np.full(len(packed), self.floor)
        for n in range(1, self.order + 1):
            g = packed & np.uint64((1 << (self.bits * n)) - 1)
            ctx = g >> np.uint64(self.bits)
            back = self.back[n].get(hashed(ctx, n - 1) if n > 1 else np.zeros(len(g), np.uint64), 1.0)
            p = self.share[n].get(hashed(g, n), 0.0) + back * p
        return np.log(p)


class Models:
    """All languages and what calibration found."""

    def __init__(self, languages: list[str], models: list[KneserNey]):
        self.languages, self.models = languages, models
        self.scale, self.highest = 1.0, {}

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) cross-entropy per symbol; whether a text has a letter."""
        codes = [runs(t) if t else np.zeros(0, np.uint64) for t in texts]
        # the last symbol of some n-gram is a letter
        ink = np.array([bool(((g & np.uint64((1 << BITS) - 1)) != SEP).any()) for g in codes], bool)
        codes = [g if i else g[:0] for g, i in zip(codes, ink, strict=True)]
        sizes = [len(g) for g in codes]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        kinds, inv = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), sizes)
        n = np.maximum(np.array(sizes), 1)
        out = np.zeros((len(texts), len(self.models)))
        for j, m in enumerate(self.models):
            lp = m.logp(kinds)
            out[:, j] = -np.bincount(owner, lp[inv], len(texts)) / n
        return out, ink

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score in 0..1, cross-entropy and whether the text is rejected."""
        if not self.models:
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.inf), np.ones(len(texts), bool)
        h, ink = self.entropies(texts)
        best = h.argmin(1)
        rel = np.exp(-(h - h.min(1, keepdims=True)) * self.scale)
        score = np.where(ink, 1.0 / rel.sum(1), 0.0)
        top = h[np.arange(len(texts)), best]
        limit = np.array([self.highest.get(x, np.inf) for x in self.languages])[best]
        lang = [self.languages[b] if i else "und" for b, i in zip(best, ink, strict=True)]
        limit = limit + SHORT / np.sqrt(np.maximum([len(t or "") for t in texts], 1))
        return lang, score, np.where(ink, top, np.inf), ~ink | (top > limit)


def labelled(docs: DataFrame, trainable: Column) -> DataFrame:
    return docs.where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull())


def sample(rows: DataFrame, sizes: dict[str, int], id_col: str, sample_docs: int) -> DataFrame:
    """(lang, text, part): about sample_docs texts a language, drawn by a hash of id and text; part 2 is for calibration."""
    draw = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("text")), F.lit(n))
    rate = F.lit(0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1_000_000, int(1_000_000 * sample_docs / n) + 1))).otherwise(rate)
    small = [lang for lang, n in sizes.items() if n <= SMALL]
    part = F.when(F.col("lang").isin(small), F.lit(0).cast("long")).otherwise(draw(6, 3))
    return rows.where(draw(5, 1_000_000) < rate).select("lang", "text", part.alias("part"))


def train(docs: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", sample_docs: int = 600, keep: float = 0.998, margin: float = 0.6) -> Models:
    """Models from docs(text, lang) where trainable holds."""
    known = labelled(docs, F.lit(True) if trainable is None else trainable)
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rows = sample(known, sizes, id_col, sample_docs)

    model = Models([], [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for lang in sorted(set(b.column("lang").to_pylist())):
                texts = [t for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True) if x == lang]
                g, n = np.unique(np.concatenate([runs(t) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = lambda texts: texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counted = counts(rows.where("part < 2").select("lang", "text"))
    if missing := sorted(set(sizes) - set(counted.lang)):
        one = F.min_by("text", F.xxhash64(F.lit(5), F.col(id_col), F.col("text")))
        counted = pd.concat([counted, counts(known.where(F.col("lang").isin(missing)).groupBy("lang").agg(one.alias("text")))], ignore_index=True)
    # different symbols of all languages together, and one for all that were not seen
    alphabet = len(np.unique(counted.gram.to_numpy(np.int64).view(np.uint64) & np.uint64((1 << BITS) - 1))) + 1
    for lang, part in sorted(counted.groupby("lang"), key=lambda x: x[0]):
        model.languages.append(lang)
        model.models.append(KneserNey(part.gram.to_numpy(np.int64).view(np.uint64), part.n.to_numpy(), alphabet, bits=BITS))
    if not model.models:
        return model
    calibrate(model, rows.where("part = 2"), keep, margin)
    return model


def calibrate(model: Models, rows: DataFrame, keep: float, margin: float) -> None:
    """Highest accepted cross-entropy per language, and the scale that makes the score a likelihood of being right."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            h, ink = model.entropies(b.column("text").to_pylist())
            lang = b.column("lang").to_pylist()
            ok = np.flatnonzero(ink)
            two = np.sort(h, 1)
            gap = two[:, 1] - two[:, 0] if h.shape[1] > 1 else np.ones(len(h))
            yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in ok], pa.string()), pa.array([model.languages[h[i].argmin()] for i in ok], pa.string()), pa.array(h.min(1)[ok]), pa.array(gap[ok])], ["lang", "best", "h", "gap"])

    got = rows.mapInArrow(measure, "lang string, best string, h double, gap double").toPandas()
    right = got[got.lang == got.best]
    model.highest = {lang: float(part.h.quantile(keep)) + margin for lang, part in right.groupby("lang") if len(part) >= FEWEST}
    # logistic in the gap, fitted by the least log loss over a grid of scales
    if len(got):
        hit = (got.lang == got.best).to_numpy()
        gap = got.gap.to_numpy()
        loss = lambda s: -np.where(hit, -np.log1p(np.exp(-s * gap)), -np.log1p(np.exp(np.minimum(s * gap, 500)))).mean()
        model.scale = float(min((2.0**k for k in range(0, 9)), key=loss))


def predict(docs: DataFrame, model: Models, keep: list[str] | None = None) -> DataFrame:
    """docs (the columns in keep, else all) with lang_pred, score, entropy and rejected."""
    added = ("lang_pred", "score", "entropy", "rejected")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = text_column(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in pieces(batches, 2 << 20, source):
            lang, score, h, no = m.predict(b.column(source).to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(h, pa.float64()), pa.array(no, pa.bool_())], [*keep, *added])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return with_text(docs, keep).mapInArrow(run, schema)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Rows that must not be learned from: crc32 of the id's text falls on the fold (a null id too)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))
