"""Document quality: random Fourier features, ridge by summed normal equations, isotonic calibration.

Each text becomes a vector of statistics (lengths, repetition, classes of bytes).  Standardised
vectors pass through D random cosines, whose inner products approximate a Gaussian kernel.  Every
partition adds up its normal equations per fold, Spark adds the partitions in steps, and only those sums
(3 x (D+1)^2 numbers, whatever the input) reach the driver, where ridge regressions are solved:
one over all folds, and one without each fold.  The latter score their own left-out fold; pooling
adjacent violators over a histogram of these scores gives the monotone map to a probability.

All labelled training rows are used; every text is scored, whole.

Defined results: null and empty texts have the statistics of an empty text and get a score; an
empty table of documents gives an empty result; long texts count whole; rows
without a label are not learned from; without labels every score is 0.5, with one class it is
that class's; repeated rows score alike; extra columns pass through, those named like results
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, raw, slices, sum_blobs, windows_of, words

BINS = 512
SLICES = 8


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = [
    _class(b"0123456789"),
    _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _class(b"abcdefghijklmnopqrstuvwxyz"),
    _class(b".,;:'\"?"),
    _class(b"!"),
    _class(b"#$%&*@^~+=<>"),
    _class(b"|_-/\\()[]{}"),
    _class(b"\n"),
    _class(bytes(range(128, 256))),
]
N_STATS = 22


def _repeats(key: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of different keys, and the count of the commonest."""
    different, top = np.zeros(n), np.zeros(n)
    if len(key):
        order = np.lexsort((key, text))
        k, t = key[order], text[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(k)))
        different = np.bincount(t[at], minlength=n).astype(float)
        np.maximum.at(top, t[at], run)
    return different, top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x N_STATS) numbers, all finite."""
    n = len(offsets) - 1
    h, begin, end, first = words(data, offsets)
    nw = np.diff(first).astype(float)
    nb = np.diff(offsets).astype(float)
    text = np.repeat(np.arange(n), np.diff(first))
    size = (end - begin).astype(float)
    w1, b1 = np.maximum(nw, 1), np.maximum(nb, 1)
    mean = np.bincount(text, size, n) / w1
    var = np.maximum(np.bincount(text, size**2, n) / w1 - mean**2, 0)
    longest = np.zeros(n)
    np.maximum.at(longest, text, size)
    cols = [np.log1p(nw), np.log1p(nb), mean, np.sqrt(var), np.log1p(longest)]
    for c in _CLASSES:
        run = np.concatenate([[0], np.cumsum(c[data])])
        cols.append((run[offsets[1:]] - run[offsets[:-1]]) / b1)
    kinds, top = _repeats(h, text, n)
    cols += [kinds / w1, top / w1]
    again = np.zeros(n)
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        again = np.bincount(text[1:][same], minlength=n).astype(float)
    cols.append(again / w1)
    for k in (2, 5):
        g, at = windows_of(h, first, k)
        total = np.bincount(text[at], minlength=n).astype(float) if len(at) else np.zeros(n)
        kinds, _ = _repeats(g, text[at] if len(at) else at, n)
        cols.append(np.where(total > 0, kinds / np.maximum(total, 1), 1.0))
    last = np.zeros(n)
    odd = np.zeros(n)
    if len(h):
        tail = data[end - 1]
        last = np.bincount(text, (_CLASSES[5] | _CLASSES[4])[tail].astype(float), n) / w1
        odd = np.bincount(text, _CLASSES[1][tail].astype(float), n) / w1
    cols += [last, odd, np.log1p(nw / np.maximum(cols[12] * b1 + 1, 1))]
    return np.nan_to_num(np.stack(cols, 1))


def featurise(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and x, the statistics of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column("_text"))
            for i, j in slices(off):
                x = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * N_STATS + 1, N_STATS), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, j - i) for c in keep], lists], [*keep, "x"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


class Kernel:
    """Standardisation and random cosines."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        f = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([f, np.ones((len(x), 1))], 1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def normal_sums(rows: DataFrame, kernel: Kernel, folds: list[int]) -> dict[int, np.ndarray]:
    """Per fold the sums of [F y]'[F y]; rows: x, y, fold."""
    side = kernel.w.shape[1] + 2
    cuts = np.linspace(0, side, SLICES + 1).astype(int)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: np.zeros((side, side)) for f in folds}
        for b in batches:
            if b.num_rows == 0:
                continue
            f = np.concatenate([kernel(matrix(b.column("x"))), b.column("y").to_numpy(zero_copy_only=False).astype(float)[:, None]], 1)
            fold = b.column("fold").to_numpy(zero_copy_only=False)
            for k in folds:
                part = f[fold == k]
                total[k] += part.T @ part
        from pyspark import TaskContext

        lane = TaskContext.get().partitionId()
        for k in folds:
            for s in range(SLICES):
                yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in (k, s, lane)], pa.array([total[k][cuts[s] : cuts[s + 1]].tobytes()], pa.binary())], ["fold", "slice", "lane", "sums"])

    parts = rows.select("x", F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold")).mapInArrow(add, "fold int, slice int, lane int, sums binary")
    sums = sum_blobs(parts, ["fold", "slice"])
    got = sums.collect()  # folds x slices rows
    drop(sums)
    out = {}
    for k in folds:
        mine = sorted((r for r in got if r.fold == k), key=lambda r: r.slice)
        out[k] = np.concatenate([np.frombuffer(bytes(r.sums)).reshape(-1, side) for r in mine]) if mine else np.zeros((side, side))
    return out


def ridge(sums: np.ndarray, strength: float) -> np.ndarray:
    a, y = sums[:-1, :-1].copy(), sums[:-1, -1]
    a[np.arange(len(a) - 1), np.arange(len(a) - 1)] += strength  # the constant is free
    a[-1, -1] += 1e-9
    return np.linalg.solve(a, y)


def pool_adjacent(n: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The monotone rates nearest to hits/n, weighted by n; empty bins take what is between their neighbours."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(n > 0):
        blocks.append([hits[i], n[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h, m, _, hi = blocks.pop()
            blocks[-1][0] += h
            blocks[-1][1] += m
            blocks[-1][3] = hi
    at, rate = [], []
    for h, m, lo, hi in blocks:
        at += [lo, hi]
        rate += [h / m] * 2
    return np.interp(np.arange(len(n)), at, rate) if at else np.full(len(n), 0.5)


class Scorer:
    def __init__(self, kernel: Kernel | None, weights: np.ndarray | None, rates: np.ndarray):
        self.kernel, self.weights, self.rates = kernel, weights, rates

    @staticmethod
    def bins(raw_score: np.ndarray) -> np.ndarray:
        return np.clip((raw_score + 0.5) / 2 * BINS, 0, BINS - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(x), self.rates[0])
        place = self.bins(self.kernel(x) @ self.weights) - 0.5
        return np.clip(np.interp(place, np.arange(BINS), self.rates), 0, 1)


def fit(rows: DataFrame, features: int = 256, width: float = 4.0, strength: float = 0.3, seed: int = 23) -> Scorer:
    """A scorer from rows(x, y, fold): x of all documents, y null where there is no label to learn from."""
    stats = rows.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N_STATS)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(N_STATS)]).first()
    learn = rows.where("y is not null")
    prior = {r.fold: (r.n, r.hits) for r in learn.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("hits")).collect()}
    n, hits = sum(p[0] for p in prior.values()), sum(p[1] for p in prior.values())
    if n == 0 or hits in (0, n):
        return Scorer(None, None, np.full(1, hits / n if n else 0.5))
    kernel = Kernel(np.array([stats[f"m{i}"] for i in range(N_STATS)]), np.array([stats[f"s{i}"] for i in range(N_STATS)]), features, width, seed)
    folds = sorted(prior)
    sums = normal_sums(learn, kernel, folds)
    total = sum(sums.values())
    weights = ridge(total, strength)
    without = {k: ridge(total - sums[k], strength) if n > prior[k][0] else weights for k in folds}

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, BINS))
        for b in batches:
            if b.num_rows == 0:
                continue
            f, y = kernel(matrix(b.column("x"))), b.column("y").to_numpy(zero_copy_only=False).astype(float)
            fold = b.column("fold").to_numpy(zero_copy_only=False)
            for k in folds:
                at = Scorer.bins(f[fold == k] @ without[k]).astype(int)
                count[0] += np.bincount(at, minlength=BINS)
                count[1] += np.bincount(at, y[fold == k], BINS)
        full = np.flatnonzero(count[0])
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(count[0][full]), pa.array(count[1][full])], ["bin", "n", "hits"])

    got = learn.select("x", "y", F.col("fold").cast("int").alias("fold")).mapInArrow(histogram, "bin long, n double, hits double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()
    count = np.zeros((2, BINS))
    for r in got:
        count[:, r.bin] = r.n, r.hits
    return Scorer(kernel, weights, pool_adjacent(count[0], count[1]))


def score(docs: DataFrame, labels: DataFrame, trainable: Column, fold: Column, id_col: str = "doc_id", label: str = "quality", keep: list[str] | None = None, **options) -> DataFrame:
    """docs (the columns in keep, else all) with score; learned from labels(id_col, label) where trainable holds."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("d"), F.col(id_col).alias("k"), trainable.alias("t"), fold.cast("int").alias("fold"), "text")
    feats = cut(featurise(src, ["d", "k", "t", "fold"]))
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(label).alias("y"))
    rows = feats.select("k", "t", "fold", "x").join(marks, "k", "left").select("x", "fold", F.when(F.col("t"), F.col("y")).cast("int").alias("y"))
    scorer = fit(rows, **options)
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(held.value(matrix(b.column("x"))))], ["d", "score"])

    schema = T.StructType([feats.schema["d"], T.StructField("score", T.DoubleType())])
    return feats.select("d", "x").mapInArrow(run, schema).select(*[F.col("d")[c].alias(c) for c in keep], "score")
