"""Approximate nearest neighbours by shifted Hilbert curves.

Every curve projects the vectors on a few random orthogonal directions, scales each direction to
the vectors' spread, shifts it by a random offset and orders the cells by their Hilbert index.
Spark range-partitions the rows by (curve, index); counts per partition turn places into exact
ranks.  A query meets, on every curve, the rows whose rank is within `window` of its own: ranks
are cut into blocks, rows lie in one block, queries are sent to the blocks their window touches.

What travels along a curve is an int8 code of the vector with the norm of what the code lost.  That
norm bounds the true distance from both sides, so a block returns only candidates that can be
among the k nearest of the window, by id.  Per query the ids of all curves are merged, sifted by
the same bounds, and only then are vectors fetched and ranked by the exact distance, once.

The window is fitted: the true neighbours of at most SAMPLE query vectors (drawn by a hash) are
found by comparing these with all rows, and the window is the least that holds the given share of
them on their nearest curve.  Where the data let it, it stays small however many rows there are;
on vectors without structure it grows with them.  Every row is indexed.  Equal vectors are folded
into one, so copies never fill a window.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows
without id take no part; vectors of different length never meet; fewer candidates than k give
fewer rows; ties go to the smaller id; a row repeated with id and vector counts once; an empty
table gives an empty result; only the id, the vector and what is_query names are read, whatever
else the table has.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut, drop, groups_of, workers
from .vectors import usable, vector_key

DIRECTIONS = 8
BITS = 7
CURVES = 16
SAMPLE = 64  # query vectors that the window is fitted on
LEAST_WINDOW = 128
MOST_SIDE = 16_384  # rows in a block
CELLS = 1 << 21  # distances computed at once


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n x m, each below 2**bits)."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one, m = np.uint64(1), len(x)
    for bit in range(bits - 1, 0, -1):
        low = np.uint64((1 << bit) - 1)
        for i in range(m):
            on = (x[i] >> np.uint64(bit)) & one == one
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(on, low, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, m):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[m - 1] >> np.uint64(bit)) & one == one, np.uint64((1 << bit) - 1), np.uint64(0))
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << one) | (((x[i] ^ turn) >> np.uint64(bit)) & one)
    return key


class Curve:
    def __init__(self, dim: int, seed: int, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng([seed, dim])
        m = min(DIRECTIONS, dim)
        self.turn = np.linalg.qr(rng.normal(size=(dim, m)))[0]
        self.mean, self.std = mean, std
        self.shift = rng.uniform(0, 0.5, m)

    def keys(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.turn / self.std
        u = 0.5 / (1 + np.exp(np.clip(-1.702 * z, -60, 60))) + self.shift
        return hilbert(np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def encode(x: np.ndarray) -> np.ndarray:
    """A row of bytes for each vector: int8 code, scale, square of the decoded norm, norm of the loss."""
    with np.errstate(all="ignore"):
        scale = np.maximum(np.abs(x).max(1), 1e-300) / 127.0
        q = np.rint(x / scale[:, None]).astype(np.int8)
        back = q * scale[:, None]
        tail = np.stack([scale, (back * back).sum(1), np.sqrt(((x - back) ** 2).sum(1)) * (1 + 1e-9)], 1)
    return np.concatenate([q.view(np.uint8), tail.view(np.uint8)], 1)


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(decoded vectors, squares of their norms, norms of the loss)."""
    tail = np.ascontiguousarray(codes[:, -24:]).view(np.float64)
    return codes[:, :-24].view(np.int8) * tail[:, :1], tail[:, 1], tail[:, 2]


def bounds(codes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible distance of every asked vector (rows) to every coded one; 0 and infinity
    where numbers overflow."""
    x, norm, loss = decode(codes)
    with np.errstate(all="ignore"):
        own = (asked * asked).sum(1)[:, None]
        square = own + norm[None] - 2 * (asked @ x.T)
        slack = 1e-13 * x.shape[1] * (own + norm[None])  # of rounding in the squares
        lo = np.sqrt(np.maximum(square - slack, 0)) - loss[None]
        hi = np.sqrt(np.maximum(square + slack, 0)) + loss[None]
    odd = ~np.isfinite(hi)
    return np.where(odd, 0.0, np.maximum(lo, 0)), np.where(odd, np.inf, hi)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x and y, in double precision."""
    d = x - y
    with np.errstate(all="ignore"):
        out = np.sqrt((d * d).sum(1))
        top = np.maximum(np.abs(d).max(1), 1e-300)
        safe = top * np.sqrt(((d / top[:, None]) ** 2).sum(1))
    return np.where(np.isfinite(out) & (out > 1e-150), out, np.where(top > 1e-300, safe, 0.0))


def floats(column: pa.Array) -> np.ndarray:
    """The vectors of a binary column, all of one length."""
    return np.stack([np.frombuffer(x) for x in column.to_pylist()])


def _blobs(rows: DataFrame) -> DataFrame:
    """rows with the array v as the bytes of its doubles."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, off = v.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(v.offsets.to_numpy())
            ends = np.concatenate([[0], np.cumsum(off)]) * 8
            whole = flat.tobytes()
            cols = [pa.array([whole[i:j] for i, j in itertools.pairwise(ends.tolist())], pa.binary()) if c == "v" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, T.StructType([T.StructField("v", T.BinaryType()) if f.name == "v" else f for f in rows.schema]))


def ranked(flat: DataFrame, made: dict[int, list[Curve]]) -> DataFrame:
    """(dim, curve, rep, code, rank): the exact rank of every vector on every curve."""
    spark = flat.sparkSession
    held = spark.sparkContext.broadcast(made)
    order = ["dim", "curve", "key", "rep"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column("dim").to_numpy()
            for d in np.unique(dim):
                at = pa.array(np.flatnonzero(dim == d))
                x, rep, n = floats(b.column("v").take(at)), b.column("rep").take(at), len(at)
                code = pa.array([c.tobytes() for c in encode(x)], pa.binary())
                for c, curve in enumerate(held.value[int(d)]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(curve.keys(x).astype(np.int64)), rep, code], [*order, "code"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            if not b.num_rows:
                continue
            line = b.column("dim").to_numpy().astype(np.int64) << 32 | b.column("curve").to_numpy()
            place = np.zeros(len(line), np.int64)
            for x in np.unique(line):
                m = line == x
                place[m] = seen.get(int(x), 0) + np.arange(m.sum())
                seen[int(x)] = seen.get(int(x), 0) + int(m.sum())
            yield pa.RecordBatch.from_arrays([b.column("dim"), b.column("curve"), pa.array(np.full(len(line), part, np.int32)), pa.array(place), b.column("rep"), b.column("code")], ["dim", "curve", "part", "place", "rep", "code"])

    keys = cut(flat.select("rep", "dim", "v").mapInArrow(keyed, "dim int, curve int, key long, rep long, code binary"))  # once: the ranges are sampled first
    spread = keys.repartitionByRange(workers(spark), *order).sortWithinPartitions(*order)
    placed_ = cut(spread.mapInArrow(placed, "dim int, curve int, part int, place long, rep long, code binary"))
    # about one row a partition: a partition holds the rows of few curves
    counts = placed_.groupBy("dim", "curve", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("dim", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select("dim", "curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    rows = placed_.join(broadcast_if_small(counts, counts.count()), ["dim", "curve", "part"])
    out = cut(rows.select("dim", "curve", "rep", "code", (F.col("place") + F.col("before")).alias("rank")))
    drop(keys, placed_, counts)
    return out


def fitted_windows(flat: DataFrame, ranks: DataFrame, asks: DataFrame, dims: dict[int, int], k: int, share: float) -> dict[int, int]:
    """The window of each length of vectors.  At most SAMPLE vectors of each come to the driver."""
    spark = flat.sparkSession
    few = asks.withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("rep"), "rep"))).where(F.col("n") <= SAMPLE)
    mine: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    got = few.select("dim", "rep", "v").collect()
    for dim in dims:
        own = [r for r in got if r.dim == dim]
        if own:
            mine[dim] = np.array([r.rep for r in own], np.int64), np.stack([np.frombuffer(bytes(r.v)) for r in own])
    held = spark.sparkContext.broadcast(mine)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column("dim").to_numpy()
            for d, (reps, asked) in held.value.items():
                at = np.flatnonzero(dim == d)
                if not len(at):
                    continue
                rep = b.column("rep").to_numpy()[at]
                x = floats(b.column("v").take(pa.array(at)))
                with np.errstate(all="ignore"):
                    square = (asked * asked).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (asked @ x.T)
                square = np.where(np.isfinite(square) & (rep[None] != reps[:, None]), square, np.inf)
                near = np.argsort(square, 1)[:, :k]
                q = np.repeat(np.arange(len(reps)), near.shape[1])
                c, s = near.ravel(), square[np.arange(len(reps))[:, None], near].ravel()
                yield pa.RecordBatch.from_arrays([pa.array(reps[q]), pa.array(rep[c]), pa.array(s)], ["q", "rep", "s"])

    best = flat.select("dim", "rep", "v").mapInArrow(nearest, "q long, rep long, s double").where(F.col("s") < float("inf"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("s", "rep"))).where(F.col("n") <= k)
    pairs = best.select("q", "rep").collect()  # k a sampled vector
    need = spark.createDataFrame([(x,) for x in {x for p in pairs for x in p}], "rep long")
    at: dict[int, dict[int, int]] = {}
    kind: dict[int, int] = {}
    for r in ranks.join(F.broadcast(need), "rep").select("dim", "curve", "rep", "rank").collect():  # curves rows for each of these
        at.setdefault(r.rep, {})[r.curve] = r.rank
        kind[r.rep] = r.dim
    apart: dict[int, list[int]] = {}
    for q, rep in pairs:
        apart.setdefault(kind[q], []).append(min(abs(at[q][c] - at[rep][c]) for c in at[q]))
    return {dim: min(n, max(LEAST_WINDOW, int(np.quantile(apart[dim], share, method="higher")) if dim in apart else 0)) for dim, n in dims.items()}


def search(
    emb: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES, window: int | None = None, share: float = 0.95, seed: int = 7
) -> DataFrame:
    """(query_id, rank, id_col, score) of the k nearest found of every row where is_query holds.  window: rows
    to either side on each curve; if it isn't given, the least that holds `share` of the neighbours of a sample."""
    spark = emb.sparkSession
    rows = emb.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(usable(F.col("v"), F.col("id"))).select("*", *vector_key("v"))
    # the classes of equal vectors; of each the k + 1 smallest ids can be among anyone's k nearest
    ids = rows.groupBy("h1", "h2", "id").agg(F.max("q").alias("q"))
    ids = cut(ids)
    first = ids.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k + 1)
    first = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    kinds = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"))
    flat = kinds.join(first, ["h1", "h2"]).select("h1", "h2", F.col("ids")[0].alias("rep"), F.size("v").alias("dim"), "v", "ids")
    flat = cut(_blobs(flat))
    asked = cut(ids.where("q").select("id", "h1", "h2").join(flat.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep"))
    asks = cut(flat.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "dim", "v"))
    dims = {r.dim: r.n for r in flat.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not dims or asks.isEmpty():
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    centres = _centres(flat)
    made = {dim: [Curve(dim, seed * 1000 + c, *centres[dim]) for c in range(curves)] for dim in dims}
    ranks = ranked(flat, made)
    widths = {dim: window for dim in dims} if window else fitted_windows(flat, ranks, asks, dims, k, share)

    of = lambda f: F.create_map(*[F.lit(x) for dim, w in widths.items() for x in (dim, f(w))])[F.col("dim")].cast("long")
    width, side = of(lambda w: w), of(lambda w: min(MOST_SIDE, max(LEAST_WINDOW, w)))
    lying = ranks.select("dim", "curve", F.floor(F.col("rank") / side).alias("block"), "rank", "rep", F.lit(False).alias("ask"), F.col("code").alias("data"))
    asking = asks.join(ranks.select("rep", "curve", "rank"), "rep")
    low, high = F.floor(F.greatest(F.lit(0), F.col("rank") - width) / side), F.floor((F.col("rank") + width) / side)
    asking = asking.select("dim", "curve", F.explode(F.sequence(low, high)).alias("block"), "rank", "rep", F.lit(True).alias("ask"), F.col("v").alias("data"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, ["dim", "curve", "block"]):
            ask = t.column("ask").to_numpy()
            if not ask.any() or ask.all():
                continue
            w = widths[t.column("dim")[0].as_py()]
            rank, rep = t.column("rank").to_numpy(), t.column("rep").to_numpy()
            code = np.stack([np.frombuffer(x, np.uint8) for x in t.filter(pa.array(~ask)).column("data").to_pylist()])
            vec = floats(t.filter(pa.array(ask)).column("data"))
            place, cand, mid, who = rank[~ask], rep[~ask], rank[ask], rep[ask]
            step = max(1, CELLS // len(code))
            for i in range(0, len(vec), step):
                lo, hi = bounds(code, vec[i : i + step])
                out = (np.abs(place[None] - mid[i : i + step, None]) > w) | (cand[None] == who[i : i + step, None])
                lo[out] = hi[out] = np.inf
                edge = np.partition(hi, k - 1, 1)[:, k - 1 : k] if len(code) > k else np.full((len(hi), 1), np.inf)
                q, c = np.nonzero((lo <= edge) & ~out)
                yield pa.RecordBatch.from_arrays([pa.array(who[i + q]), pa.array(cand[c]), pa.array(lo[q, c]), pa.array(hi[q, c])], ["asked", "rep", "lo", "hi"])

    keys = ["dim", "curve", "block"]
    met = lying.unionByName(asking).repartition(workers(spark), *keys).sortWithinPartitions(*keys)
    met = met.mapInArrow(meet, "asked long, rep long, lo double, hi double").groupBy("asked", "rep").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    # what can still be among the k nearest by the bounds; a query has a few rows for each block it met
    mine = Window.partitionBy("asked")
    edge = F.max(F.when(F.col("n") <= k, F.col("hi"))).over(mine)
    met = met.withColumn("n", F.row_number().over(mine.orderBy("hi", "rep"))).withColumn("edge", edge).where("lo <= edge").select("asked", "rep")
    met = cut(met)
    pairs = met.join(flat.select("rep", "v", "ids"), "rep").join(asks.select(F.col("rep").alias("asked"), F.col("v").alias("y")), "asked")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b.column("v").to_pylist()])
            for d in np.unique(size):
                part = b.take(pa.array(np.flatnonzero(size == d)))
                yield pa.RecordBatch.from_arrays([part.column("asked"), part.column("ids"), pa.array(distances(floats(part.column("v")), floats(part.column("y"))))], ["asked", "ids", "score"])

    found = pairs.select("asked", "ids", "v", "y").mapInArrow(measure, "asked long, ids array<long>, score double")
    own = flat.join(asks.select("rep"), "rep", "left_semi").select(F.col("rep").alias("asked"), "ids", F.lit(0.0).alias("score"))
    found = found.unionByName(own).select("asked", F.explode("ids").alias("cand"), "score")
    nearest = Window.partitionBy("asked").orderBy("score", "cand")
    found = cut(found.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).select("asked", "cand", "score"))
    each = asked.select(F.col("id").alias("query_id"), F.col("rep").alias("asked")).join(found, "asked").where("query_id <> cand")
    nearest = Window.partitionBy("query_id").orderBy("score", "cand")
    out = cut(each.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k))
    drop(ids, flat, asked, asks, ranks, met, found)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("cand").alias(id_col), "score")


def _centres(flat: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """Of the vectors of each length their mean, and the root mean square of what is left of a component; one pass."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for b in batches:
            size = b.column("dim").to_numpy()
            for dim in np.unique(size).tolist():
                x = np.clip(floats(b.column("v").filter(pa.array(size == dim))), -1e100, 1e100)
                n[dim] = n.get(dim, 0) + len(x)
                total[dim] = total.get(dim, 0.0) + np.concatenate([x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], ["dim", "n", "sums"])

    got = flat.select("dim", "v").mapInArrow(sums, "dim long, n long, sums array<double>")
    rows = got.select("dim", "n", F.posexplode("sums")).groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).collect()  # two numbers a component
    means: dict[int, np.ndarray] = {}
    for r in rows:
        means.setdefault(r.dim, np.zeros(2 * r.dim))[r.pos] = r.s / r.n
    return {d: (m[:d], max(float(np.sqrt(max(0.0, np.mean(m[d:] - m[:d] * m[:d])))), 1e-300)) for d, m in means.items()}
