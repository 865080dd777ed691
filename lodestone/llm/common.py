"""What the corpus operators share: tables, cut points, components, vectorised text hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_M = np.uint64
CHUNK_BYTES = 1 << 20


# --------------------------------------------------------------- tables and cut points
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set and all is one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While a table of texts is written, few rows go to Python at once: a batch lies outside the
    heap of the executor, and texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends there, so
    that a lost executor costs no more than the stages after it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with small_batches(spark):
        (df.repartition(parts, *keys) if parts else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Delete cut tables that no later step reads."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
            df._cut_path = None


def text_column(docs: DataFrame, keep: list[str]) -> str:
    """The name under which with_text has the text."""
    return "text" if "text" in keep else "_text"


def with_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and the text, once."""
    return docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("_text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def workers(spark: SparkSession) -> int:
    """Partitions for a stage of Python work over a small table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """df as a broadcast side if its counted rows are under the limit, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def text_key(docs: DataFrame, text: Column) -> Column:
    """A 64-bit key of each different text of docs.  It is a hash; where two texts share it, which a
    second hash tells, the others take that one.  Those few pairs (n*n / 2**65 of n texts) are
    all that is collected, and 128 bits decide what is one text."""
    a, b = F.xxhash64(text), F.xxhash64(F.lit(71), text)
    per = docs.select(a.alias("a"), b.alias("b")).groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    clash = per.where("lo <> hi").select("a", "lo").collect()
    if not clash:
        return a
    first = F.create_map(*[F.lit(x) for r in clash for x in (r.a, r.lo)])
    return F.when(a.isin([r.a for r in clash]) & (b != F.element_at(first, a)), b).otherwise(a)


def sum_blobs(rows: DataFrame, keys: list[str], kind: str = "f8", fan_in: int = 256) -> DataFrame:
    """(keys, sums): the element-wise sums, as float64, of arrays of a numpy kind; rows: keys, lane int,
    sums binary.  A lane is the task that made the row; lanes are added in steps, at most fan_in
    in a group, so no group grows with the number of tasks."""
    import pandas as pd

    names = [*keys, "lane"]
    schema = ", ".join([*(f"{k} int" for k in names), "sums binary"])

    def adder(kind: str):
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.frombuffer(pdf["sums"].iloc[0], kind).astype(float)
            for x in pdf["sums"].iloc[1:]:
                total += np.frombuffer(x, kind)
            return pdf[names].iloc[:1].assign(sums=[total.tobytes()])

        return add

    rows = cut(rows.select(*names, "sums"))
    lanes = (rows.agg(F.max("lane")).first()[0] or 0) + 1
    while True:
        made = rows.withColumn("lane", F.floor(F.col("lane") / fan_in).cast("int")).groupBy(*names).applyInPandas(adder(kind), schema)
        made, kind, lanes = cut(made), "f8", -(-lanes // fan_in)
        drop(rows)
        rows = made
        if lanes == 1:
            out = rows.drop("lane")
            out._cut_path = rows._cut_path
            return out


# --------------------------------------------------------------- connected components
def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of all ids in edges(u, v): component is the smallest id reachable.

    Each round hooks every node on its smallest neighbour, shortens the parent chains twice and
    contracts the edges; no group of neighbours is ever gathered, only minima are taken.
    """
    e = cut(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct())
    labels = cut(e.select(F.col("u").alias("id")).union(e.select("v")).distinct().withColumn("component", F.col("id")))
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p0 = cut(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("p")))
        up = p0.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        p1 = cut(p0.join(up, "p").select("u", F.col("pp").alias("p")))
        up = p1.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        p2 = cut(p1.join(up, "p").select("u", F.col("pp").alias("p")))
        a = p2.select("u", F.col("p").alias("pu"))
        b = p2.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e2 = cut(e.join(a, "u").join(b, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
        c = p2.select(F.col("u").alias("component"), F.col("p").alias("root"))
        l2 = cut(labels.join(c, "component", "left").select("id", F.coalesce("root", "component").alias("component")))
        drop(e, labels, p0, p1, p2)
        e, labels = e2, l2
    else:
        raise RuntimeError("components did not settle")
    drop(e)
    return labels


class UnionFind:
    """Over 0..n-1, the smallest index of a class is its root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """root (the smallest index of each index's class) after all pairs u, v are united."""
    while len(u):
        a, b = root[u], root[v]
        on = a != b
        a, b, u, v = a[on], b[on], u[on], v[on]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
    return root


# --------------------------------------------------------------- 64-bit hashing in numpy
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _M(30)
    x *= _M(0xBF58476D1CE4E5B9)
    x ^= x >> _M(27)
    x *= _M(0x94D049BB133111EB)
    x ^= x >> _M(31)
    return x


def keys_of(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit multipliers; the i-th is the same for every n."""
    return mix((np.arange(n, dtype=np.uint64) + _M(1)) * _M(0x9E3779B97F4A7C15) + _M(seed)) | _M(1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes between terms: what is neither an ASCII digit or letter nor part of a wider character.
TERM_GAP = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    TERM_GAP[_lo:_hi] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = {False: keys_of(256, 11), True: keys_of(256, 11)[_LOWER]}
_PLACES = keys_of(1 << 12, 12)


def _places(n: int) -> np.ndarray:
    global _PLACES
    if len(_PLACES) < n:
        _PLACES = keys_of(1 << int(n).bit_length(), 12)
    return _PLACES


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts, without a copy per text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
        column = column.fill_null(b"" if binary else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if bufs[2] is None:
        return np.empty(0, np.uint8), off - off[0]
    return np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges (i, j) of about `most` bytes each; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, gap: np.ndarray = _SPACE):
    """Words of a block of texts: (hashes, begin, end, first) where first[d]:first[d+1] are the
    words of text d and begin/end are byte places in data.  lower folds A-Z alone; gap marks the
    bytes between words."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    space = gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    ink = ~space
    start = ink.copy()
    start[1:] &= space[:-1] | edge[1:n]
    stop = ink.copy()
    stop[:-1] &= space[1:] | edge[1:n]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    first = np.searchsorted(begin, offsets)
    at = np.flatnonzero(ink)
    size = end - begin
    if len(begin) == 0:
        return np.zeros(0, np.uint64), begin, end, first
    lead = np.zeros(len(begin), np.int64)
    np.cumsum(size[:-1], out=lead[1:])
    place = np.arange(len(at), dtype=np.int64) - np.repeat(lead, size)
    value = _BYTES[lower][data[at]] * _places(int(size.max()))[place]
    return mix(np.add.reduceat(value, lead) + size.astype(np.uint64)), begin, end, first


def windows(h: np.ndarray, k: int, seed: int = 13) -> np.ndarray:
    """Hashes of all runs of k consecutive entries of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, m = np.zeros(n, np.uint64), keys_of(k, seed)
    for i in range(k):
        out += h[i : i + n] * m[i]
    return mix(out)


def windows_of(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of k words inside one text: (hashes, index of the first word)."""
    w = windows(h, k)
    if len(w) == 0:
        return w, np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = np.flatnonzero(text[: len(w)] == text[k - 1 :])
    return w[ok], ok


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(ddl_frame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl_frame)


_LIBC = None
_RELEASED = 0.0


def release(seconds: float = 0.1) -> None:
    """Give freed memory back, if that was not done just now: a worker that waits, or works on little,
    should hold little."""
    global _LIBC, _RELEASED
    if time.monotonic() < _RELEASED + seconds:
        return
    _RELEASED = time.monotonic()
    if _LIBC is None:
        try:
            _LIBC = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            _LIBC = lambda pad: 0
    pa.default_memory_pool().release_unused()
    _LIBC(0)


def pieces(batches, most: int = 4 << 20, column: str = "text"):
    """Record batches cut so that none holds much over `most` bytes of text, but for one long text."""
    for b in batches:
        if b.num_rows == 0:
            continue
        _, off = raw(b.column(column))
        for i, j in slices(off, most):
            yield b.slice(i, j - i)
            release()


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys, from a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys])
        edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for x, y in zip(edges, edges[1:]):  # noqa: B905
            now = tuple(k[:, x].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
                release()
            held.append(b.slice(x, y - x))
            last = now
    if held:
        yield pa.Table.from_batches(held)
