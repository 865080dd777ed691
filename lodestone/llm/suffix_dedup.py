"""Exact repeated byte strings by suffix arrays built with two-stage sorting.

Asked for are all strings of `length` bytes that start in more than one place.  Every start
belongs to one anchor, the 64-byte string of least hash inside its window, so equal windows have
equal anchors: the starts of one anchor (about half a window of them) are a segment, and only
segments of equal anchors can share windows.  Anchors that occur once fall away, so do starts
whose anchor, extended to half the length on their longer side, occurs once.  Segments of equal
bytes are folded into one: what is folded is repeated as a whole.

The different segments of an anchor meet in one task, many anchors to a suffix array.  Suffixes
smaller than their successors are sorted directly; the larger ones are induced by scanning the
buckets of first bytes in order, since a larger suffix is placed by its first byte and the place
of its successor.  Only the starts of segments and what their chains lead to are in the array.
Adjacent suffixes of the array that share `length` bytes are repeats.

An anchor with very many different segments is cut into blocks; each block has its array, and
the classes of equal windows that the blocks found are matched by ranges of their hashes, as many
as there are blocks, so nothing is capped.

Keys that only bring candidates together have 64 bits; what is folded, matched across blocks or
taken for one text has 128, and what an array finds is compared byte by byte.

Defined results: null text is empty; shorter texts lose nothing; equal texts are repetitions of
each other as a whole; kept text is the remaining bytes, cut where they fall; ids may repeat or
be null; only the id and the text are read, whatever else the table has; a text of any length is
one unit, taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, keys_of, mix, pieces, raw, release, signed, slices, workers
from .substring_dedup import keyed_texts, only, repeated

GRAM = 64
BLOCK = 2048  # different segments of one anchor in a block, about a megabyte
ARRAY_BYTES = 512 << 10
_U = np.uint64
_SIDE = _U(0xA5A5A5A5A5A5A5A5)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LETTERS = [keys_of(256, 31), keys_of(256, 32)]
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n and more."""
    if len(_POWERS.get(base, ())) <= n:
        _POWERS[base] = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n + n // 4, base, np.uint64)]))
    return _POWERS[base]


class Hasher:
    """64-bit hashes of any substring of a block of bytes, of either of two kinds."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        n, base = len(data), _BASES[kind]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[kind][data] * _powers(base, n)[:n], out=self.sums[1:])
        self.back = _powers(pow(base, -1, 1 << 64), n)

    def at(self, begin: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[begin + size] - self.sums[begin]) * self.back[begin] + np.asarray(size, np.int64).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def least(key: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive entries: prefix and suffix minima of blocks of k."""
    n = len(key) - k + 1
    pad = np.full(-(-len(key) // k) * k, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(key)] = key
    rows = pad.reshape(-1, k)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[k - 1 : k - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, anchor, first start, last start, hasher, key of the anchors): the starts of each anchor."""
    hasher = Hasher(data)
    n = len(data) - length + 1
    z = np.zeros(0, np.int64)
    if n <= 0:
        return z, z, z, z, hasher, np.zeros(0, np.uint64)
    g = hasher.all(gram)
    low = _U((1 << 32) - 1)  # no text has more bytes; equal hashes go by place, which is relative in equal windows
    anchor = (least((g & ~low) | np.arange(len(g), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)[:n]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = text[:n] == text[length - 1 :]
    edge = np.ones(n, bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (text[1:n] != text[: n - 1]) | ~ok[:-1]
    begin = np.flatnonzero(edge & ok)
    stop = np.append(np.flatnonzero(edge | ~ok), n)
    last = stop[np.searchsorted(stop, begin, "right")] - 1
    return text[begin], anchor[begin], begin, last, hasher, g[anchor[begin]]


def survey(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Of texts(c, text): a row (c, n, sha) for each text and (c, h, a, s1, s2, seg, seg2, lk, rk) for each segment."""
    half = length // 2
    names = ["c", "n", "sha", "h", "a", "s1", "s2", "seg", "seg2", "lk", "rk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in pieces(batches, 2 << 20):
            new = []
            for i, x in enumerate(b.column("c").to_pylist()):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            b = b.take(pa.array(new, pa.int64()))
            data, off = raw(b.column("text"))
            keys = b.column("c").to_numpy()
            for i, j in slices(off, 512 << 10):
                block, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                c, m = keys[i:j], j - i
                sha = [hashlib.sha256(block[x:y].tobytes()).hexdigest() for x, y in zip(o[:-1], o[1:], strict=True)]
                no, none = pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.diff(o)), pa.array(sha), no, none, none, none, no, no, no, no], names)
                text, a, s1, s2, hasher, h = segments(block, o, length, gram)
                if not len(a):
                    continue
                lead = a - (half - gram)
                lk = np.where(lead >= o[text], hasher.at(np.maximum(lead, 0), half), _U(0))
                fits = a + half <= o[text + 1]
                rk = np.where(fits, hasher.at(np.where(fits, a, 0), half) ^ _SIDE, _U(0))
                seg, seg2 = hasher.at(s1, s2 - s1 + length), Hasher(block, 1).at(s1, s2 - s1 + length)
                k, base = len(a), o[text]
                short = lambda x: pa.array((x - base).astype(np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(c[text]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.array(signed(h)), short(a), short(s1), short(s2), pa.array(signed(seg)), pa.array(signed(seg2)), pa.array(signed(lk)), pa.array(signed(rk))], names)

    return texts.mapInArrow(run, "c long, n long, sha string, h long, a int, s1 int, s2 int, seg long, seg2 long, lk long, rk long")


# ---------------------------------------------------------------- the suffix array
def suffix_order(t: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts (sorted places of t) in the order of their suffixes; suffixes that share depth bytes stand together."""
    n = len(t)
    change = np.full(n, n - 1, np.int64)
    at = np.flatnonzero(t[:-1] != t[1:])
    change[at] = at
    change = np.minimum.accumulate(change[::-1])[::-1]  # the next place whose byte differs from its successor's
    after = np.minimum(change + 1, n - 1)
    smaller = (t[change] < t[after]) & (change < n - 1)
    # what the starts lead to: a larger suffix needs the places up to the next smaller one
    place = np.where(smaller, np.arange(n), n - 1)
    upto = np.minimum.accumulate(place[::-1])[::-1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, upto[starts] + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    # stage one: sort the smaller suffixes directly
    direct = np.flatnonzero(inside & smaller)
    if len(direct):
        padded = np.concatenate([t, np.zeros(8, np.uint8)])
        head = sliding_window_view(padded, 8)[direct].copy().view(">u8").ravel()
        direct = direct[np.argsort(head, kind="stable")]
        whole = t.tobytes()
        keys = [whole[i : i + depth] for i in direct.tolist()]
        order = list(range(len(keys)))
        order.sort(key=keys.__getitem__)
        direct = direct[order]
    # stage two: scan the buckets; in each the larger suffixes come first, shorter runs of its byte before longer
    larger = np.flatnonzero(inside & ~smaller)
    run = change[larger] - larger
    larger = larger[np.lexsort((run, t[larger]))]
    run = change[larger] - larger
    rank = np.full(n + 1, -1, np.int64)
    out = np.zeros(len(direct) + len(larger), np.int64)
    d_at = np.searchsorted(t[direct], np.arange(257))
    l_at = np.searchsorted(t[larger], np.arange(257))
    used = 0
    for byte in range(256):
        lo, hi = l_at[byte], l_at[byte + 1]
        while lo < hi:
            end = lo + int(np.searchsorted(run[lo:hi], run[lo], "right"))
            wave = larger[lo:end]
            wave = wave[np.argsort(rank[wave + 1], kind="stable")]
            out[used : used + len(wave)] = wave
            rank[wave] = np.arange(used, used + len(wave))
            used += len(wave)
            lo = end
        small = direct[d_at[byte] : d_at[byte + 1]]
        out[used : used + len(small)] = small
        rank[small] = np.arange(used, used + len(small))
        used += len(small)
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    return out[wanted[out]]


def shares(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a and b have a common prefix of `length` bytes."""
    view = sliding_window_view(t, length)
    out = np.zeros(len(a), bool)
    near = np.flatnonzero(t[a] == t[b])
    for i in range(0, len(near), 4096):
        k = near[i : i + 4096]
        out[k] = (view[a[k]] == view[b[k]]).all(1)
    return out


def repeats(parts: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of segments with so many starts each: (t, starts, repeated, class) of all their windows."""
    t = np.frombuffer(b"".join(parts), np.uint8)
    base = np.cumsum([0, *[len(p) for p in parts[:-1]]])
    lead = np.cumsum(counts) - counts
    starts = np.repeat(base - lead, counts) + np.arange(counts.sum())
    order = suffix_order(t, starts, length)
    same = shares(t, order[:-1], order[1:], length)
    hit = np.zeros(len(order), bool)
    hit[:-1] |= same
    hit[1:] |= same
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    back = np.searchsorted(starts, order)
    found, klass = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64)
    found[back], klass[back] = hit, group
    return t, starts, found, klass


OUT = ["c", "lo", "hi", "h", "r", "data"]
MOST_RANGES = 4096


def match_segments(rows: DataFrame, length: int) -> DataFrame:
    """Of rows(h, b, c, s1, n, done, ranges, bytes): spans (c, lo, hi) of repeated windows; for blocks of
    large anchors (ranges > 0) also (h, r, data): the hash, text, start and openness of their windows,
    by range r of the hash.  Open windows wait for another block to have the same."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, c, s1, n, done, ranges, parts = zip(*held, strict=True)
        counts = np.array(n, np.int64)
        t, starts, found, klass = repeats(list(parts), counts, length)
        part = np.repeat(np.arange(len(counts)), counts)
        lead = np.repeat(np.cumsum(counts) - counts, counts)
        pos = np.array(s1, np.int64)[part] + np.arange(len(part)) - lead
        owner = np.array(c, np.int64)[part]
        done_, ranges_ = np.array(done)[part], np.array(ranges, np.int64)[part]
        on = np.flatnonzero(found & ~done_)
        gap = (on[1:] != on[:-1] + 1) | (part[on[1:]] != part[on[:-1]]) if len(on) else np.zeros(0, bool)
        first, last = (on[np.concatenate([[True], gap])], on[np.concatenate([gap, [True]])]) if len(on) else (on, on)
        m = len(first)
        if m:
            yield pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array(pos[first]), pa.array(pos[last] + length), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], OUT)
        wait = np.flatnonzero((ranges_ > 0) & ~found & ~done_)
        known = np.flatnonzero((ranges_ > 0) & (found | done_))
        if len(known):
            known = known[np.unique(klass[known], return_index=True)[1]]  # one of each class will do
        w = np.concatenate([wait, known])
        if not len(w):
            return
        code, code2 = Hasher(t).at(starts[w], length), Hasher(t, 1).at(starts[w], length)
        table = np.stack([signed(code), signed(code2), owner[w], pos[w], np.repeat([1, 0], [len(wait), len(known)])], 1)
        key = np.array(h, np.int64)[part[w]]
        r = ((code >> _U(20)) % ranges_[w].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((r, key))
        table, key, r = table[order], key[order], r[order]
        edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (r[1:] != r[:-1])) + 1, [len(key)]])
        at, k = edge[:-1], len(edge) - 1
        data = [table[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
        none = pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(key[at]), pa.array(r[at]), pa.array(data, pa.binary())], OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            cols = [b.column(x).to_pylist() for x in ("h", "b", "c", "s1", "n", "done", "ranges", "bytes")]
            for h, k, *rest in zip(*cols, strict=True):
                if (h, k) != last:
                    if size >= ARRAY_BYTES:
                        yield from flush(held)
                        held, size = [], 0
                        release()
                    last = (h, k)
                held.append((h, *rest))
                size += len(rest[-1])
        if held:
            yield from flush(held)

    return rows.repartition(workers(rows.sparkSession), "h", "b").sortWithinPartitions("h", "b").mapInArrow(run, "c long, lo long, hi long, h long, r long, data binary")


def match_blocks(waiting: DataFrame, length: int) -> DataFrame:
    """Spans (c, lo, hi) of open windows that another block of their anchor has too; rows: h, r, data."""

    def spans(held: list[bytes]) -> pa.RecordBatch:
        t = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 5) for x in held])
        t = t[np.lexsort((t[:, 1], t[:, 0]))]
        same = (t[1:, 0] == t[:-1, 0]) & (t[1:, 1] == t[:-1, 1])
        twice = np.append(same, False) | np.insert(same, 0, False)
        t = t[twice & (t[:, 4] == 1)]
        t = t[np.lexsort((t[:, 3], t[:, 2]))]
        cut_ = (t[1:, 2] != t[:-1, 2]) | (t[1:, 3] > t[:-1, 3] + length)
        first, last = (np.concatenate([[True], cut_]), np.concatenate([cut_, [True]])) if len(t) else (slice(0), slice(0))
        return pa.RecordBatch.from_arrays([pa.array(t[first, 2]), pa.array(t[first, 3]), pa.array(t[last, 3] + length)], ["c", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            for h, r, data in zip(*(b.column(x).to_pylist() for x in ("h", "r", "data")), strict=True):
                if held and (h, r) != last:
                    yield spans(held)
                    held = []
                    release()
                last = (h, r)
                held.append(data)
        if held:
            yield spans(held)

    return waiting.select("h", "r", "data").repartition(workers(waiting.sparkSession), "h", "r").sortWithinPartitions("h", "r").mapInArrow(run, "c long, lo long, hi long")


def fetch(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted(c, list of (h, b, s1, s2, done, ranges)) with the bytes of each segment."""
    names = ["h", "b", "c", "s1", "n", "done", "ranges", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column("text"))
            for i in range(0, b.num_rows, 128):
                rows = []
                part = b.slice(i, 128)
                for k, (c, list_) in enumerate(zip(part.column("c").to_pylist(), part.column("list").to_pylist(), strict=True)):
                    at = int(off[i + k])
                    rows += [(x["h"], x["b"], c, x["s1"], x["s2"] - x["s1"] + 1, x["done"], x["ranges"], data[at + x["s1"] : at + x["s2"] + length].tobytes()) for x in list_]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], names)
                release()

    lists = wanted.groupBy("c").agg(F.collect_list(F.struct("h", "b", "s1", "s2", "done", "ranges")).alias("list"))  # as many as a text has segments
    own = only(texts, lists.select("c")).dropDuplicates(["c"])
    return own.join(lists, "c").mapInArrow(run, "h long, b long, c long, s1 int, n int, done boolean, ranges long, bytes binary")


def remove(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(c, spans, n_removed, kept): texts(c, text) without the spans(c, list of (lo, hi)), overlapping ones as one."""
    one = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column("text"))
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                gone, kept, runs = [], [], []
                for k, list_ in enumerate(part.column("list").to_pylist()):
                    text = data[off[i + k] : off[i + k + 1]].tobytes()
                    merged: list[list[int]] = []
                    for lo, hi in sorted((x["lo"], x["hi"]) for x in list_):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], hi)
                        else:
                            merged.append([lo, hi])
                    at, rest = 0, []
                    for lo, hi in merged:
                        rest.append(text[at:lo])
                        at = hi
                    rest.append(text[at:])
                    out = b"".join(rest)
                    kept.append(out)
                    gone.append(len(text) - len(out))
                    runs.append([{"lo": lo, "hi": hi} for lo, hi in merged])
                yield pa.RecordBatch.from_arrays([part.column("c"), pa.array(runs, one), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["c", "spans", "n_removed", "kept"])
                release()

    lists = spans.groupBy("c").agg(F.collect_list(F.struct("lo", "hi")).alias("list"))  # at most a few for each segment of a text
    own = only(texts, lists.select("c")).dropDuplicates(["c"])
    return own.join(lists, "c").mapInArrow(run, "c long, spans array<struct<lo: long, hi: long>>, n_removed long, kept binary")


# ---------------------------------------------------------------- over DataFrames
def dedup(texts: DataFrame, length: int = 400, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Of texts(c, text) a row per different text: c, n_bytes, n_removed, spans (maximal removed runs),
    kept (remaining bytes; null where nothing is removed), kept_sha256."""
    gram = min(gram, max(1, length // 3))
    half = length // 2
    reach = half - gram
    seen = cut(survey(texts, length, gram))
    anchors = seen.where("h is not null").select("c", "h", "a", "s1", "s2", "seg", "seg2", "lk", "rk")
    more = cut(repeated(anchors, "h"))  # a table of its own: Spark can then split the join's hot keys
    alive = cut(anchors.join(more, "h").dropDuplicates(["c", "s1"]))
    twice = cut(repeated(alive.select(F.explode(F.array("lk", "rk")).alias("k")).where("k <> 0"), "k"))
    two = alive.join(twice.select(F.col("k").alias("lk"), F.lit(True).alias("l")), "lk", "left")
    two = two.join(twice.select(F.col("k").alias("rk"), F.lit(True).alias("r")), "rk", "left")
    # a start at offset o before its anchor needs the left extension if o >= reach, the right one if length - gram - o >= reach
    s1 = F.when(F.coalesce("l", F.lit(False)), F.col("s1")).otherwise(F.greatest("s1", F.col("a") - reach + 1))
    s2 = F.when(F.coalesce("r", F.lit(False)), F.col("s2")).otherwise(F.least("s2", F.col("a") - (length - gram - reach) - 1))
    trimmed = lambda seg: F.xxhash64(seg, s1 - F.col("s1"), s2 - F.col("s1")).alias(seg)
    segs = two.select("h", "c", s1.alias("t1"), s2.alias("t2"), trimmed("seg"), trimmed("seg2")).where("t1 <= t2")
    segs = cut(segs.select("h", "seg", "seg2", "c", F.col("t1").alias("s1"), F.col("t2").alias("s2")))
    # equal segments are one; whatever was folded is repeated
    kinds = cut(segs.groupBy("h", "seg", "seg2").agg(F.count("*").alias("m"), F.min(F.struct("c", "s1", "s2")).alias("one")))
    folded = segs.join(kinds.where("m > 1").select("h", "seg", "seg2"), ["h", "seg", "seg2"]).select("c", F.col("s1").cast("long").alias("lo"), (F.col("s2") + length).cast("long").alias("hi"))
    per = cut(kinds.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"))  # a table of its own, as above
    distinct = kinds.join(per, "h")
    ranges = F.when(F.col("k") > block, F.least(F.ceil(F.col("k") / block), F.lit(MOST_RANGES))).otherwise(0).cast("long")
    b = F.when(F.col("k") > block, F.pmod(F.xxhash64("seg", "seg2"), F.ceil(F.col("k") / block))).otherwise(0).cast("long")
    wanted = distinct.select("h", b.alias("b"), F.col("one.c").alias("c"), F.col("one.s1").alias("s1"), F.col("one.s2").alias("s2"), (F.col("m") > 1).alias("done"), ranges.alias("ranges"))
    matched = cut(match_segments(fetch(texts, cut(wanted), length), length))
    across = match_blocks(matched.where("data is not null"), length)
    many = texts.select("c").groupBy("c").agg(F.count("*").alias("m")).where("m > 1").select("c")
    spans = folded.unionByName(matched.where("data is null").select("c", "lo", "hi")).unionByName(across)
    spans = cut(spans.join(many, "c", "left_anti"))
    gone = cut(remove(texts, spans))
    drop(per)
    per = seen.where("n is not null").select("c", "n", "sha").dropDuplicates(["c"])
    per = per.join(gone, "c", "left").join(many.withColumn("all", F.lit(True)), "c", "left")
    every = F.coalesce("all", F.lit(False)) & (F.col("n") >= length)
    kept = F.when(every, F.lit(b"")).otherwise(F.col("kept"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))
    out = per.select(
        "c", F.col("n").alias("n_bytes"),
        F.when(every, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(every, whole).otherwise(F.col("spans")).alias("spans"), kept.alias("kept"),
        F.when(kept.isNull(), F.col("sha")).otherwise(F.sha2(kept, 256)).alias("kept_sha256"),
    )
    drop(alive, more, twice, segs, kinds, matched)
    return out


def annotate(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs."""
    keyed, texts = keyed_texts(docs, id_col, text_col)
    per = dedup(texts, length, **options)
    per = cut(per.select("c", "n_bytes", "n_removed", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), "kept_sha256"))
    per = per.withColumn("n_spans", F.greatest("n_spans", F.lit(0)).cast("long"))
    return keyed.join(per, "c").select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")
