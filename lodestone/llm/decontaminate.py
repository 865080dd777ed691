"""Documents that hold passages of a benchmark, found by suffix arrays over shards of the corpus.

A shard is some megabytes of documents (a longer text is a shard of its own).  Its suffix array is sparse: a
suffix whose first three words begin no run of words of any item cannot be met by any search and is
left out, and words that no kept suffix needs count as an end.  The suffixes are sorted by prefix
doubling.  Every suffix of every item is then searched in every shard by bisection: the range of the array that begins
with the suffix's first `window` words holds all places of that window, and a second
bisection inside that range gives the longest verbatim match and where it is.

Each document is judged on its own, so nothing is shuffled; the items go to all tasks as one
broadcast of at most `block_bytes` of text.  A larger benchmark goes in blocks of that size, one
pass over the documents for each, and what the passes found is merged by row.  Words are
compared by 64-bit hashes.

Defined results: null texts have no words; an item without words is never met; an item of fewer words
than a window is one window; an item with a null id covers words, but is not listed; items with equal
ids are one id; document ids may repeat or be null; columns in keep pass through, except where a
column of the result has the name; a text of any length is taken whole; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TERM_GAP, cut, drop, fresh, pieces, raw, slices, windows, windows_of, words

GRAM = 3
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
SPAN = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
MADE = {
    "n_words": "long", "spans": "array<struct<lo: long, hi: long>>", "items": "array<string>",
    "matches": "array<struct<item_id: string, item_start: long, doc_start: long, n_words: long>>",
}


class Probe:
    """The words of some items as one array of ranks, a zero behind each item; and the windows to search."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        self.ids = ids
        enc = [t.encode() for t in texts]
        off = np.cumsum([0, *map(len, enc)])
        h, _, _, first = words(np.frombuffer(b"".join(enc), np.uint8), off, True, TERM_GAP)
        size = np.diff(first)
        item = np.repeat(np.arange(len(size)), size)
        self.vocab = np.unique(h)
        place = np.arange(len(h)) + item
        self.seq = np.zeros(len(h) + len(size) + 1, np.int64)
        self.seq[place] = np.searchsorted(self.vocab, h) + 1
        self.item = np.zeros(len(self.seq), np.int64)
        self.item[place] = item
        self.start = first[:-1] + np.arange(len(size))
        self.end = self.start + size
        self.depth = int(size.max()) if len(size) else 0
        left = self.end[item] - place
        w = np.minimum(size[item], window)
        ok = left >= w
        self.q, self.w = place[ok], w[ok]
        # the first words of every search, and all runs of GRAM words of longer items: what a suffix must begin with
        heads = {}
        self.head = np.zeros(len(self.q), np.uint64)
        for g in range(1, GRAM + 1):
            at = self.w == g if g < GRAM else self.w >= g
            mine = windows(h, g)[(self.q - self.item[self.q])[at]]
            self.head[at] = mine
            if g == GRAM:
                hashes, where = windows_of(h, first, g)
                mine = hashes[size[item[where]] >= g]
            if len(mine):
                heads[g] = np.unique(mine)
        self.heads = heads
        self.bits = {g: 1 << max(16, min(22, int(4 * len(x)).bit_length() + 2)) for g, x in heads.items()}
        self.sieve = {}
        for g, x in heads.items():
            self.sieve[g] = np.zeros(self.bits[g], bool)
            self.sieve[g][(x & np.uint64(self.bits[g] - 1)).astype(np.int64)] = True

    def has(self, g: int, h: np.ndarray) -> np.ndarray:
        """The places of h whose value is a head."""
        near = np.flatnonzero(self.sieve[g][(h & np.uint64(self.bits[g] - 1)).astype(np.int64)])
        x = self.heads[g]
        return near[x[np.minimum(np.searchsorted(x, h[near]), len(x) - 1)] == h[near]]


class Shard:
    """The sparse suffix array of a block of texts: masked ranks with a gap behind each text."""

    def __init__(self, probe: Probe, h: np.ndarray, first: np.ndarray):
        self.first = first + np.arange(len(first))  # of each text, in the array with gaps
        begins, inside = np.zeros(len(h), bool), np.zeros(len(h), bool)
        heads = []
        for g in probe.heads:
            hashes, at = windows_of(h, first, g)
            hit = probe.has(g, hashes)
            begins[at[hit]] = True
            for i in range(g):
                inside[at[hit] + i] = True
            heads.append(hashes[hit])
        at = np.flatnonzero(inside)
        self.order = np.zeros(0, np.int64)
        if not len(at):
            return
        self.heads = np.unique(np.concatenate(heads))
        text = np.searchsorted(first, np.arange(len(h)), "right") - 1
        self.m = np.zeros(len(h) + len(first) + 1, np.int64)
        rank = np.minimum(np.searchsorted(probe.vocab, h[at]), len(probe.vocab) - 1)
        places = at + text[at]
        self.m[places] = np.where(probe.vocab[rank] == h[at], rank + 1, 0)
        starts = np.flatnonzero(begins)
        starts = starts + text[starts]
        # prefix doubling over the kept words
        r, k = self.m.copy(), 1
        top = len(r) - 1
        while k < probe.depth:
            key = r[places] * np.int64(len(r) + len(probe.vocab) + 2) + r[np.minimum(places + k, top)]
            kinds, new = np.unique(key, return_inverse=True)
            r[places] = new + 1
            if len(kinds) == len(places):
                break
            k *= 2
        self.order = starts[np.argsort(r[starts], kind="stable")]


def bisect(shard: Shard, seq: np.ndarray, q: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
    """Per query the first entry of order[lo:hi] not before (after: beyond) the words seq[q:q+size]."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        right = _before(shard, seq, shard.order[mid], q[live], size[live], after)
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
        live = live[lo[live] < hi[live]]
    return lo


def common(m: np.ndarray, seq: np.ndarray, p: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of the words seq[q:q+size] stand at p too; steps double, so long matches take few."""
    got, live, step = np.zeros(len(p), np.int64), np.arange(len(p)), 8
    while len(live):
        i = np.arange(step)
        span = np.minimum(size[live] - got[live], step)
        a = m[np.minimum((p[live] + got[live])[:, None] + i, len(m) - 1)]
        b = seq[np.minimum((q[live] + got[live])[:, None] + i, len(seq) - 1)]
        off = (a != b) | (i >= span[:, None])
        n = np.where(off.any(1), off.argmax(1), step)
        got[live] += n
        live = live[(n == step) & (got[live] < size[live])]
        step = min(2 * step, max(8, (1 << 20) // max(1, len(live))))
    return got


def _before(shard: Shard, seq: np.ndarray, p: np.ndarray, q: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
    n = common(shard.m, seq, p, q, size)
    whole = n == size
    a, b = shard.m[np.minimum(p + n, len(shard.m) - 1)], seq[np.minimum(q + n, len(seq) - 1)]
    return np.where(whole, after, a < b)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def search(probe: Probe, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    """n_words, spans, items and matches of each text of a shard."""
    texts = len(off) - 1
    h, _, _, first = words(data, off, True, TERM_GAP)
    n_words = pa.array(np.diff(first), pa.int64())
    nothing = lambda kind: pa.array([[]] * texts, pa.list_(kind))
    shard = Shard(probe, h, first) if len(h) and len(probe.q) else None
    if shard is None or not len(shard.order):
        return [n_words, nothing(SPAN), nothing(pa.string()), nothing(MATCH)]
    at = np.searchsorted(shard.heads, probe.head)
    here = np.flatnonzero(shard.heads[np.minimum(at, len(shard.heads) - 1)] == probe.head)
    q, w = probe.q[here], probe.w[here]
    none, every = np.zeros(len(q), np.int64), np.full(len(q), len(shard.order), np.int64)
    lo = bisect(shard, probe.seq, q, w, none, every, False)
    hi = bisect(shard, probe.seq, q, w, lo, every, True)
    on = np.flatnonzero(hi > lo)
    q, w, lo, hi = q[on], w[on], lo[on], hi[on]
    text_of = lambda p: np.searchsorted(shard.first, p, "right") - 1
    # equal windows have one range
    kinds, kind = np.unique(np.stack([lo, hi, w], 1), axis=0, return_inverse=True)
    kind = kind.ravel()
    n = kinds[:, 1] - kinds[:, 0]
    p = shard.order[_ranges(kinds[:, 0], n)]
    which = np.repeat(np.arange(len(kinds)), n)
    edge = np.zeros(len(shard.m) + 1, np.int64)
    np.add.at(edge, p, 1)
    np.add.at(edge, p + kinds[which, 2], -1)
    hit = np.cumsum(edge[:-1]) > 0
    flip = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    begin, end = flip[::2], flip[1::2]
    owner = text_of(begin)
    spans = _lists(texts, owner, [begin - shard.first[owner], end - shard.first[owner]], SPAN)
    # items of each text, by the kinds of windows that it has
    pair = np.unique(np.stack([text_of(p), which], 1), axis=0)
    of_kind = np.unique(np.stack([kind, probe.item[q]], 1), axis=0)
    head = np.searchsorted(of_kind[:, 0], np.arange(len(kinds) + 1))
    count = np.diff(head)[pair[:, 1]]
    found = np.unique(np.stack([np.repeat(pair[:, 0], count), of_kind[_ranges(head[pair[:, 1]], count), 1]], 1), axis=0)
    found = found[[probe.ids[i] is not None for i in found[:, 1].tolist()]] if len(found) else found
    items = _lists(texts, found[:, 0], [[probe.ids[i] for i in found[:, 1].tolist()]], pa.string())
    # longest matches: neighbours of each suffix's own place in its range
    size = probe.end[probe.item[q]] - q
    own = bisect(shard, probe.seq, q, size, lo, hi, False)
    left, right = shard.order[np.maximum(own - 1, lo)], shard.order[np.minimum(own, hi - 1)]
    a, b = common(shard.m, probe.seq, left, q, size), common(shard.m, probe.seq, right, q, size)
    where, n = np.where(a >= b, left, right), np.maximum(a, b)
    follows = np.zeros(len(q), bool)  # the same match, begun a word later
    follows[1:] = (q[1:] == q[:-1] + 1) & (where[1:] == where[:-1] + 1) & (n[1:] == n[:-1] - 1)
    keep = np.flatnonzero(~follows)
    owner = text_of(where[keep])
    keep = keep[np.argsort(owner, kind="stable")]
    owner, item = text_of(where[keep]), probe.item[q[keep]]
    matches = _lists(texts, owner, [[probe.ids[i] for i in item.tolist()], q[keep] - probe.start[item], where[keep] - shard.first[owner], n[keep]], MATCH)
    return [n_words, spans, items, matches]


def _lists(texts: int, owner: np.ndarray, columns: list, kind: pa.DataType) -> pa.Array:
    """A list for each text of the values that it owns; owner is sorted."""
    edges = pa.array(np.searchsorted(owner, np.arange(texts + 1)).astype(np.int32))
    if pa.types.is_struct(kind):
        values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    else:
        values = pa.array(columns[0], kind)
    return pa.ListArray.from_arrays(edges, values)


# ---------------------------------------------------------------- over DataFrames
def _pass(docs: DataFrame, keep: list[str], text_col: str, items: list, window: int) -> DataFrame:
    """One pass over docs with items that fit a broadcast: the columns in keep and MADE."""
    held = docs.sparkSession.sparkContext.broadcast(Probe([r[0] for r in items], [r[1] for r in items], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = held.value
        for b in pieces(batches, SHARD_BYTES, text):
            data, off = raw(b.column(text))
            for i, j in slices(off, SHARD_BYTES):
                own = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in keep], *search(probe, data[off[i] : off[j]], off[i : j + 1] - off[i])], [*keep, *MADE])

    text = fresh(docs, "leak_text")
    src = docs.select(*keep, F.col(text_col).alias(text))
    own = T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in MADE.items()))
    return src.mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], *own]))


def annotate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs (the columns in keep, else all) with n_words, spans (runs of hit words), items (ids of items
    with a window in the text, sorted as text), matches (longest verbatim matches, each where a shard has it), n_hit."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*MADE, "n_hit")]
    bench = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).where("t is not null").distinct()
    total = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes)
    if blocks <= 1:
        out = _pass(docs, keep, text_col, bench.orderBy("i", "t").collect(), window)
        return out.withColumn("items", F.array_sort(F.array_distinct("items"))).withColumn("n_hit", _covered(F.col("spans")))
    # many blocks: their findings meet by row
    bench = cut(bench.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))))
    row, text = fresh(docs, "leak_row"), fresh(docs, "leak_text")
    rows = cut(docs.select(*keep, F.col(text_col).alias(text), F.monotonically_increasing_id().alias(row)))
    found = None
    for b in range(blocks):
        items = bench.where(F.col("b") == b).orderBy("i", "t").select("i", "t").collect()  # at most about block_bytes
        one = _pass(rows, [row], text, items, window)
        found = one if found is None else found.unionByName(one)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    per = cut(found.groupBy(row).agg(F.max("n_words").alias("n_words"), flat("spans"), flat("items"), flat("matches")))
    drop(bench)
    per = per.withColumn("spans", F.array_sort("spans")).withColumn("items", F.array_sort(F.array_distinct("items")))
    per = per.withColumn("n_hit", _covered(F.col("spans"))).withColumn("spans", _merged(F.col("spans")))
    return rows.drop(text).join(per, row).drop(row)


def _covered(spans: Column) -> Column:
    """Words in sorted spans, overlapping ones counted once."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["upto"], s["hi"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(acc["upto"], s["lo"]))).cast("long").alias("n"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def _merged(spans: Column) -> Column:
    """Sorted spans without overlaps."""
    none = F.expr("cast(array() as array<struct<lo: long, hi: long>>)")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))))
        return F.when((F.size(acc) > 0) & (s["lo"] <= F.try_element_at(acc, F.lit(-1))["hi"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, none, step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", **options) -> DataFrame:
    """The documents without a window of any item, with the columns they had."""
    own = [f"own_{i}" for i in range(len(docs.columns))]  # no column of the search has such a name
    out = annotate(docs.toDF(*own), benchmark, window, text_col=own[docs.columns.index(text_col)], **options)
    return out.where("n_hit = 0").select(*own).toDF(*docs.columns)


def longest_matches(annotated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(item_id, n_words, item_start, document, doc_start): each item's longest verbatim match over all shards."""
    rows = annotated.select(F.col(id_col).alias("d"), F.explode("matches").alias("m")).where("m.item_id is not null")
    best = rows.groupBy("m.item_id").agg(F.max_by(F.struct("m.n_words", "m.item_start", F.col("d").alias("document"), "m.doc_start"), F.struct("m.n_words", -F.col("m.item_start"), "d", -F.col("m.doc_start"))).alias("b"))
    return best.select("item_id", "b.*")
