"""Ranked lexical search by three phases over term-partitioned postings (TPUT).

One pass over the documents writes postings: a row holds, for one term, the documents of one part (a
few thousand of a task's documents, numbered by id), the term's count in each and their lengths.  Only
terms that some item asks for are kept; long lists are many rows, dealt out by term and slice.

Phase one takes the k best of every list; the sums of what an item's lists name are lower bounds, and
the k-th of them is its first bar.  Phase two divides the bar by the number of the item's lists and fetches
from every list all postings worth that share or more: a document in none of these cannot reach the bar.
The fetched postings meet by part and block of items, where sums are added in dense arrays; what a
list may still hide is bounded by its own share, so every document has an upper bound, and those
under the k-th lower bound fall away.  Phase three looks the candidates up in all lists of their item, which
gives exact scores.

Scores are 64-bit integers.  Nothing is sampled or cut off: what is left out is proven to be below the bar.
The items' terms are sent around while they are counted to be few, and joined by a shuffle beyond;
items go in blocks of at most about `item_block`, so no array grows with their number.  Terms
are told apart by 64-bit hashes.

Defined results: null texts have no terms and are not counted; items without terms have no rows; each row
of the items is ranked for itself, whatever its id; documents are rows, their ids may repeat or be null
(null last among equal scores); a text of any length is one document; other columns are not read;
empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TERM_GAP, cut, drop, groups_of, pieces, raw, signed, slices, words, workers

PART_DOCS = 8192
PART_POSTINGS = 1 << 20
FEW_TERMS = 1_000_000  # 8 MB
FEW_LISTS = 200_000
ONE = 1_000_000_000
POSTINGS = "t long, part long, k int, docs binary, tf binary, n binary, ids array<long>, sizes array<int>"


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms, first[d]: where those of text d begin)."""
    h, _, _, first = words(data, off, True, TERM_GAP)
    return h, first


def item_terms(items: DataFrame) -> DataFrame:
    """(item, t, c): how often each term stands in each of items(item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            data, off = raw(b.column("text"))
            h, first = terms(data, off)
            item = np.repeat(np.arange(b.num_rows), np.diff(first))
            order = np.lexsort((h, item))
            h, item = h[order], item[order]
            edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (item[1:] != item[:-1])])) if len(h) else np.zeros(0, np.int64)
            keys = b.column("item").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys[item[edge]]), pa.array(signed(h[edge])), pa.array(np.diff(np.append(edge, len(h))), pa.int64())], ["item", "t", "c"])

    return items.mapInArrow(run, "item long, t long, c long")


# ---------------------------------------------------------------- postings
class _Part:
    """Documents of a task until they are written."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.t: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.postings = 0

    def add(self, ids: list, h: np.ndarray, first: np.ndarray, vocab: np.ndarray | None) -> None:
        doc = np.repeat(np.arange(len(ids)), np.diff(first)) + len(self.ids)
        if vocab is None:
            vocab, at = np.unique(h, return_inverse=True)
        else:
            at = np.minimum(np.searchsorted(vocab, h), max(len(vocab) - 1, 0))
            ok = vocab[at] == h if len(vocab) else np.zeros(len(h), bool)
            doc, at = doc[ok], at[ok]
        key, tf = np.unique(doc * np.int64(max(len(vocab), 1)) + at, return_counts=True)
        self.sizes.append(np.diff(first))
        self.ids += ids
        self.doc.append(key // max(len(vocab), 1))
        self.t.append(vocab[key % max(len(vocab), 1)])
        self.tf.append(tf)
        self.postings += len(key)

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        """Documents numbered by id (null last), then a row for each term, and one for the documents."""
        n = len(self.ids)
        last = np.array([x is None for x in self.ids])
        by_id = np.lexsort((np.array([0 if x is None else x for x in self.ids], np.int64), last))
        number = np.empty(n, np.int64)
        number[by_id] = np.arange(n)
        sizes = np.concatenate(self.sizes)[by_id]
        doc, t, tf = number[np.concatenate(self.doc)], np.concatenate(self.t), np.concatenate(self.tf)
        order = np.lexsort((doc, t))
        doc, t, tf = doc[order], t[order], tf[order]
        at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        edges = np.append(at, len(t))
        k = len(at)
        cols = [pa.array(signed(t[at])), pa.array(np.full(k, part)), pa.array(np.diff(edges), pa.int32()), *(_packed(x, edges) for x in (doc, tf, sizes[doc] if len(doc) else doc))]
        names = [c.split()[0] for c in POSTINGS.split(", ")]
        yield pa.RecordBatch.from_arrays([*cols, pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32()))], names)
        one, no = lambda v, kind: pa.array([v], pa.list_(kind)), lambda kind: pa.nulls(1, kind)
        yield pa.RecordBatch.from_arrays([no(pa.int64()), pa.array([part]), pa.array([n], pa.int32()), no(pa.binary()), no(pa.binary()), no(pa.binary()), one([self.ids[i] for i in by_id.tolist()], pa.int64()), one(sizes.tolist(), pa.int32())], names)


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Runs of values as little-endian 32-bit numbers, a binary value each."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(values.astype("<u4"))])


def postings(docs: DataFrame, vocab: np.ndarray | None = None) -> DataFrame:
    """Of docs(id, text) the postings of the terms in vocab (sorted hashes; all if None) and, where t is null, the documents of each part."""
    held = None if vocab is None else docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base, made = _Part(), TaskContext.get().partitionId() << 24, 0
        for b in pieces(batches):
            data, off = raw(b.column("text"))
            ids = b.column("id").to_pylist()
            for i, j in slices(off, 4 << 20):
                part.add(ids[i:j], *terms(data[off[i] : off[j]], off[i : j + 1] - off[i]), held.value if held else None)
                if len(part.ids) >= PART_DOCS or part.postings >= PART_POSTINGS:
                    yield from part.rows(base + made)
                    part, made = _Part(), made + 1
        if part.ids:
            yield from part.rows(base + made)

    return docs.mapInArrow(run, POSTINGS)


class Score:
    """What one posting is worth before its term's weight, from the number of documents and of all their terms."""

    def __init__(self, documents: int, total: int):
        self.documents, self.total = documents, total

    def __call__(self, tf: bytes, n: bytes) -> np.ndarray:
        tf, n = (np.frombuffer(x, "<u4").astype(np.int64) for x in (tf, n))
        m = 25 + (75 * n * self.documents) // self.total
        return (ONE * tf) // (1000 * tf + 8 * m)

    def weight(self, df: Column) -> Column:
        return F.floor(1000 * F.log((2.0 * self.documents + 2) / (2 * df + 1))).cast("long")


def heads(lists: DataFrame, score: Score, k: int) -> DataFrame:
    """(t, part, doc, s): the k best postings of every row of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t, part, docs, tf, n in zip(*(b.column(c).to_pylist() for c in ("t", "part", "docs", "tf", "n")), strict=True):
                s = score(tf, n)
                best = np.argsort(-s, kind="stable")[:k]
                out += [(t, part, d, v) for d, v in zip(np.frombuffer(docs, "<u4")[best].tolist(), s[best].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([],) * 4)], ["t", "part", "doc", "s"])

    return lists.mapInArrow(run, "t long, part long, doc long, s long")


def kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(item, bar): the k-th largest value of each item; no row where it has fewer."""
    w = Window.partitionBy("item").orderBy(F.desc(value))
    return rows.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= k).where(F.col("r_") == k).select("item", F.col(value).alias("bar"))


# ---------------------------------------------------------------- phase two
FETCHED = "part long, block int, items array<long>, slots array<int>, cw array<long>, least array<long>, miss array<long>, bar array<long>, docs binary, s binary"


def fetch(rows: DataFrame, score: Score) -> DataFrame:
    """Of posting rows with the items that want them: the postings worth some item's share, best first."""
    names = [c.split()[0] for c in FETCHED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, worth = [], []
            for d, tf, n, least in zip(*(b.column(c).to_pylist() for c in ("docs", "tf", "n")), b.column("least").to_pylist(), strict=True):
                s = score(tf, n)
                best = np.argsort(-s, kind="stable")
                best = best[: int(np.searchsorted(-s[best], -min(least), "right"))]
                docs.append(np.frombuffer(d, "<u4")[best].tobytes())
                worth.append(s[best].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:-2]], pa.array(docs, pa.binary()), pa.array(worth, pa.binary())], names)

    return rows.mapInArrow(run, FETCHED)


def _sums(g: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, bar, low, high) of a part and block: a row of low and high for each item, a column for each document."""
    col = {c: g.column(c).to_pylist() for c in ("items", "slots", "cw", "least", "miss", "bar", "docs", "s")}
    docs = [np.frombuffer(x, "<u4").astype(np.int64) for x in col["docs"]]
    worth = [np.frombuffer(x, "<u4").astype(np.int64) for x in col["s"]]
    at = {s: i for i, s in enumerate(sorted({x for s in col["slots"] for x in s}))}
    width = 1 + max((int(d.max()) for d in docs if len(d)), default=-1)
    low, seen = np.zeros((len(at), width), np.int64), np.zeros((len(at), width), np.int64)
    hidden, bar, item = (np.zeros(len(at), np.int64) for _ in range(3))
    for r, (d, s) in enumerate(zip(docs, worth, strict=True)):
        for i, x, c, least, miss, b in zip(*(col[c][r] for c in ("items", "slots", "cw", "least", "miss", "bar")), strict=True):
            x = at[x]
            item[x], bar[x] = i, b
            hidden[x] += miss
            if m := int(np.searchsorted(-s, -least, "right")):
                low[x, d[:m]] += c * s[:m]
                seen[x, d[:m]] += miss
    seen *= -1
    seen += low
    seen += hidden[:, None]
    return item, bar, low, seen


def best_sums(fetched: DataFrame, k: int) -> DataFrame:
    """(item, part, doc, low): of every part the k largest sums of an item that reach the bar so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, ["part", "block"]):
            part = g.column("part")[0].as_py()
            item, bar, low, _ = _sums(g)
            out = [np.zeros((0, 4), np.int64)]
            for x in range(len(item)):
                on = np.argsort(-low[x], kind="stable")[:k]
                on = on[low[x, on] >= max(int(bar[x]), 1)]
                out.append(np.stack([np.full(len(on), item[x]), np.full(len(on), part), on, low[x, on]], 1))
            table = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(4)], ["item", "part", "doc", "low"])

    return fetched.sortWithinPartitions("part", "block").mapInArrow(run, "item long, part long, doc long, low long")


def candidates(fetched: DataFrame, k: int) -> DataFrame:
    """(item, part, doc): documents whose upper bound reaches the bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, ["part", "block"]):
            part = g.column("part")[0].as_py()
            item, bar, low, high = _sums(g)
            out = [np.zeros((0, 3), np.int64)]
            for x in range(len(item)):
                on = np.flatnonzero((high[x] >= max(int(bar[x]), 1)) & (low[x] > 0))
                # of those known exactly, no more than the k best count: they are numbered by id
                known = on[high[x, on] == low[x, on]]
                if len(known) > k:
                    worst = np.lexsort((known, -low[x, known]))[k:]
                    on = np.setdiff1d(on, known[worst], assume_unique=True)
                out.append(np.stack([np.full(len(on), item[x]), np.full(len(on), part), on], 1))
            table = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(3)], ["item", "part", "doc"])

    return fetched.sortWithinPartitions("part", "block").mapInArrow(run, "item long, part long, doc long")


# ---------------------------------------------------------------- phase three
def look_up(rows: DataFrame, score: Score) -> DataFrame:
    """Of posting rows with asked (item, doc, cw): (item, part, doc, worth) of those in the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for part, docs, tf, n, asked in zip(*(b.column(c).to_pylist() for c in ("part", "docs", "tf", "n", "asked")), strict=True):
                have, s = np.frombuffer(docs, "<u4").astype(np.int64), score(tf, n)
                want = np.array([(a["item"], a["doc"], a["cw"]) for a in asked], np.int64)
                at = np.minimum(np.searchsorted(have, want[:, 1]), len(have) - 1)  # lists are in order of number
                on = have[at] == want[:, 1]
                out += [(i, part, d, v) for i, d, v in zip(want[on, 0].tolist(), want[on, 1].tolist(), (want[on, 2] * s[at[on]]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([],) * 4)], ["item", "part", "doc", "worth"])

    return rows.mapInArrow(run, "item long, part long, doc long, worth long")


def _dealt(fetched: DataFrame) -> DataFrame:
    return fetched.repartition(workers(fetched.sparkSession), "part", "block")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", item_block: int = 256, finer: int = 4,
) -> DataFrame:
    """(item_col, rank, id_col, score): of each row of items its k documents of highest score above 0.

    finer: how many times lower than its bar divided by its lists an item's threshold is; more is fetched then,
    and fewer candidates are looked up.  The result is the same for any."""
    numbered = cut(items.select(F.col(item_col).alias("name"), F.col(item_text_col).alias("text"), F.monotonically_increasing_id().alias("item")))
    wants = cut(item_terms(numbered.select("item", "text")))
    asked = wants.select("t").distinct()
    vocab = None
    if asked.count() <= FEW_TERMS:
        vocab = np.sort(np.array([r.t for r in asked.collect()], np.int64).view(np.uint64))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = postings(src, vocab)
    if vocab is None:
        made = made.join(asked.withColumn("a_", F.lit(True)), "t", "left").where("a_ or t is null").drop("a_")
    # a list is cut in slices of 64 tasks' parts, so the longest lists lie in many places
    made = cut(made.withColumn("slice", F.shiftright("part", 30)), "t", "slice", parts=workers(docs.sparkSession))
    lists, parts = made.where("t is not null"), made.where("t is null")
    sums = parts.agg(F.sum(F.size(F.filter("sizes", lambda x: x > 0))).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    score = Score(sums.n or 0, max(sums.l or 0, 1))
    df = lists.groupBy("t").agg(F.sum("k").alias("df"))
    weighed = wants.join(df, "t").select("item", "t", (F.col("c") * score.weight(F.col("df"))).alias("cw")).where("cw > 0")
    weighed = cut(weighed)
    # phase one: the heads of all lists
    best = heads(lists, score, k)
    top = Window.partitionBy("t").orderBy(F.desc("s"), "part", "doc")
    best = cut(best.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k))
    sums = best.join(weighed, "t").groupBy("item", "part", "doc").agg(F.sum(F.col("cw") * F.col("s")).alias("low"))
    bar = kth(sums, "low", k)
    # phase two: every item's share of its bar
    limits = weighed.join(best.where("r = 1").select("t", F.col("s").alias("most")), "t").join(weighed.groupBy("item").agg(F.count("*").alias("m")), "item")
    limits = limits.join(bar, "item", "left").withColumn("bar", F.coalesce("bar", F.lit(0).cast("long")))
    limits = limits.withColumn("least", F.expr(f"(bar + cw * m * {finer} - 1) div (cw * m * {finer})"))
    limits = limits.withColumn("miss", F.greatest(F.lit(0), F.least(F.col("most"), F.col("least") - 1)) * F.col("cw"))
    blocks = -(-numbered.count() // item_block) or 1
    place = wants.select("item").distinct().withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    place = place.withColumn("slot", F.row_number().over(Window.partitionBy("block").orderBy("item")))
    list_ = lambda c, n=None: F.expr(f"transform(e, x -> x.{c})").alias(n or c)
    per = limits.join(place, "item").groupBy("t", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "item", "cw", "least", "miss", "bar"))).alias("e"))  # at most a block of items
    per = cut(per.select("t", "block", list_("item", "items"), list_("slot", "slots"), list_("cw"), list_("least"), list_("miss"), list_("bar")))
    few = weighed.count() <= FEW_LISTS
    fetched = fetch(lists.join(F.broadcast(per) if few else per, "t"), score)
    fetched = cut(fetched)
    # the second bar: the k-th largest sum of an item anywhere
    second = kth(best_sums(_dealt(fetched), k), "low", k)
    bars = place.join(second, "item").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bar"))).alias("bars"))  # a row for each block of items
    raised = fetched.join(F.broadcast(bars) if few else bars, "block", "left")
    raised = raised.withColumn("bar", F.when(F.col("bars").isNull(), F.col("bar")).otherwise(F.expr("transform(slots, (s, i) -> greatest(bar[i], coalesce(bars[s], 0)))"))).drop("bars")
    found = cut(candidates(_dealt(raised), k))
    # phase three: exact scores of the candidates
    wanted = found.join(F.broadcast(weighed) if few else weighed, "item").groupBy("t", "part").agg(F.collect_list(F.struct("item", "doc", "cw")).alias("asked"))
    exact = look_up(lists.join(wanted, ["t", "part"]), score).groupBy("item", "part", "doc").agg(F.sum("worth").alias("score"))
    exact = cut(exact)
    ids = exact.select("part", "doc").distinct().join(parts.select("part", "ids"), "part").select("part", "doc", F.element_at("ids", (F.col("doc") + 1).cast("int")).alias("id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "part", "doc")
    out = exact.join(ids, ["part", "doc"]).withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") > 0))
    out = cut(out.join(numbered.select("item", "name"), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    drop(numbered, wants, made, weighed, best, per, fetched, found, exact)
    return out
