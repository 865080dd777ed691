"""Exact repeated runs of words, found by level-wise doubling.

Asked for are all windows of `length` words that start in more than one place.  The lengths tried
are length/4, length/2 (rounded up) and length.  At the first length only places chosen by
content are looked at: of every window of `length` words, its first-level run of least hash, so
equal windows choose equal places and none is missed.  Runs that occur once fall away; places
that stay are extended to twice the length, to the left and to the right, and what is not
repeated that far bounds the windows that can still be; the windows that remain inside these
bounds are counted at the full length, and no candidates are left after that.  Each level moves
only what survived the one before, and counts are partial sums before any shuffle.

Equal texts are handled once: a text that occurs twice has all its windows repeated.  At the first
two lengths a key is a 64-bit hash of a word run (a chance match only keeps a candidate); what
is removed has 128 bits of its window in common with another, and texts are told apart by 128.

Defined results: null text has no words; a text of fewer than `length` words loses nothing;
repeated rows are repetitions of each other; ids may repeat or be null; only the id and the text
are read, whatever else the table has; a text of any length is one unit, taken whole; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, mix, pieces, raw, signed, slices, text_key, windows, words

NAMES = ["c", "n", "sha", "h", "pos", "lk", "rk"]
SIDE = np.uint64(0xA5A5A5A5A5A5A5A5)
SECOND = np.uint64(0x3C6EF372FE94F82B)


def levels(length: int) -> tuple[int, int, int]:
    half = -(-length // 2)
    return max(1, -(-half // 2)), half, length


def choose(h: np.ndarray, first: np.ndarray, length: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, place): every window of `length` words inside a text and the first-level run it chooses."""
    n = len(h) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = np.flatnonzero(text[:n] == text[length - 1 :])
    g = windows(h, base)
    # least of each run of k: blocks of doubling size, the leftmost wins ties
    k = length - base + 1
    low, at = g, np.arange(len(g))
    step = 1
    while step * 2 <= k:
        a, b = low[: len(low) - step], low[step:]
        right = b < a
        low, at = np.where(right, b, a), np.where(right, at[step:], at[: len(at) - step])
        step *= 2
    rest = k - step
    if rest:
        a, b = low[: len(low) - rest], low[rest:]
        at = np.where(b < a, at[rest:], at[: len(at) - rest])
    return ok, at[ok]


def survey(texts: DataFrame, length: int) -> DataFrame:
    """Of texts(c, text): a row (c, n, sha) for each text and (c, h, pos, lk, rk) for each chosen place."""
    base, half, _ = levels(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in pieces(batches, 2 << 20):
            keys = b.column("c").to_numpy()
            new = []
            for i, x in enumerate(keys.tolist()):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            b = b.take(pa.array(new, pa.int64()))
            data, off = raw(b.column("text"))
            keys = b.column("c").to_numpy()
            for i, j in slices(off):
                block, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                h, _, _, first = words(block, o)
                c = keys[i:j]
                m = j - i
                whole = [hashlib.sha256(b" ".join(block[x:y].tobytes().split())).hexdigest() for x, y in zip(o[:-1], o[1:], strict=True)]
                no = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.diff(first)), pa.array(whole), no, pa.nulls(m, pa.int32()), no, no], NAMES)
                _, place = choose(h, first, length, base)
                place = np.unique(place)
                if not len(place):
                    continue
                text = np.searchsorted(first, place, "right") - 1
                g, w = windows(h, base), windows(h, half)
                lead = place - (half - base)
                lk = np.where(lead >= first[text], w[np.clip(lead, 0, len(w) - 1)], np.uint64(0))
                rk = np.where(place + half <= first[text + 1], w[np.clip(place, 0, len(w) - 1)] ^ SIDE, np.uint64(0))
                k = len(place)
                yield pa.RecordBatch.from_arrays([pa.array(c[text]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.array(signed(g[place])), pa.array((place - first[text]).astype(np.int32)), pa.array(signed(lk)), pa.array(signed(rk))], NAMES)

    return texts.mapInArrow(run, "c long, n long, sha string, h long, pos int, lk long, rk long")


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """The values of a key that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("n_")).where("n_ > 1").select(*key)


def candidates(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(h, h2, c, s): windows of full length whose chosen place survived; texts(c, text), places(c, ps)."""
    base, half, _ = levels(length)
    reach = half - base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column("text"))
            for i, j in slices(off):
                block, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                h, _, _, first = words(block, o)
                if len(h) < length:
                    continue
                left, right = np.zeros(len(h), bool), np.zeros(len(h), bool)
                there = np.zeros(len(h), bool)
                for t, ps in enumerate(b.column("ps").slice(i, j - i).to_pylist()):
                    at = np.array(ps, np.int64)
                    p = first[t] + (at >> 2)
                    there[p], left[p], right[p] = True, (at & 1) > 0, (at & 2) > 0
                s, a = choose(h, first, length, base)
                o_ = a - s
                ok = there[a] & (left[a] | (o_ < reach)) & (right[a] | (length - base - o_ < reach))
                s = s[ok]
                text = np.searchsorted(first, s, "right") - 1
                c = b.column("c").slice(i, j - i).to_numpy()
                two = windows(mix(h ^ SECOND), length, 14)[s]
                yield pa.RecordBatch.from_arrays([pa.array(signed(windows(h, length)[s])), pa.array(signed(two)), pa.array(c[text]), pa.array((s - first[text]).astype(np.int32))], ["h", "h2", "c", "s"])

    return texts.join(places, "c").mapInArrow(run, "h long, h2 long, c long, s int")


def remove(texts: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """(c, n_removed, kept): texts(c, text) without the words that windows at starts(c, ss) cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                out, gone = [], []
                for text, ss in zip(part.column("text").to_pylist(), part.column("ss").to_pylist(), strict=True):
                    w = text.encode().split()
                    edge = np.zeros(len(w) + 1, np.int32)
                    s = np.array(ss, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + length, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    out.append(b" ".join([w[k] for k in np.flatnonzero(keep)]).decode())
                    gone.append(int(len(w) - keep.sum()))
                yield pa.RecordBatch.from_arrays([part.column("c"), pa.array(gone, pa.int64()), pa.array(out, pa.string())], ["c", "n_removed", "kept"])

    return texts.join(starts, "c").mapInArrow(run, "c long, n_removed long, kept string")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id_col, c) and (c, text) of docs; c: a key of each different text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    c = text_key(docs, t).alias("c")
    return docs.select(F.col(id_col), c), docs.select(c, t.alias("text"))


def only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """texts whose c is in keys: sent around if they are counted to be few, else joined by a shuffle."""
    keys = keys.distinct()
    return texts.join(F.broadcast(keys) if keys.count() <= 500_000 else keys, "c", "left_semi")


def dedup(texts: DataFrame, length: int = 35) -> DataFrame:
    """Of texts(c, text) a row per different text: c, n_words, n_removed, kept (the text without the
    repeated runs, words joined by one space; null where nothing is removed), kept_sha256."""
    seen = cut(survey(texts, length))
    anchors = seen.where("h is not null").select("c", "h", "pos", "lk", "rk")
    # first level
    more = cut(repeated(anchors, "h"))  # a table of its own: Spark can then split the join's hot keys
    alive = cut(anchors.join(more, "h").select("c", "pos", "lk", "rk").distinct())
    # second level, to the left and to the right
    both = alive.select(F.explode(F.array("lk", "rk")).alias("k")).where("k <> 0")
    twice = cut(repeated(both, "k"))
    l2 = alive.join(twice.select(F.col("k").alias("lk"), F.lit(1).alias("l")), "lk", "left")
    flagged = l2.join(twice.select(F.col("k").alias("rk"), F.lit(2).alias("r")), "rk", "left")
    flags = F.coalesce("l", F.lit(0)) + F.coalesce("r", F.lit(0))
    flagged = flagged.where(flags > 0).select("c", (F.col("pos") * 4 + flags).alias("p"))
    places = cut(flagged.groupBy("c").agg(F.collect_list("p").alias("ps")))  # as many as a text has places
    # full length
    found = cut(candidates(only(texts, places.select("c")), places, length))
    met = cut(repeated(found, "h", "h2"))
    hits = found.join(met, ["h", "h2"]).select("c", "s").distinct()
    many = texts.select("c").groupBy("c").agg(F.count("*").alias("m")).where("m > 1").select("c")
    starts = cut(hits.groupBy("c").agg(F.collect_list("s").alias("ss")).join(many, "c", "left_anti"))
    gone = cut(remove(only(texts, starts.select("c")), starts, length).dropDuplicates(["c"]))
    per = seen.where("n is not null").select("c", "n", "sha").dropDuplicates(["c"])
    per = per.join(gone, "c", "left").join(many.withColumn("all", F.lit(True)), "c", "left")
    every = F.coalesce("all", F.lit(False)) & (F.col("n") >= length)
    kept = F.when(every, F.lit("")).otherwise(F.col("kept"))
    out = per.select("c", F.col("n").alias("n_words"), F.when(every, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), kept.alias("kept"), F.when(kept.isNull(), F.col("sha")).otherwise(F.sha2(kept.cast("binary"), 256)).alias("kept_sha256"))
    drop(alive, more, twice, found, met)
    return out


def annotate(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256), one row per row of docs."""
    keyed, texts = keyed_texts(docs, id_col, text_col)
    per = cut(dedup(texts, length).drop("kept"))
    return keyed.join(per, "c").select(id_col, "n_words", "n_removed", "kept_sha256")
