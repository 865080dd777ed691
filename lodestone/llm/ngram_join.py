"""N-gram Jaccard join with signature trees.

A text is the set of its word n-grams; equal sets are one class.  Two classes of Jaccard
similarity >= t share a token among the first |s| - ceil(t|s|) + 1 of each in any one order of
tokens, so classes are brought together by those prefix tokens, and no link is lost.  The order
puts tokens last that a count sketch of the whole corpus (2**22 counters, bounded) finds in many
texts, then goes by hash: passages that many documents share hardly ever bring them together.

Classes that share a token form a group (tokens with the same classes form one).  A group is cut
into blocks, and a block is joined by a signature tree: leaves hold the bitmap of a class's
tokens, nodes the OR (and AND) of their children's bitmaps and the range of their sizes.  A dual
traversal drops node pairs whose largest possible overlap is too small, and pairs that already
hang together; what is left is verified on the whole sets.  A block returns a spanning forest.

Classes whose prefix is largely shared are joined first, round by round, to grow components: each
round takes one class a component and its largest group.  That only adds verified links early.
Then every group in which two components still meet is joined completely: cut by size, in all
pairs of blocks, classes of one component together.  There the trees first run on bitmaps alone
(half a byte to one byte a token), and only the classes they cannot part are fetched and
verified.  This last step alone is complete; the rounds before leave it little.

Defined results: null or wordless texts have n_shingles 0 and are their own component; rows with
a null id link with nothing; fewer than n words are one n-gram; repeated rows share a component;
a text of any length is one set, whole; only the id and the text are read of a table, whatever else it has; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UnionFind, broadcast_if_small, components, cut, drop, groups_of, keys_of, mix, raw, signed, slices, sum_blobs, words, workers

SKETCH = 1 << 22
PARTS = 64
BLOCK = 512
TOKENS = 4 << 20  # of the sets of a block
FANOUT = 8
ROUNDS = 5


def need_of(n: int, num: int, den: int) -> int:
    """ceil(num/den * n)."""
    return -(-num * n // den)


# ---------------------------------------------------------------- tokens
def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Per text the distinct 63-bit hashes of its n-grams, sorted."""
    h, _, _, first = words(data, offsets, lower=True)
    m = keys_of(n, 13)
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        grams += h[i : i + len(grams)] * m[i]
    grams = mix(grams) >> np.uint64(1)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            out.append(mix((h[a:b] * m[: b - a]).sum(keepdims=True) + np.uint64(b - a)) >> np.uint64(1))
        else:
            out.append(grams[:0])
    return out


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Twice 63 bits of the whole set."""
    if not len(s):
        return 0, 0
    a, b = mix(s).sum(keepdims=True), mix(s ^ np.uint64(0x5DEECE66D)).sum(keepdims=True)
    x, y = (mix(np.concatenate([a + mix(b + np.uint64(len(s))), b ^ mix(a)])) >> np.uint64(1)).tolist()
    return x, y


def sketch_slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(SKETCH - 1)).astype(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each token's hash, in 4 to 8 bits a token."""
    width = max(64, 1 << (4 * len(s) - 1).bit_length())
    on = np.zeros(width, np.uint8)
    on[(s >> np.uint64(20) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(on).tobytes()


def digest(docs: DataFrame, n: int) -> DataFrame:
    """(id, n, c, c2, sig) per document, and per partition the token counts of the sketch in `sums`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names, lane = ["id", "n", "c", "c2", "sig", "part", "lane", "sums"], TaskContext.get().partitionId()
        count = np.zeros(SKETCH, np.int32)
        seen: set[tuple[int, int]] = set()
        for b in batches:
            data, off = raw(b.column("text"))
            for i, j in slices(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
                kinds = [class_of(s) for s in sets]
                sigs: list[bytes | None] = []
                fresh = []
                for c, s in zip(kinds, sets, strict=True):
                    if len(s) and c not in seen:
                        seen.add(c)
                        fresh.append(s)
                        sigs.append(bitmap(s))
                    else:
                        sigs.append(None)  # an equal set of this task has it
                if fresh:
                    np.add.at(count, sketch_slot(np.concatenate(fresh)), 1)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([c[k] for c in kinds], pa.int64()) for k in (0, 1)), pa.array(sigs, pa.binary()), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names)
        step = SKETCH // PARTS
        low = np.minimum(count, 255).astype(np.uint8)
        for p in range(PARTS if count.any() else 0):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary()), pa.array([p], pa.int32()), pa.array([lane], pa.int32()), pa.array([low[p * step : (p + 1) * step].tobytes()], pa.binary())], names)

    return docs.mapInArrow(run, "id long, n long, c long, c2 long, sig binary, part int, lane int, sums binary")


def heavy_slots(digests: DataFrame) -> np.ndarray:
    """The slots of the sketch that stand out: a packed bit each."""
    step = SKETCH // PARTS
    parts = sum_blobs(digests.where("part is not null").select("part", "lane", "sums"), ["part"], "u1")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(x).sum() for x in b.column("sums").to_pylist()], pa.float64())], ["total"])

    mean = (parts.mapInArrow(totals, "total double").agg(F.sum("total")).first()[0] or 0) / SKETCH
    limit = mean + 4 * mean**0.5 + 4

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(np.frombuffer(x) >= limit).tobytes() for x in b.column("sums").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(bits, pa.binary())], ["part", "bits"])

    out = np.zeros(SKETCH // 8, np.uint8)
    for r in parts.mapInArrow(mark, "part int, bits binary").collect():  # half a megabyte in all
        out[r.part * step // 8 : (r.part + 1) * step // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    drop(parts)
    return out


def one_class(digests: DataFrame) -> tuple[DataFrame, set[int]]:
    """digests with a c that stands for one set alone, and the c that two sets share by chance (n*n / 2**64
    of n sets): those sets go by c2, so that 126 bits decide."""
    per = digests.where("c is not null").groupBy("c").agg(F.min("c2").alias("lo"), F.max("c2").alias("hi"))
    clash = [r.c for r in per.where("lo <> hi").select("c").collect()]
    own = F.when(F.col("c").isin(clash), F.col("c2")).otherwise(F.col("c")) if clash else F.col("c")
    return digests.withColumn("c", own), set(clash)


def prefixes(docs: DataFrame, heavy, clash: set[int], n: int, num: int, den: int) -> DataFrame:
    """(token, c): the prefix tokens of every class; each task reports a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(heavy.value).astype(bool)
        seen: set[int] = set()
        for b in batches:
            data, off = raw(b.column("text"))
            for i, j in slices(off):
                tokens, owner, size = [], [], []
                for s in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n):
                    if not len(s):
                        continue
                    c, c2 = class_of(s)
                    c = c2 if c in clash else c
                    if c in seen:
                        continue
                    seen.add(c)
                    k = len(s) - need_of(len(s), num, den) + 1
                    flag = late[sketch_slot(s)]
                    light = s[~flag]
                    if len(light) < k:
                        light = np.concatenate([light, s[flag][: k - len(light)]])
                    tokens.append(light[:k])
                    owner.append(c)
                    size.append(k)
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.repeat(np.array(owner, np.int64), size))], ["token", "c"])

    return docs.mapInArrow(run, "token long, c long")


def token_sets(texts: DataFrame, n: int) -> DataFrame:
    """(c, n, tokens) of texts(id, c, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column("text"))
            for i, j in slices(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
                yield pa.RecordBatch.from_arrays([b.column("c").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["c", "n", "tokens"])

    return texts.select("c", "text").mapInArrow(run, "c long, n long, tokens binary")


# ---------------------------------------------------------------- the tree
class Tree:
    """Levels of nodes (OR, AND, least size, largest size); level 0 are the bitmaps of single classes."""

    def __init__(self, bitmaps: list[bytes], sizes: list[int]):
        width = 8 * min(map(len, bitmaps))
        self.levels = [[]]
        for x, n in zip(bitmaps, sizes, strict=True):
            bits, w = int.from_bytes(x, "big"), 8 * len(x)
            while w > width:  # fold in halves to the width that all have
                w //= 2
                bits = (bits >> w) | (bits & ((1 << w) - 1))
            self.levels[0].append((bits, bits, n, n))
        while len(self.levels[-1]) > FANOUT:
            below, level = self.levels[-1], []
            for i in range(0, len(below), FANOUT):
                kids = below[i : i + FANOUT]
                some, every = kids[0][0], kids[0][1]
                for k in kids[1:]:
                    some |= k[0]
                    every &= k[1]
                level.append((some, every, min(k[2] for k in kids), max(k[3] for k in kids)))
            self.levels.append(level)

    def children(self, level: int, i: int) -> range:
        return range(i * FANOUT, min((i + 1) * FANOUT, len(self.levels[level - 1])))

    def pairs(self, num: int, den: int, skip) -> Iterator[tuple[int, int]]:
        """Dual traversal: the pairs of classes that may link, those for which skip(i, j) holds left out."""
        top = len(self.levels) - 1
        stack = [(top, i, j) for i in range(len(self.levels[top])) for j in range(i, len(self.levels[top]))]
        while stack:
            level, i, j = stack.pop()
            nodes = self.levels[level]
            if level == 0:
                if i != j and not skip(i, j) and may_link(nodes[i], nodes[j], num, den):
                    yield i, j
            elif i == j:
                kids = self.children(level, i)
                stack += [(level - 1, a, b) for a in kids for b in kids if a <= b]
            elif may_link(nodes[i], nodes[j], num, den):
                stack += [(level - 1, a, b) for a in self.children(level, i) for b in self.children(level, j)]


def may_link(a, b, num: int, den: int) -> bool:
    """Whether some set below a and some set below b can be similar enough."""
    if den * a[3] < num * b[2] or den * b[3] < num * a[2]:
        return False
    most = min(a[3] - (a[1] & ~b[0]).bit_count(), b[3] - (b[1] & ~a[0]).bit_count())
    return most * (num + den) >= num * (a[2] + b[2])


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(a) + len(b) - common)


def join_block(sets: list[np.ndarray], num: int, den: int, forest: UnionFind, side: list[int] | None = None) -> None:
    """Unite all linked sets of a block in the forest.  side: only pairs of different sides are asked for."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
    tree = Tree([bitmap(sets[i]) for i in order], [len(sets[i]) for i in order])
    find = forest.find
    skip = lambda i, j: (side is not None and side[order[i]] == side[order[j]]) or find(order[i]) == find(order[j])
    for i, j in tree.pairs(num, den, skip):
        if similar(sets[order[i]], sets[order[j]], num, den):
            forest.union(order[i], order[j])


def open_of_block(bitmaps: list[bytes], sizes: list[int], comp: list[int], num: int, den: int, side: list[int] | None) -> tuple[list[tuple[int, int]], list[int]]:
    """What the bitmaps of a block leave possible between components: the pairs, if they are at most
    twice the classes; else no pairs but the classes that have any."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], bitmaps[i]))
    tree = Tree([bitmaps[i] for i in order], [sizes[i] for i in order])
    found: set[int] = set()
    pairs: list[tuple[int, int]] = []
    dense = False

    def skip(i: int, j: int) -> bool:
        p, q = order[i], order[j]
        return comp[p] == comp[q] or (side is not None and side[p] == side[q]) or (dense and p in found and q in found)

    for i, j in tree.pairs(num, den, skip):
        found |= {order[i], order[j]}
        pairs.append((order[i], order[j]))
        dense = dense or len(pairs) > 2 * len(sizes)
    return ([], sorted(found)) if dense else (pairs, [])


def join_blocks(rows: DataFrame, sets: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Edges (u, v) of the blocks of rows(keys, c, comp, side); comp: what already hangs together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for t in groups_of(batches, keys):
            c, comp, side = (t.column(x).to_pylist() for x in ("c", "comp", "side"))
            if len(set(comp)) < 2:
                continue
            forest, seen = UnionFind(len(c)), {}
            for i, x in enumerate(comp):
                forest.union(i, seen.setdefault(x, i))
            tokens = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            before = [forest.find(i) for i in range(len(c))]
            join_block(tokens, num, den, forest, side if len(set(side)) > 1 else None)
            for i in range(len(c)):
                if before[i] == i and (r := forest.find(i)) != i:
                    u.append(c[i])
                    v.append(c[r])
            if len(u) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    rows = rows.select(*keys, "c", "comp", "side")
    full = broadcast_if_small(rows, rows.count()).join(sets.select("c", F.col("tokens").alias("set")), "c")
    return full.repartition(workers(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def sift_blocks(rows: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Of rows(keys, c, comp, side, n, sig) what their block's bitmaps leave open: pairs (c, d), or of
    blocks with very many of them the rows of the classes concerned (d null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "c", "comp", "side", "d"]
        for t in groups_of(batches, keys):
            comp, side = t.column("comp").to_pylist(), t.column("side").to_pylist()
            if len(set(comp)) < 2:
                continue
            pairs, on = open_of_block(t.column("sig").to_pylist(), t.column("n").to_pylist(), comp, num, den, side if len(set(side)) > 1 else None)
            at = [p for p, _ in pairs] or on
            if at:
                part = t.select([*keys, "c", "comp", "side"]).take(pa.array(at)).combine_chunks()
                d = t.column("c").take(pa.array([q for _, q in pairs])).combine_chunks() if pairs else pa.nulls(len(at), pa.int64())
                cols = [part.column(x).combine_chunks() for x in names[:-1]]
                yield pa.RecordBatch.from_arrays([*cols, d], names)

    names = ", ".join(f"{k} long" for k in keys)
    return rows.repartition(workers(rows.sparkSession), *keys).sortWithinPartitions(*keys).select(*keys, "c", "comp", "side", "n", "sig").mapInArrow(run, f"{names}, c long, comp long, side int, d long")


def with_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("id").alias("c"), F.col("component").alias("comp")), "c", "left").withColumn("comp", F.coalesce("comp", "c"))


def with_few(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with one row a key of sums over them.  These are cut first: then the join has an
    exchange of its own, whose hot keys Spark can split, or none if they are counted to be few."""
    few = cut(few)
    return rows.join(broadcast_if_small(few, few.count()), on, how)


def unsettled(rows: DataFrame) -> DataFrame:
    """g and its number of classes, of the groups in which two components meet; rows: g, c, comp."""
    return rows.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("cnt")).where("lo < hi").select("g", "cnt")


def block_size(n: Column, block: int) -> Column:
    """Classes in a block whose largest set has n tokens."""
    return F.greatest(F.lit(2), F.least(F.lit(block), F.floor(F.lit(TOKENS) / n)))


def spread(key: str, count: Column, size: Column) -> Column:
    """A block number by hash, so many that a block has about `size` rows."""
    return F.pmod(F.xxhash64(F.lit(9), key), F.greatest(F.lit(1), F.ceil(count / size))).cast("long")


# ---------------------------------------------------------------- the join
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (75, 100), block: int = BLOCK) -> DataFrame:
    """(id_col, n_shingles, component_id), one row per row of docs."""
    num, den = threshold
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = cut(digest(src, n))
    digests, clash = one_class(made)
    heavy = spark.sparkContext.broadcast(heavy_slots(digests))
    per_doc = digests.where("part is null").select("id", "n", "c")
    classes = per_doc.where("n > 0 and id is not null").groupBy("c").agg(F.min("id").alias("rep"))

    # groups: classes that share a prefix token; tokens with the same classes are one group
    rows = prefixes(src.where("id is not null"), heavy, clash, n, num, den)
    shared = cut(rows.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"))
    hits = cut(rows.join(broadcast_if_small(shared, shared.count()), "token").distinct())
    lists = hits.groupBy("token").agg(F.count("*").alias("cnt"), F.bit_xor(F.xxhash64("c")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(4), "c")).alias("x2"))
    lists = lists.groupBy("cnt", "x1", "x2").agg(F.min("token").alias("g"), F.count("*").alias("tokens"))
    sized = per_doc.where("n > 0").groupBy("c").agg(F.first("n").alias("n"))
    groups = hits.join(lists.select(F.col("g").alias("token"), "cnt", "tokens"), "token").join(sized, "c")
    groups = cut(groups.select(F.col("token").alias("g"), "c", "cnt", "tokens", "n"))
    drop(hits)

    def sets_of(keys: DataFrame) -> DataFrame:
        """The whole sets of some classes, from their texts."""
        inside = cut(keys.select("c").distinct().join(classes, "c").select(F.col("rep").alias("id"), "c"))
        texts = src.join(F.broadcast(inside) if inside.count() <= 500_000 else inside, "id")
        return cut(token_sets(texts, n).join(inside.select("c"), "c", "left_semi").dropDuplicates(["c"]))

    # rounds over the classes that share a quarter of their prefix or more
    per_class = groups.groupBy("c").agg(F.sum("tokens").alias("tokens"), F.first("n").alias("n"))
    likely = cut(per_class.where(F.col("tokens") * (4 * den) >= F.col("n") * (den - num)).select("c"))
    sets = sets_of(likely)
    alike = cut(groups.join(likely, "c", "left_semi"))
    edges, labels, used = None, components(spark.createDataFrame([], "u long, v long")), spark.createDataFrame([], "g long")
    for _ in range(ROUNDS):
        now = with_components(alike.join(used, "g", "left_anti"), labels)
        all_ = cut(now.groupBy("g", "comp").agg(F.min("c").alias("c"), F.max("tokens").alias("tokens"), F.max("n").alias("n")))
        one = cut(with_few(all_, all_.groupBy("g").agg(F.count("*").alias("k"), block_size(F.max("n"), block).alias("size")).where("k > 1"), ["g"]))
        drop(all_)
        best = one.groupBy("c").agg(F.max(F.struct((F.col("tokens") * 32 >= F.col("n")).alias("strong"), "k", "g")).alias("m")).select(F.col("m.g").alias("g")).distinct()
        picked = cut(one.join(best, "g").withColumn("side", F.lit(0)).withColumn("b", spread("c", F.col("k"), F.col("size"))))
        more = cut(join_blocks(picked, sets, ["g", "b"], num, den))
        if more.isEmpty():
            drop(one, picked, more)
            break
        gain = more.count()
        both = more if edges is None else cut(edges.union(more))
        found = gain if edges is None else found + gain
        used = cut(used.union(picked.where(F.col("k") <= F.col("size")).select("g").distinct()))
        drop(one, picked, labels)
        edges, labels = both, components(both)
        if gain * 20 < found:  # what little is left the complete join finds as well
            break

    # all of it: wherever two components still meet.  Sizes that can link fall in the same or the next
    # size class, so each class goes to its own and the next one's part of the group
    now = with_components(groups.select("g", "c", "n"), labels)
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num + 1e-9))).cast("int")
    now = now.withColumn("g", F.explode(F.array(F.xxhash64("g", step), F.xxhash64("g", step + 1))))
    now = cut(now)
    whole, now = now, cut(with_few(now, unsettled(now).select("g"), ["g"]))
    drop(whole)
    # many parts now hold the same classes: one of them will do
    same = now.groupBy("g").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("c")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(4), "c")).alias("x2"))
    same = same.groupBy("k", "x1", "x2").agg(F.min("g").alias("g")).select("g")
    whole, now = now, cut(with_few(now, same, ["g"]))
    drop(whole)
    per = cut(now.groupBy("g", "comp").agg(F.count("*").alias("m"), F.max("n").alias("top")))
    per = with_few(per, per.groupBy("g").agg(block_size(F.max("top"), block).alias("size")), ["g"])
    mixed = per.where("m < size").groupBy("g").agg(F.sum("m").alias("rest"))
    parts = with_few(with_few(now, per, ["g", "comp"]), mixed, ["g"], "left")
    pure = F.col("m") >= F.col("size")
    parts = parts.withColumn("pure", F.when(pure, F.col("comp")))
    parts = parts.withColumn("b", F.when(pure, F.xxhash64("comp", spread("c", F.col("m"), F.col("size")))).otherwise(F.xxhash64(F.lit(-1), spread("c", F.coalesce("rest", F.lit(1)), F.col("size")))))
    parts = cut(parts.select("g", "b", "c", "comp", "pure", "n"))
    tops = cut(parts.groupBy("g", "b").agg(F.first("pure").alias("pure"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c1"), F.max("comp").alias("c2")))
    a = tops.select("g", F.col("b").alias("b1"), F.col("pure").alias("p1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("c1").alias("ca"), F.col("c2").alias("cb"))
    z = tops.select("g", F.col("b").alias("b2"), F.col("pure").alias("p2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("c1").alias("cc"), F.col("c2").alias("cd"))
    several = F.least("ca", "cc") < F.greatest("cb", "cd")
    pairs = a.join(z, "g").where((F.col("b1") <= F.col("b2")) & several & (den * F.col("hi1") >= num * F.col("lo2")) & (den * F.col("hi2") >= num * F.col("lo1")))
    pairs = pairs.select("g", "b1", "b2", F.explode(F.when(F.col("b1") == F.col("b2"), F.array("b1")).otherwise(F.array("b1", "b2"))).alias("b"))
    meet = pairs.join(parts, ["g", "b"]).withColumn("side", F.when(F.col("b1") == F.col("b2"), 0).when(F.col("b") == F.col("b1"), 1).otherwise(2))
    sigs = digests.where("sig is not null").select("c", "sig").dropDuplicates(["c"])
    keys = ["g", "b1", "b2"]
    left = cut(sift_blocks(meet.join(sigs, "c"), keys, num, den))
    two = left.where("d is not null").select(F.least("c", "d").alias("b1"), F.greatest("c", "d").alias("b2")).distinct()
    two = two.select(F.lit(0).cast("long").alias("g"), "b1", "b2", F.explode(F.array("b1", "b2")).alias("c")).withColumn("comp", F.col("c")).withColumn("side", F.lit(0))
    check = cut(left.where("d is null").select(*keys, "c", "comp", "side").distinct().unionByName(two))
    late = sets_of(check)
    last = cut(join_blocks(check, late, keys, num, den))
    if not last.isEmpty():
        both = last if edges is None else cut(edges.union(last))
        drop(labels)
        labels = components(both)

    comp = with_components(classes.select("c", "rep"), labels)
    smallest = comp.groupBy("comp").agg(F.min("rep").alias("component_id"))
    answer = comp.join(smallest, "comp").select("c", "component_id")
    known = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = cut(per_doc.join(answer, "c", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), known.alias("component_id")))
    drop(made, shared, groups, likely, alike, sets, late, edges, labels, now, parts, tops, left, check, last)
    return out
