"""Near-duplicate embeddings by int8 tile products with error bounds.

Equal vectors of a label are folded into one first.  Unit vectors are quantised to int8 with one
scale each, and the exact norm of what quantisation lost is kept.  Tiles of vectors of one label
meet in pairs; the integer product of two tiles (exact in float32) and the bound
|x.y - s q.s' q'| <= |x^||e'| + |e||x^'| + |e||e'| tell which pairs can reach the threshold, and
only those are computed again in double precision.  A pair of tiles returns sums and a spanning
forest, one row per vector at most, never its pairs.  The work is quadratic in the different
vectors of a label, as the method is: n of them make (n / tile)**2 / 2 products of tiles, and
every vector is sent to n / tile of them.

Defined results: a vector that is null, zero or holds null or non-finite components, and one
without label or id, links with nothing and is its own component; vectors of different length
never link; repeated rows are separate vectors that link; an empty table gives an empty result;
extra columns are ignored by the search and pass through `near_duplicates` unless they clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, unite
from .vectors import distinct_vectors, unit, usable, vector_key

TILE = 2048
_EXACT_DIM = (1 << 24) // (127 * 127)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: int8 codes, scale, norm of the decoded vector, norm of the error."""
    scale = np.abs(x).max(1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    norm = lambda a: np.sqrt((a * a).sum(1))
    return q, scale, norm(back), norm(x - back)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows; float32 is exact while sums stay below 2**24."""
    kind = np.float32 if a.shape[1] <= _EXACT_DIM else np.float64
    return a.astype(kind) @ b.astype(kind).T


def linked_pairs(xa, qa, xb, qb, threshold: float, same: bool):
    """Blocks (i, j) of index arrays with cosine >= threshold; for a tile with itself i < j."""
    (ca, sa, na, ea), (cb, sb, nb, eb) = qa, qb
    step = 512
    for lo in range(0, len(xa), step):
        s = slice(lo, lo + step)
        near = product(ca[s], cb) * sa[s, None] * sb[None]
        bound = na[s, None] * eb[None] + ea[s, None] * nb[None] + ea[s, None] * eb[None] + 1e-6
        i, j = np.nonzero(near + bound >= threshold)
        i = i + lo
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            ii, jj = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok = np.einsum("ij,ij->i", xa[ii], xb[jj]) >= threshold
            yield ii[ok], jj[ok]


def tile_links(codes_a, codes_b, threshold: float):
    """Of two tiles given as (rep, cnt, unit vectors): per linked vector its count of links and the
    smallest vector its links lead to inside these tiles."""
    (ra, wa, xa), (rb, wb, xb) = codes_a, codes_b or codes_a
    same = codes_b is None
    qa = quantise(xa)
    qb = qa if same else quantise(xb)
    rep = ra if same else np.concatenate([ra, rb])
    at = 0 if same else len(ra)
    links = np.zeros(len(rep), np.int64)
    root = np.arange(len(rep))
    for i, j in linked_pairs(xa, qa, xb, qb, threshold, same):
        np.add.at(links, i, wb[j])
        np.add.at(links, at + j, wa[i])
        root = unite(root, i, at + j)
    on = np.flatnonzero(links)
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, root[on], rep[on])
    return rep[on], links[on], least[root[on]]


def near_duplicates(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """emb with n_links, component_id and kept."""
    import pandas as pd

    added = ("n_links", "component_id", "kept")
    keep = [c for c in emb.columns if c not in added]
    d = emb.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("d"), F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    good = usable(F.col("v"), F.col("id")) & F.col("label").isNotNull()
    d = d.select("*", *vector_key("v"))
    reps = cut(distinct_vectors(d.where(good), ["label"]).withColumn("dim", F.size("v")))

    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).where("n > 1")
    packed = reps.join(sizes, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pairs = packed.select("label", "dim", "rep", "cnt", "v", "t", other.alias("o"))
    pairs = pairs.withColumn("a", F.least("t", "o")).withColumn("b", F.greatest("t", "o"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(pdf["v"].to_numpy()))
        rep, cnt = pdf["rep"].to_numpy(), pdf["cnt"].to_numpy()
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        side = pdf["t"].to_numpy()
        part = lambda m: (rep[m], cnt[m], x[m])
        left, right = part(side == a), part(side == b)
        if not len(left[0]) or not len(right[0]):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        r, n, root = tile_links(left, None if a == b else right, threshold)
        return pd.DataFrame({"rep": r, "links": n, "root": root})

    found = cut(pairs.groupBy("label", "dim", "a", "b").applyInPandas(run, "rep long, links long, root long"))
    per = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    info = reps.select("label", "h1", "h2", "rep", "cnt").join(per, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    info = cut(info.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    drop(found)
    out = d.where(good).join(info, ["label", "h1", "h2"], "left").select("d", "id", "n_links", "component_id")
    rest = d.where(~good).select("d", "id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = out.unionByName(rest)
    comp_id = F.coalesce("component_id", "id")
    return out.select(
        *[F.col("d")[c].alias(c) for c in keep],
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        comp_id.alias("component_id"),
        F.coalesce(F.col("id") == comp_id, F.lit(True)).alias("kept"),
    )
