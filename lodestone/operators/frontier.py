"""Path roll-ups: the frontier of a weighted path tree.

Keys are cut into segments.  The adaptive view walks chains of single children and stops at the
first node that branches; a key that ends on the way is a leaf row.  The fixed view stops at a
depth.

The tree is never spelled out.  Keys that share the first segment below the prefix are a run, and a run has
one chain: its longest key in order (no other continues it) is the chain's guide, and where another key
leaves the guide earliest, the chain ends.  So three aggregations over the distinct keys (guides, chain ends,
rows) give the view; a key is written once, not once for each of its ancestors, and runs meet
keys in a join that can be split, so a run may hold any share of the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import under_prefix
from .rank import least
from .rounds import settled

LEAF, GROUP = "class", "package"
FEW_RUNS = 100_000


def _cut(sep: str) -> Column:
    return F.split("key", "[" + sep + "]" if sep != "\\" else "\\\\", -1)


def _shared(a: str, b: str) -> Column:
    """How many first segments two keys share."""
    return F.expr(f"coalesce(cast(array_position(transform(sequence(1, least(size({a}), size({b}))), i -> {a}[i - 1] <> {b}[i - 1]), true) as int), 0)")


def _common(a: str, b: str) -> Column:
    at = _shared(a, b)
    return F.when(at == 0, F.least(F.size(a), F.size(b))).otherwise(at - 1)


def placed(keys: DataFrame, key: str, weight: Column | None = None, sep: str = ".", prefix: str = "", depth: int | None = None, by: list[str] | None = None) -> DataFrame:
    """by, key, segs, weight, upto of the keys below the prefix: a key of more than upto segments belongs to the
    group of its first upto ones; one of upto at most is a leaf (one of exactly upto both); null: a leaf in no group."""
    by = list(by or [])
    src = keys.where(under_prefix(F.col(key), prefix, sep))
    src = src.groupBy(*by, F.col(key).alias("key")).agg(F.sum(weight if weight is not None else F.lit(1)).alias("weight"))
    src = src.withColumn("segs", _cut(sep))
    sd = len(prefix.split(sep)) if prefix else 0
    if depth is not None:
        return src.withColumn("upto", F.lit(sd + depth))
    src = settled(src.withColumn("run", F.slice("segs", 1, sd + 1)))
    guides = settled(src.groupBy(*by, "run").agg(F.max("segs").alias("guide"), F.count("*").alias("n")))
    few = guides.count() <= FEW_RUNS
    with_runs = lambda t: src.join(F.broadcast(t) if few else t, [*by, "run"], "left")
    # of a run with more than one key: the least number of segments that a key shares with the guide before it leaves it
    apart = with_runs(guides.where("n > 1").drop("n")).where("guide is not null").select(*by, "run", "segs", "guide").withColumn("c", _common("segs", "guide"))
    ends = settled(apart.where("c < size(segs) and c > 0").groupBy(*by, "run").agg(F.min("c").alias("upto")))
    out = with_runs(ends.where(F.col("upto") > sd))
    return out.drop("run")


def frontier(keys: DataFrame, key: str, weight: Column | None = None, sep: str = ".", prefix: str = "", depth: int | None = None, by: list[str] | None = None, samples: int = 0) -> DataFrame:
    """by, path, kind (class or package), count and sort columns segs, rank of the view.

    depth None: adaptive; N: groups exactly N levels below the prefix, leaves above or at it.
    samples: also samples, the first so many keys of a group in segment order (leaves have none)."""
    by = list(by or [])
    at = placed(keys, key, weight, sep, prefix, depth, by)
    sd = len(prefix.split(sep)) if prefix else 0
    at = settled(at) if samples else at
    size = F.size("segs")
    leaf = (F.col("upto").isNull() | (size <= F.col("upto"))) & (size >= max(sd, 1))
    group = size >= F.col("upto")
    # one pass: a key adds to its group, to its own leaf, or to both
    parts = F.array(
        F.when(leaf, F.struct(F.col("segs").alias("segs"), F.lit(0).alias("rank"), F.lit(1).alias("below"))),
        F.when(group, F.struct(F.slice("segs", F.lit(1), F.col("upto")).alias("segs"), F.lit(1).alias("rank"), (size > F.col("upto")).cast("int").alias("below"))),
    )
    rows = at.select(*by, "weight", F.explode(F.filter(parts, lambda r: r.isNotNull())).alias("r"))
    tree = rows.groupBy(*by, F.col("r.segs").alias("segs"), F.col("r.rank").alias("rank")).agg(F.sum("weight").alias("count"), F.max("r.below").alias("below")).where("below = 1")
    if depth is not None:
        tree = tree.where(F.size("segs") >= max(sd, 1))
    out = tree.select(*by, F.array_join("segs", sep).alias("path"), F.when(F.col("rank") == 0, LEAF).otherwise(GROUP).alias("kind"), "count", "segs", "rank")
    if not samples:
        return out
    some = _samples(at, samples, sep, by).groupBy(*by, "path").agg(F.array_sort(F.collect_list(F.struct("nr", "sample"))).alias("all"))  # at most samples each
    some = some.select(*by, "path", F.lit(GROUP).alias("kind"), F.transform("all", lambda s: s["sample"]).alias("samples"))
    return out.join(some, [*by, "path", "kind"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def in_order(tree: DataFrame, sort: str = "name", by: list[str] | None = None) -> DataFrame:
    """By name: segment by segment, leaf before group; by count: largest first, then the path's text."""
    by = list(by or [])
    keys = ["segs", "rank"] if sort == "name" else [F.desc("count"), "path", "rank"]
    return tree.orderBy(*by, *keys)


def _samples(at: DataFrame, n: int, sep: str, by: list[str]) -> DataFrame:
    inside = at.where(F.size("segs") >= F.col("upto")).select(*by, F.array_join(F.slice("segs", F.lit(1), F.col("upto")), sep).alias("path"), "segs", F.col("key").alias("sample"))
    return least(inside, [*by, "path"], ["segs"], n).select(*by, "path", "sample", "nr")


def samples(keys: DataFrame, key: str, n: int, sep: str = ".", prefix: str = "", depth: int | None = None, by: list[str] | None = None) -> DataFrame:
    """by, path, sample, nr: the first n keys at or below each group of the view, in segment order.

    (A group of fixed depth that only one key names, and none continues, is no group: see frontier.)"""
    by = list(by or [])
    at = settled(placed(keys, key, None, sep, prefix, depth, by))
    real = at.where(F.size("segs") > F.col("upto")).select(*by, F.array_join(F.slice("segs", F.lit(1), F.col("upto")), sep).alias("path")).distinct()
    return _samples(at, n, sep, by).join(real, [*by, "path"], "left_semi")
