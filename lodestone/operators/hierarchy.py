"""Type hierarchy: direct relations, and closures in rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import forget, settled

RELATIONS = ["class", "extends", "implements", "sub", "impl"]


def direct(classes: DataFrame, name: str) -> DataFrame:
    """dex, relation, class of a type: itself, what it extends and implements, what extends and implements it.

    classes: dex, class, super, interfaces."""
    own = classes.where(F.col("class") == name)
    parts = [
        own.select("dex", F.lit("class").alias("relation"), "class"),
        own.where(F.col("super").isNotNull()).select("dex", F.lit("extends").alias("relation"), F.col("super").alias("class")),
        own.select("dex", F.lit("implements").alias("relation"), F.explode("interfaces").alias("class")),
        classes.where(F.col("super") == name).select("dex", F.lit("sub").alias("relation"), "class"),
        classes.where(F.array_contains("interfaces", name)).select("dex", F.lit("impl").alias("relation"), "class"),
    ]
    return reduce(DataFrame.unionByName, parts)


def relation_rank():
    return F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("relation"))


def closure(edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """child, ancestor, depth: every ancestor with its least distance, at most max_depth hops.

    edges: child, parent (supers and interfaces alike).  Each round goes one hop up from the pairs
    that the last one found and keeps those that are new, so a pair is found once however many
    paths lead to it, and cycles end by themselves."""
    up = edges.select("child", "parent").distinct()
    new = settled(up.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    found, parts = new, [new]
    up = up.select(F.col("child").alias("ancestor"), "parent")
    for depth in range(2, max_depth + 1):
        step = new.join(up, "ancestor").select("child", F.col("parent").alias("ancestor")).distinct()
        new = settled(step.join(found, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        found = found.unionByName(new)
        parts.append(new)
    return _joined(parts)


def _joined(parts: list[DataFrame]) -> DataFrame:
    """What all rounds found, in one table; those of the rounds go."""
    out = settled(reduce(DataFrame.unionByName, parts))
    forget(*parts)
    return out


def subtypes(edges: DataFrame, top: str, max_depth: int = 64) -> DataFrame:
    """class, depth of everything below a type; a frontier of new names a round, so cycles end by themselves."""
    down = edges.select(F.col("parent").alias("class"), "child").distinct()
    new = settled(down.where(F.col("class") == top).select(F.col("child").alias("class"), F.lit(1).alias("depth")))
    found, parts = new, [new]
    for depth in range(2, max_depth + 1):
        step = new.join(down, "class").select(F.col("child").alias("class")).distinct()
        new = settled(step.join(found, "class", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        found = found.unionByName(new)
        parts.append(new)
    return _joined(parts)


def assignable(pairs: DataFrame, closed: DataFrame, top: str = "java/lang/Object") -> DataFrame:
    """pairs (sub, sup: names, or descriptors of arrays) with ok: whether sub can stand where sup is asked for.

    A type is itself, all that lies above it in closed (child, ancestor), and the top unless it is
    primitive.  Arrays of references follow their elements, dimension by dimension; arrays of
    primitives are only themselves."""
    depth = lambda c: F.length(F.regexp_extract(c, r"^(\[*)", 1))
    dims = F.least(depth("sub"), depth("sup"))
    name = lambda c: F.when(F.col(c).rlike("^L.*;$") & (F.col("_dims") > 0), F.expr(f"substring({c}, 2, length({c}) - 2)")).otherwise(F.col(c))
    peeled = pairs.select("sub", "sup", F.struct("sub", "sup").alias("_pair"), dims.alias("_dims"))
    peeled = peeled.select("_pair", "_dims", *[F.expr(f"substring({c}, _dims + 1)").alias(c) for c in ("sub", "sup")])
    simple = lambda c: F.col(c).rlike("^[IZBSCJFDV]$")
    peeled = peeled.withColumn("_plain", simple("sub") | simple("sup"))
    peeled = peeled.select("_pair", "_dims", "_plain", name("sub").alias("sub"), name("sup").alias("sup"))
    # an array reaches the top, and above it in closed there is nothing else; L..; is the name of an element
    known = closed.select(F.col("child").alias("sub"), F.col("ancestor").alias("sup"), F.lit(True).alias("_above")).distinct()
    got = peeled.join(known, ["sub", "sup"], "left")
    same, array = F.col("sub") == F.col("sup"), F.col("sub").startswith("[")
    ok = same | (~F.col("_plain") & ((F.col("sup") == top) | (~array & F.coalesce("_above", F.lit(False)))))
    return got.select("_pair.sub", "_pair.sup", ok.alias("ok"))


def reachable(start: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """name, round: names reached from start(name) over edges(src, dst) in at most so many rounds."""
    seen = start.select("name").distinct().withColumn("round", F.lit(0))
    new = seen
    for k in range(1, rounds + 1):
        step = new.join(edges, new["name"] == edges["src"]).select(F.col("dst").alias("name")).distinct()
        new = settled(step.join(seen, "name", "left_anti").withColumn("round", F.lit(k)))
        seen = seen.unionByName(new)
    return seen
