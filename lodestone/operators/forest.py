"""Nesting: which class lies in which, as a forest.

A class says itself where it is enclosed (evidence), or its name does: the longest part before a `$` that
is a class.  What a class says counts first, but only if what it names exists.  Evidence can be wrong, so
chains of outer classes may close: a cycle is cut before its least name, and every class has one root.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import forget, settled

SAID, NAMED, CUT = "said", "named", "cut"


def outers(names: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """name, outer, how: names(name), evidence(name, outer) -> the enclosing class of each name; how is said,
    named, or null where there is none.  A `$` before `/` is part of a package's name."""
    known = names.select("name").distinct()
    there = known.withColumnRenamed("name", "outer")
    # the parts before each `$`; few a name
    mark = lambda i: (F.substring("name", i, F.lit(1)) == "$") & (F.substring("name", i + 1, F.lit(1)) != "/")
    heads = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.when(mark(i), F.substring("name", F.lit(1), i - 1)))
    heads = F.filter(heads, lambda x: x != "")
    cand = known.where(F.contains("name", F.lit("$"))).select("name", F.explode(heads).alias("outer"))
    named = cand.join(there, "outer", "left_semi").groupBy("name").agg(F.max_by("outer", F.length("outer")).alias("named"))
    out = known.join(named, "name", "left")
    if evidence is None:
        return out.select("name", F.col("named").alias("outer"), F.when(F.col("named").isNotNull(), NAMED).alias("how"))
    said = evidence.select("name", "outer").where("outer <> name").join(there, "outer", "left_semi").groupBy("name").agg(F.min("outer").alias("said"))
    out = out.join(said, "name", "left")
    how = F.when(F.col("said").isNotNull(), SAID).when(F.col("named").isNotNull(), NAMED)
    return out.select("name", F.coalesce("said", "named").alias("outer"), how.alias("how"))


def _cycles(open_: DataFrame) -> DataFrame:
    """name of the least class of every cycle among open_(name, outer), in which every outer is a name.

    Doubling: where a chain is after 2^k steps and the least name on the way; after as many steps as
    there are names every chain has been around its cycle."""
    n = open_.count()
    at = settled(open_.select("name", F.col("outer").alias("at"), F.least("name", "outer").alias("low")))
    for _ in range(math.ceil(math.log2(max(n, 2))) + 1):
        ahead = at.select(F.col("name").alias("at"), F.col("at").alias("then"), F.col("low").alias("lower"))
        step = settled(at.join(ahead, "at").select("name", F.col("then").alias("at"), F.least("low", "lower").alias("low")))
        forget(at)
        at = step
    around = at.select(F.col("at").alias("name")).distinct()  # a chain ends on its cycle
    return at.join(around, "name", "left_semi").where("name = low").select("name")


def clean_tail(name: Column, outer: Column) -> Column:
    """Whether a class is a member of its outer class by name: not anonymous, local or made by a compiler."""
    rest = F.substring(name, F.length(outer) + 2, F.length(name))
    tail = F.element_at(F.split(rest, r"\$"), -1)
    fits = name.startswith(F.concat(outer, F.lit("$")))
    odd = rest.startswith("-") | F.contains(rest, F.lit("/")) | rest.startswith("$ExternalSynthetic") | (tail == "") | tail.rlike("^[0-9]")
    return F.coalesce(fits & ~odd, F.lit(False))


def forest(names: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """name, outer, how, root, depth, unit: every class with its place in the forest; unit is the class in whose
    source it stands (itself, if it is no clean member).  how is cut where a cycle was opened.

    Rounds go from the roots down, each over the children of the last."""
    found = settled(outers(names, evidence))
    known = settled(_down(found, found.where("outer is null").select("name", "how")))
    left = settled(found.join(known, "name", "left_anti"))
    if not left.isEmpty():  # under cycles
        cuts = _cycles(left.select("name", "outer")).withColumn("how", F.lit(CUT))
        more = settled(_down(left, settled(cuts)))
        known = settled(known.unionByName(more))
    forget(found, left)
    return known


def _down(found: DataFrame, roots: DataFrame) -> DataFrame:
    level = settled(roots.select("name", F.lit(None).cast("string").alias("outer"), "how", F.col("name").alias("root"), F.lit(0).alias("depth"), F.col("name").alias("unit")))
    parts, depth = [level], 0
    inner = found.where("outer is not null").join(roots.select("name"), "name", "left_anti")
    while True:
        depth += 1
        above = level.select(F.col("name").alias("outer"), "root", F.col("unit").alias("up"))
        step = inner.join(above, "outer").select("name", "outer", "how", "root", F.lit(depth).alias("depth"), F.when(clean_tail(F.col("name"), F.col("outer")), F.col("up")).otherwise(F.col("name")).alias("unit"))
        level = settled(step)
        if level.isEmpty():
            break
        parts.append(level)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_level(placed: DataFrame) -> DataFrame:
    """name of the classes that have a source of their own."""
    return placed.where("unit = name").select("name")


def children(placed: DataFrame) -> DataFrame:
    """outer, child in order: the index of what lies directly in each class."""
    return placed.where("outer is not null").select("outer", F.col("name").alias("child")).orderBy("outer", "child")
