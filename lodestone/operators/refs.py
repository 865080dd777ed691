"""Reference search: which methods refer to what matches.

The text predicate runs once per dictionary entry; references are then joined by index.  Which
join that is (broadcast or shuffle) is left to the optimiser, which knows the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWNER = ["image", "class", "method"]


def targets(dictionary: DataFrame, matches: Column, keys: list[str], shown: Column) -> DataFrame:
    """keys and target (the rendered text) of the dictionary entries that match."""
    return dictionary.where(matches).select(*keys, shown.alias("target"))


def hits(refs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """refs(image, class, method, pc, kind, *keys) joined with their targets."""
    return refs.join(wanted, keys)


def by_method(found: DataFrame, order: list[str], owner: list[str] = OWNER) -> DataFrame:
    """One row per method (owner: what tells methods apart, names of images need not): kind of its
    first hit, distinct targets in the order of their first hits."""
    at = F.struct(*order)
    first = found.groupBy(*owner, "target").agg(F.min(F.struct(at.alias("at"), F.col("kind").alias("kind"))).alias("one"))
    grouped = first.groupBy(*owner).agg(F.min("one").alias("head"), F.array_sort(F.collect_list(F.struct(F.col("one.at").alias("at"), "target"))).alias("all"))
    return grouped.select(F.col("image").alias("dex"), F.col("head.kind").alias("kind"), "class", "method", F.transform("all", lambda x: x["target"]).alias("refs"))


def by_class(found: DataFrame, owner: list[str] = OWNER) -> DataFrame:
    """Methods with at least one hit per owner class, over all images."""
    return found.select(*owner).distinct().groupBy("class").agg(F.count("*").alias("methods"))


def sites_by_class(found: DataFrame) -> DataFrame:
    """Single references per owner class (not methods)."""
    return found.groupBy("class").agg(F.count("*").alias("sites"))


def kinds(refs: DataFrame, of: list[str], kind: str = "ref_kind", target: str = "ref_idx") -> DataFrame:
    """kind, sites and targets (different ones) of the references of some kinds."""
    per = refs.where(F.col(kind).isin(*of)).groupBy(F.col(kind).alias("ref_kind"), target).agg(F.count("*").alias("n"))
    return per.groupBy("ref_kind").agg(F.sum("n").alias("sites"), F.count("*").alias("targets"))


def signatures(members: DataFrame, owner: str, signature: str) -> DataFrame:
    """owner and signatures: the different ones of each owner, sorted."""
    return members.groupBy(owner).agg(F.array_sort(F.collect_set(signature)).alias("signatures"))
