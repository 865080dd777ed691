"""Joins, anti-joins and set operations over the normalised tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import settled


def first_wins(rows: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """One row per name: the one that comes first in the order."""
    pick = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order)).alias("r")
    return rows.groupBy(F.col(name).alias("_name")).agg(pick).select("r.*")


def defining(rows: DataFrame, name: str, image: str, order: str) -> DataFrame:
    """name, images (in order), n and first of every name; n > 1 is ambiguous."""
    got = rows.select(F.col(name), F.col(image).alias("i"), F.col(order).alias("o")).groupBy(name, "i").agg(F.min("o").alias("o"))
    lists = got.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("o", "i"))).alias("all"))
    return lists.select(name, F.transform("all", lambda x: x["i"]).alias("images"), F.size("all").alias("n"), F.col("all")[0]["i"].alias("first"))


def located(wanted: DataFrame, rows: DataFrame, name: str, image: str) -> DataFrame:
    """wanted with dex, the first image that has its name, `-` if none."""
    have = rows.groupBy(F.col(name).alias(name)).agg(F.min(image).alias("dex"))
    return wanted.join(have, name, "left").withColumn("dex", F.coalesce("dex", F.lit("-")))


def labelled(rows: DataFrame, ref: str, resources: DataFrame, key: str, value: str) -> DataFrame:
    """rows with label: the resource a reference names, or the text itself."""
    pairs = resources.select(F.col(key).alias(ref), F.col(value).alias("_v"))
    return rows.join(pairs, ref, "left").withColumn("label", F.coalesce("_v", F.col(ref).cast("string"))).drop("_v")


def all_inside(candidates: DataFrame, refs: DataFrame, key: str, violates: Column) -> DataFrame:
    """Candidates none of whose references violates the condition (for all by anti-join)."""
    return candidates.join(refs.where(violates).select(key), key, "left_anti")


def without(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The different values of the keys in rows that other does not have (set difference)."""
    return rows.select(*keys).distinct().join(other.select(*keys), keys, "left_anti")


def outside_writes(refs: DataFrame, fields: DataFrame, key: list[str], owner: str, writer: str, method: str, constructors: Sequence[str] = ("<init>", "<clinit>")) -> DataFrame:
    """References that write a final field from another class, or from its own outside a constructor.

    refs: key, writer, method, is_write; fields: key, owner, is_final."""
    final = fields.where("is_final").select(*key, F.col(owner).alias("_owner"))
    hit = refs.where("is_write").join(final, key)
    return hit.where((F.col("_owner") != F.col(writer)) | ~F.col(method).isin(*constructors)).drop("_owner")


def crossing(refs: DataFrame, left: Column, right: Column) -> DataFrame:
    """References between different groups: the theta part stays a filter after the equi-join."""
    return refs.where(left != right)


def unique_value(rows: DataFrame, domain: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with the name that the domain has for exactly one entry of their key and value, else null."""
    one = domain.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(name).alias(name)).where("_n = 1").drop("_n")
    return rows.join(one, [*keys, value], "left")


def nesting(names: DataFrame, name: str, sep: str = "$") -> DataFrame:
    """name and outer: the part before the last sep if a class of that name exists, else null."""
    cut = F.when(F.contains(F.col(name), F.lit(sep)), F.expr(f"substring({name}, 1, length({name}) - length(substring_index({name}, '{sep}', -1)) - 1)"))
    known = names.select(F.col(name).alias("outer")).distinct()
    cand = names.select(name, cut.alias("_o"))
    return cand.join(known, cand["_o"] == known["outer"], "left").select(name, "outer")


def nesting_evidence(annotations: DataFrame) -> DataFrame:
    """image_seq, class_seq, enclosing_class, enclosing_method, inner_name, members of the classes that the
    system annotations place; annotations: image_seq, class_seq, type, elements (JSON), on classes."""
    said = lambda kind, key: F.max(F.when(F.col("type") == f"Ldalvik/annotation/{kind};", F.get_json_object("elements", f"$.{key}")))
    per = annotations.where(F.col("type").startswith("Ldalvik/annotation/")).groupBy("image_seq", "class_seq")
    got = per.agg(
        said("EnclosingClass", "value").alias("enclosing_class"),
        said("EnclosingMethod", "value").alias("enclosing_method"),
        said("InnerClass", "name").alias("inner_name"),
        F.from_json(said("MemberClasses", "value"), "array<string>").alias("members"),
    )
    return got.where(F.coalesce("enclosing_class", "enclosing_method", "inner_name", F.to_json("members")).isNotNull())


def top_level(nested: DataFrame) -> DataFrame:
    """Classes without a real outer class."""
    return nested.where(F.col("outer").isNull()).drop("outer")


def case_collisions(paths: DataFrame, path: str) -> DataFrame:
    """folded, n and paths (sorted) of paths that only case tells apart."""
    got = paths.select(F.col(path).alias("p")).distinct().groupBy(F.lower("p").alias("folded")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("p")).alias("paths"))
    return got.where("n > 1")


def image_counts(rows: DataFrame, image: str, counts: dict[str, Column]) -> DataFrame:
    """image, counts, total_classes: sums of each image beside the number of all rows.

    The total is added up from the images' own counts, so the rows are read once."""
    per = settled(rows.groupBy(F.col(image).alias("image")).agg(F.count("*").alias("classes"), *[c.alias(n) for n, c in counts.items()]))
    return per.crossJoin(F.broadcast(per.agg(F.sum("classes").alias("total_classes"))))  # one row


def entry(rows: DataFrame, name: str, text: str) -> DataFrame:
    """Entries a text names: the exact one, else all that contain it (one is a match, more are ambiguous)."""
    hit = rows.where(F.contains(F.col(name), F.lit(text))).withColumn("exact", F.col(name) == text)
    best = hit.agg(F.max("exact").alias("_best"))
    return hit.join(F.broadcast(best), hit["exact"] == best["_best"]).drop("_best")  # one row
