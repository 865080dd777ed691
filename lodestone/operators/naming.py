"""Names of files: one for each class, also where case does not count.

Paths that are equal when folded are a set; its first name keeps its path, the r-th other one gets the
r-th number from 2 on that no real name has taken.  A numbered path has exactly one base, so two sets cannot
make the same path, and a number that a real name holds is passed over: one step reaches the fixpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import numbered_within
from .rounds import settled


def safe_segment(segment: Column, keywords: list[str]) -> Column:
    """A path segment that is a legal identifier: what none may hold becomes `_`; keywords, a first digit and a
    lone `_` get one in front."""
    plain = F.when(segment == "", F.lit("_")).otherwise(F.regexp_replace(segment, r"[^A-Za-z0-9_$]", "_"))
    return F.when(plain.isin("_", *keywords) | plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)


def safe_path(name: Column, keywords: list[str]) -> Column:
    """a/b/C with every segment made safe."""
    return F.array_join(F.transform(F.split(name, "/", -1), lambda s: safe_segment(s, keywords)), "/")


def unique_paths(names: DataFrame, path: Column) -> DataFrame:
    """name, path: names(name), each once, with paths that differ even when case is folded."""
    rows = settled(names.select("name").distinct().withColumn("base", path).withColumn("fold", F.lower("base")))
    many = rows.groupBy("fold").agg(F.count("*").alias("n")).where("n > 1").select("fold")
    shared = settled(rows.join(many, "fold", "left_semi"))
    if shared.isEmpty():
        return rows.select("name", F.col("base").alias("path"))
    # an exact path wins over one that was made safe, then the order of names decides
    first = numbered_within(shared.withColumn("changed", (F.col("base") != F.col("name")).cast("int")), ["fold"], ["changed", "name"], "r")
    # numbers that real names have taken: those of the form base_n
    number = F.regexp_extract("fold", r"_([1-9][0-9]{0,8})$", 1)
    held = rows.where(number != "").select(F.substring("fold", F.lit(1), F.length("fold") - F.length(number) - 1).alias("fold"), number.cast("long").alias("taken")).distinct()
    held = held.join(many, "fold", "left_semi").groupBy("fold").agg(F.array_sort(F.collect_list("taken")).alias("taken"))  # numbers after one contested name
    n = F.aggregate(F.coalesce("taken", F.array().cast("array<long>")), F.col("r") + 1, lambda acc, t: F.when((t >= 2) & (t <= acc), acc + 1).otherwise(acc))
    new = first.join(held, "fold", "left").select("name", F.when(F.col("r") == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), n.cast("string"))).alias("path"))
    return rows.join(many, "fold", "left_anti").select("name", F.col("base").alias("path")).unionByName(new)
