"""What one class needs: the images that hold the classes it depends on, found from names that are missing.

The first want is what the class and those nested in it refer to, the classes around each of these, and
the part before `__` of names that have one.  What is found is looked at no further than its supertypes: a
round asks for those of the last round's finds that were not asked for yet.  Every round is a semi-join from the
names it is missing; none looks at a class twice.  Images that nearly all are needed end the search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import forget, settled


@dataclass
class Closure:
    """found: name, image (null where no image defines it), round; images: those needed; all_images: whether
    so many are that the search ended."""

    found: DataFrame
    images: DataFrame
    all_images: bool


def around(name: Column) -> Column:
    """The names that enclose a name by its `$`, and the part before its first `__`."""
    heads = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.when(F.substring(name, i, F.lit(1)) == "$", F.substring(name, F.lit(1), i - 1)))
    base = F.when(F.contains(name, F.lit("__")), F.substring_index(name, "__", 1))
    return F.filter(F.concat(heads, F.array(base)), lambda x: x != "")


def family(names: DataFrame, target: str) -> DataFrame:
    """name of a class and of all that its name encloses."""
    return names.where((F.col("name") == target) | F.col("name").startswith(f"{target}$")).select("name").distinct()


def closure(start: DataFrame, body: DataFrame, head: DataFrame, defined: DataFrame, total_images: int, rounds: int = 3, most: float = 0.9) -> Closure:
    """start(name): a family; body(src, dst): all that a class refers to; head(src, dst): its supertypes;
    defined(name, image): the one image that counts for each name."""
    start = settled(start.select("name").distinct())
    first = body.join(start.withColumnRenamed("name", "src"), "src", "left_semi").select(F.col("dst").alias("name")).distinct()
    wider = first.select(F.explode(around(F.col("name"))).alias("name"))
    own = settled(start.join(defined, "name", "left").withColumn("round", F.lit(0)))
    found, parts, all_images = own, [own], False
    want = first.union(wider).distinct()
    for k in range(1, rounds + 1):
        new = settled(want.join(found, "name", "left_anti").join(defined, "name", "left").select("name", "image", F.lit(k).alias("round")))
        if new.isEmpty():
            forget(new)
            break
        parts.append(new)
        found = found.unionByName(new)
        if found.where("image is not null").select("image").distinct().count() >= most * total_images:
            all_images = True
            break
        # what was found asks for its supertypes; what no image defines asks for nothing
        asks = new.where("image is not null").select(F.col("name").alias("src"))
        up = head.join(asks, "src", "left_semi").select(F.col("dst").alias("name")).distinct()
        want = up.union(up.select(F.explode(around(F.col("name"))).alias("name"))).distinct()
    out = settled(found)
    forget(start, *parts)
    images = defined.select("image").distinct() if all_images else out.where("image is not null").select("image").distinct()
    return Closure(out, images, all_images)
