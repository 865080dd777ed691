"""Access levels: the least that lets every reference through.

Levels are a chain: private, package, protected, public.  What one reference asks for follows from
where it stands: in the same unit nothing, in the same package the package, in a subtype elsewhere protected,
else public.  A member needs the greatest of what its references ask for, and no less than it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("private", "package", "protected", "public")


def level_of(access: Column) -> Column:
    """The level in access flags."""
    has = lambda bit: access.bitwiseAND(bit) != 0
    return F.when(has(0x1), 3).when(has(0x4), 2).when(has(0x2), 0).otherwise(1)


def package_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)[/.][^/.]*$", 1)


def asked(refs: DataFrame, closed: DataFrame) -> DataFrame:
    """refs(owner, member, user, owner_package, user_package, owner_unit, user_unit) summed up to owner, member,
    level: the greatest that any asks for; closed: child, ancestor of subtypes.

    References are folded to one for each (member, user) first, so a member that everything calls meets
    the subtypes as often as it has users."""
    pairs = refs.groupBy("owner", "member", "user").agg(*[F.first(c).alias(c) for c in ("owner_package", "user_package", "owner_unit", "user_unit")])
    near = F.when(F.col("owner_unit") == F.col("user_unit"), 0).when(F.col("owner_package") == F.col("user_package"), 1)
    pairs = pairs.withColumn("near", near)
    above = closed.select(F.col("child").alias("user"), F.col("ancestor").alias("owner")).distinct().withColumn("sub", F.lit(2))
    far = pairs.where("near is null").join(above, ["user", "owner"], "left").select("owner", "member", F.coalesce("sub", F.lit(3)).alias("level"))
    rows = pairs.where("near is not null").select("owner", "member", F.col("near").alias("level")).unionByName(far)
    return rows.groupBy("owner", "member").agg(F.max("level").alias("level"))


def levels(members: DataFrame, refs: DataFrame, closed: DataFrame) -> DataFrame:
    """members(owner, member, declared: a level) with needed and widened (the level it must be written with):
    names of levels; a member without references needs what it has."""
    need = asked(refs, closed)
    out = members.join(need, ["owner", "member"], "left")
    shown = lambda c: F.element_at(F.array(*[F.lit(x) for x in LEVELS]), c + 1)
    level = F.coalesce("level", F.lit(0))
    return out.select("owner", "member", shown(F.col("declared")).alias("declared"), shown(level).alias("needed"), shown(F.greatest("declared", level)).alias("widened"), (level > F.col("declared")).alias("changed"))
