"""Places in an order, without one task that holds the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import settled


def numbered(rows: DataFrame, order: list[str], name: str = "nr") -> DataFrame:
    """rows with their place (from 0) in the order, which must leave no ties.

    Rows are dealt in ranges; each range counts for itself, and starts where those before it end."""
    parts = settled(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", before.alias("_before"))  # one row a range
    out = parts.withColumn("_i", inside).join(F.broadcast(starts), "_p")
    return out.withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def numbered_within(rows: DataFrame, group: list[str], order: list[str], name: str = "nr") -> DataFrame:
    """rows with their place (from 0) in their group: the place in all less that of the group's first,
    so a group of any size is spread over ranges."""
    all_ = settled(numbered(rows, [*group, *order], "_all"))
    first = all_.groupBy(*group).agg(F.min("_all").alias("_first"))
    return all_.join(first, group).withColumn(name, F.col("_all") - F.col("_first")).drop("_all", "_first")


def least(rows: DataFrame, group: list[str], order: list[str | Column], n: int, lanes: int = 64) -> DataFrame:
    """The first n rows of each group, with nr from 1.  Groups are dealt to lanes and thinned out there
    first (and, while n is small, by Spark before the shuffle), so no task sees all of a large group."""
    salt = F.pmod(F.hash(*[F.col(c) if isinstance(c, str) else c for c in order]), F.lit(lanes))
    own = rows.withColumn("_lane", salt)
    thin = own.withColumn("nr", F.row_number().over(Window.partitionBy(*group, "_lane").orderBy(*order))).where(F.col("nr") <= n)
    last = Window.partitionBy(*group).orderBy(*order)
    return thin.drop("_lane").withColumn("nr", F.row_number().over(last)).where(F.col("nr") <= n)
