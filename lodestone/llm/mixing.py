"""Mixing sources to target weights by capped water-filling.

Targets: sources share a number of words by weight; a source's share stops at `max_epochs` times
its own size, and what is over is shared again by weight among the others until none is above.
Sampling: a source with target t and size s takes floor(t/s) whole repetitions of each document
and one more repetition of some documents, drawn in the order of a seeded hash, whose sizes add
up to the fraction that is left.  The hash is of id and text.  The boundary is found on its histograms (two
levels of 1024 cells), so a source that holds a third of all rows is never gathered or sorted in
one task.

Defined results: null text is size 0; a null source is a source of its own, after all others; a
document of size 0 takes 0; rows with a null or repeated id are drawn apart if their texts differ,
rows equal in both alike (so a source made of very few different rows meets its target only to
within one of them with its copies); texts of any length count whole; an empty table
gives an empty mix; extra columns pass through `mix` unless they clash with the added ones,
which then win.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

CELLS = 1024
ADDED = ("size", "source_size", "target", "taken")


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, max_epochs: float) -> list[float]:
    """Share total by weight, no share above max_epochs times its size; total that no source can
    take is left over."""
    caps = [max_epochs * s for s in sizes]
    out = [0.0] * len(caps)
    live, left = [i for i, w in enumerate(weights) if w > 0], float(total)
    while live:
        unit = left / sum(weights[i] for i in live)
        over = [i for i in live if unit * weights[i] > caps[i]]
        if not over:
            for i in live:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(caps[i])
            left -= caps[i]
        live = [i for i in live if i not in set(over)]
    return out


def targets(sized: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target), one row per source; the weights repeat over the sources in
    code-point order, null last.  Only one row per source comes to the driver."""
    spark = sized.sparkSession
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    per = sorted(per, key=lambda r: (r.source is None, r.source or ""))
    w = [float(weights[i % len(weights)]) for i in range(len(per))]
    sizes = [int(r.source_size) for r in per]
    t = water_fill(sizes, w, share * sum(sizes), max_epochs)
    rows = [(r.source, n, x) for r, n, x in zip(per, sizes, t, strict=True)]
    return spark.createDataFrame(rows, "source string, source_size long, target double")


def _boundary(cells: DataFrame, keys: list[str], cell: str, need: str) -> DataFrame:
    """Per group the first cell in which the running sum of sizes passes the need, and the sum before it.
    A group has at most CELLS rows here."""
    w = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.withColumn("run", F.sum("cell_size").over(w))
    return (
        run.where(F.col("run") > F.col(need)).groupBy(*keys).agg(F.min(cell).alias(f"cut_{cell}"), F.min_by(F.col("run") - F.col("cell_size"), cell).alias(f"before_{cell}"))
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", size_col: str | None = None, mark_col: str | None = None) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes of the document).
    size_col: a column that has the sizes already; mark_col: one that tells texts apart (else the
    MD5 of the text does)."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    size = F.coalesce(F.col("d")[size_col].cast("long"), F.lit(0)) if size_col else word_count(F.col("d")["text"])
    mark = F.col("d")[mark_col] if mark_col else F.md5(F.col("d")["text"].cast("binary"))
    drawn = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("d")[id_col].cast("string"), F.lit("-")), F.coalesce(mark.cast("string"), F.lit("-")))
    h = F.conv(F.substring(F.md5(drawn.cast("binary")), 1, 5), 16, 10).cast("int")  # 20 bits: CELLS * CELLS
    s = F.coalesce(F.concat(F.lit("="), F.col("d")["source"]), F.lit("-"))  # never null
    base = d.select("d", s.alias("s"), size.alias("size"), F.floor(h / CELLS).cast("int").alias("c1"), F.pmod(h, F.lit(CELLS)).cast("int").alias("c2"))
    slim = cut(base.select(F.col("d")["source"].alias("source"), "s", "size", "c1", "c2").groupBy("source", "s", "c1", "c2").agg(F.sum("size").alias("size")))
    goal = targets(slim, weights, share, max_epochs).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(epochs + F.lit(1e-12)))
    goal = goal.withColumn("need", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    # first level: at most CELLS rows a source
    one = slim.groupBy("s", "c1").agg(F.sum("size").alias("cell_size")).join(goal.select("s", "need"), "s")
    goal = cut(goal.join(_boundary(one, ["s"], "c1", "need"), "s", "left").withColumn("need2", F.col("need") - F.coalesce("before_c1", F.lit(0))))
    # second level: only the boundary cell of each source
    edge = goal.select("s", F.col("cut_c1").alias("c1"), "need2").where("c1 is not null")
    two = slim.join(edge, ["s", "c1"]).groupBy("s", "c2").agg(F.sum("size").alias("cell_size"), F.first("need2").alias("need2"))
    last = two.join(_boundary(two, ["s"], "c2", "need2"), "s").where("c2 = cut_c2")
    # the cell on the boundary is taken if that brings the sum nearer to the target
    near = F.col("before_c2") + F.col("cell_size") - F.col("need2") <= F.col("need2") - F.col("before_c2")
    last = last.select("s", "cut_c2", near.alias("with_last"))
    goal = goal.join(last, "s", "left").select("s", "source_size", "target", "whole", "need", "cut_c1", "cut_c2", "with_last")
    draw = (
        F.when(F.col("cut_c1").isNull(), F.col("need") > 0)
        .when(F.col("c1") != F.col("cut_c1"), F.col("c1") < F.col("cut_c1"))
        .when(F.col("cut_c2").isNull(), F.lit(True))
        .when(F.col("c2") != F.col("cut_c2"), F.col("c2") < F.col("cut_c2"))
        .otherwise(F.col("with_last"))
    )
    out = base.join(_few(goal), "s")
    taken = (F.col("size") * (F.col("whole") + F.when(draw, 1).otherwise(0))).cast("long")
    kept = [F.col("d")[c].alias(c) for c in docs.columns if c not in ADDED]
    return out.select(*kept, "size", "source_size", "target", taken.alias("taken"))


def _few(plan: DataFrame, limit: int = 50_000) -> DataFrame:
    """One row per source: sent to all executors if counted to be few, joined by a shuffle if not."""
    plan = cut(plan)
    return F.broadcast(plan) if plan.count() <= limit else plan


def repeat_rows(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken (documents of size 0 are not)."""
    d = mixed.select(F.struct(*columns).alias("d"), F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0)).alias("n"))
    d = d.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return d.select(*[F.col("d")[c].alias(c) for c in columns])
