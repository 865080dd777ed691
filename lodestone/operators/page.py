"""Row windows, totals and top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import forget, settled

DEFAULT_CAP = 500  # rows of an answer that names no limit


def window(rows: DataFrame, order: list, offset: int = 0, limit: int = 0) -> DataFrame:
    """The rows from offset on in the order, limit 0: all of them.  A limit plans as one take-ordered."""
    out = rows.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def largest(rows: DataFrame, size: str, order: list[str], n: int = 20) -> DataFrame:
    """The n largest; the earlier in scan order wins ties."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return rows.orderBy(F.desc(size), *order).limit(n)


def capped(rows: DataFrame, order: list, cap: int = DEFAULT_CAP) -> DataFrame:
    """The first rows, at most cap of them, each with truncated: whether there are more."""
    return with_total(rows, order, 0, cap).withColumn("truncated", F.col("total") > cap).drop("total")


def with_total(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """The page, each row with the total of all rows.  The rows are made once, into a table of their own,
    whose count is in its footers; a page is taken from it."""
    rows = settled(rows)
    return window(rows, order, offset, limit).withColumn("total", F.lit(rows.count()).cast("long"))


@dataclass
class Page:
    rows: list
    total: int
    offset: int
    limit: int

    @property
    def next_offset(self) -> int | None:
        end = self.offset + len(self.rows)
        return end if self.rows and end < self.total else None

    def envelope(self, **more) -> dict:
        return more | {"total": self.total, "offset": self.offset, "limit": self.limit, "returned": len(self.rows), "next_offset": self.next_offset}


def fetch(rows: DataFrame, order: list, offset: int = 0, limit: int = 0) -> Page:
    """Run a page: its rows come to the caller, the total is counted in Spark; the rows are made once."""
    rows = settled(rows)
    n = rows.count()
    got = window(rows, order, offset, limit).collect() if offset < n else []
    forget(rows)
    return Page(got, n, offset, limit)
