"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column, identity: Column) -> Column:
    """A vector that takes part: not null, all components finite, not all zero, with an id."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(identity.isNotNull() & vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vector_key(vec: str) -> list[Column]:
    """h1 and h2, 128 bits that stand for a vector."""
    return [F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit(71), vec).alias("h2")]


def distinct_vectors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, h1, h2, v, rep (smallest id) and cnt of equal vectors; rows: keys, h1, h2, v, id."""
    return rows.groupBy(*keys, "h1", "h2").agg(F.first("v").alias("v"), F.min("id").alias("rep"), F.count("*").alias("cnt"))
