"""Table-level helpers: projection (P3), distinct values (A1), ordering and
head (O1-O2), run unions (O3) and the row mean of score columns (A3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep ``cols`` (Catalyst prunes the rest down to the scan)."""
    return df.select(*cols)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A1: the distinct values of one column (partial distinct before the shuffle)."""
    return df.select(col).distinct()


def restore_order(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """O1: a global sort on an explicit key, for callers that need row order."""
    return df.orderBy(*key_cols)


def head_n(df: DataFrame, n: int, key_cols: list[str]) -> DataFrame:
    """O2: the first ``n`` rows by an explicit key (a bare limit is not stable).

    Spark plans this as a top-k (``TakeOrderedAndProject``): each partition
    keeps its own best ``n``, so only ``n`` rows per partition are shuffled.
    """
    return df.orderBy(*key_cols).limit(n)


def union_batches(frames: list[DataFrame]) -> DataFrame:
    """O3: stack results of separate runs by column name; missing columns NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def mean_over(cols: list[str]):
    """A3: the row mean of ``cols`` summed left to right (NULL if any is NULL)."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    return total / F.lit(float(len(cols)))
