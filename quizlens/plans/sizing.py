"""Size checks that guard every broadcast, and lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side we broadcast, in rows and in bytes: a row costs its values and
# about ROW_OVERHEAD bytes of hash relation.
DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 32
_FIXED_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
                "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def row_bytes(df: DataFrame):
    """Bytes of a row's values as a Column; nested values count by their JSON text."""
    total = F.lit(ROW_OVERHEAD).cast("long")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in _FIXED_WIDTH:
            total = total + F.lit(_FIXED_WIDTH[kind])
        elif kind in ("array<float>", "array<double>", "array<bigint>", "array<int>"):
            width = _FIXED_WIDTH[kind[6:-1]]
            total = total + F.coalesce(F.size(column), F.lit(0)) * F.lit(width)
        elif kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        else:
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return total


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of ``df``: one aggregate, partial in every task."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def at_most(df: DataFrame, max_rows: int, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes."""
    rows, size = measured(df)
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                       max_bytes: int = DEFAULT_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast hint for ``df`` only after its rows and bytes are proven small.

    Beyond the bounds the plain DataFrame is returned and the join falls back
    to a shuffle (sort-merge) join, with AQE free to re-plan at run time.
    """
    if at_most(df, max_rows, max_bytes):
        return F.broadcast(df), True
    return df, False


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder (reliable checkpoint).

    Used where a result is both measured (size check) and then joined, so
    the upstream work runs once and a lost executor does not recompute it.
    """
    return df.checkpoint(eager=True)


# Text work (regex, tokenising) costs about half a CPU-second per MB of
# compressed input, so a task per MB keeps cores busy without scattering a
# small table into thousands of tiny tasks.
SPREAD_BYTES_PER_TASK = 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (file sizes for a scan), if known."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - an estimate is optional
        return None


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over the cluster only when it has too few partitions.

    CPU-heavy row-local work (tokenising, regex scores) runs one task per
    input split; a table stored as one large row group would otherwise run
    on a single core.  The target is the cluster's parallelism, capped at
    one task per ``SPREAD_BYTES_PER_TASK`` of input, so a small table is not
    scattered into many tiny tasks.  At scale the scan already yields more
    splits than that, so this adds no shuffle there.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    if size is not None and min_partitions is None:
        target = max(1, min(target, -(-size // SPREAD_BYTES_PER_TASK)))
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)
