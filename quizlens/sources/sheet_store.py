"""A stored copy of a sheet tree, kept up to date by reading only what is new or changed.

A store is two tables of generations, one a refresh.  ``sheets`` holds the
texts that a refresh read, partitioned by folder; ``log`` names the files it
read, with their length and time of change, and the files it found gone.  The
log is written last and is the commit: what a stopped refresh left behind is
never read and is replaced by the next one.  A generation is as large as the
change it records, however large the tree is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlens.plans.sizing import broadcast_if_small, cut_lineage
from quizlens.sources.files import LISTING, TEXTS, list_sheets, read_listed, sheet_id

LOG = LISTING + ", present boolean, generation long"
#: What one task reads: bytes, and files.
TASK_BYTES, TASK_FILES = 32 * 1024 * 1024, 2_000


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: files listed, read because they were new or changed, and found gone."""

    listed: int
    read: int
    removed: int


def generations(spark: SparkSession, store: str) -> list[int]:
    """The committed generations of a store, oldest first."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/log/generation=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in found)


def _table(spark: SparkSession, store: str, name: str, schema: str, kept: list[int]) -> DataFrame:
    if not kept:
        return spark.createDataFrame([], schema)
    paths = [f"{store}/{name}/generation={g}" for g in kept]
    return spark.read.option("basePath", f"{store}/{name}").schema(schema).parquet(*paths)


def _current(log: DataFrame) -> DataFrame:
    """The last entry of each file that is not gone."""
    last = F.max_by(F.struct("length", "modified", "present"), "generation").alias("last")
    return (log.groupBy("folder", "name").agg(last, F.max("generation").alias("generation")).where("last.present")
            .select("folder", "name", "last.length", "last.modified", "generation"))


def refresh_sheets(spark: SparkSession, root: str, store: str) -> Refresh:
    """Bring ``store`` up to date with the tree at ``root``; only new and changed files are read.

    A file is changed when its length or its time of change is another one
    than that it was stored with.  Files read are dealt to tasks by folder,
    large folders to several, so a folder has few files in the store.  One
    refresh of a store may run at a time.
    """
    done = generations(spark, store)
    generation = done[-1] + 1 if done else 1
    known = _current(_table(spark, store, "log", LOG, done))
    listed = cut_lineage(list_sheets(spark, root))
    changed = cut_lineage(listed.join(known, ["folder", "name", "length", "modified"], "left_anti"))
    gone = cut_lineage(known.join(listed, ["folder", "name"], "left_anti").select("folder", "name", "length", "modified"))
    size = changed.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).first()
    outcome = Refresh(listed.count(), size["files"], gone.count())
    if done and not outcome.read and not outcome.removed:
        return outcome
    parts = max(1, -(-(size["bytes"] or 0) // TASK_BYTES), -(-size["files"] // TASK_FILES),
                min(size["files"], spark.sparkContext.defaultParallelism))
    share = F.greatest(F.ceil(F.sum("length") / TASK_BYTES), F.ceil(F.count(F.lit(1)) / TASK_FILES))
    shares = changed.groupBy("folder").agg(share.alias("share"))
    dealt = (changed.join(shares, "folder").withColumn("slice", F.pmod(F.xxhash64("name"), F.col("share")))
             .repartition(parts, "folder", "slice"))
    texts = f"{store}/sheets/generation={generation}"
    read_listed(dealt, root).write.mode("overwrite").partitionBy("folder").parquet(texts)
    stored = spark.read.schema(TEXTS).parquet(texts).select("folder", "name", "length", "modified", F.lit(True).alias("present"))
    entries = stored.unionByName(gone.withColumn("present", F.lit(False)))
    entries.coalesce(max(1, -(-(outcome.read + outcome.removed) // 1_000_000))).write.mode("overwrite").parquet(f"{store}/log/generation={generation}")
    return outcome


def read_sheet_store(spark: SparkSession, store: str) -> DataFrame:
    """``(folder, id, content_raw)``, a row for each file of the tree as of the last refresh.

    A filter on ``folder`` prunes the folders of each generation.  Rows that
    a later generation replaced or found gone are left out by an anti join
    with the list of them, broadcast where it is proven small.
    """
    done = generations(spark, store)
    rows = _table(spark, store, "sheets", "name string, content_raw string, generation long, folder string", done)
    if len(done) > 1:
        log = _table(spark, store, "log", LOG, done)
        old = log.where("present").select("folder", "name", "generation").join(_current(log), ["folder", "name", "generation"], "left_anti")
        old, _ = broadcast_if_small(cut_lineage(old))
        rows = rows.join(old, ["folder", "name", "generation"], "left_anti")
    return rows.select("folder", sheet_id().alias("id"), "content_raw")
