"""An append-only table of model answers, keyed by what was asked.

A key is the SHA-256 of a request: system text, prompt, temperature, largest
answer, options and sample number.  A run calls only what the table does not
hold yet and appends the answers in several commits, so a run that was stopped
calls only the rest, and other tables, prompts or settings may share a folder.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizlens.plans.sizing import cut_lineage

SCHEMA = "key string, response string"
#: Commits of one run: what a stopped run has to ask again is at most one of them.
ROUNDS = 8


def request_key(system: Column, prompt: Column, temperature: Column, max_tokens: int | None, options: dict | None) -> Column:
    """SHA-256 of a request as JSON; missing parts and empty ones differ."""
    settings = json.dumps([max_tokens, options or {}], sort_keys=True)
    parts = F.struct(system.alias("system"), prompt.alias("prompt"), temperature.alias("temperature"), F.lit(settings).alias("settings"))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def with_samples(df: DataFrame, request_col: str, out_col: str) -> DataFrame:
    """``df`` with a number for each row among the rows of its request, from 0.

    Rows are ordered by a hash of their values, so a later run gives a row the
    same number.  They are numbered in slices of that hash, which add up over a
    small table: a request of a third of all rows is spread over all tasks.
    """
    slices = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.withColumn("_order", F.xxhash64(F.to_json(F.struct("*"))))
    cut = hashed.withColumn("_slice", F.pmod("_order", F.lit(slices)))
    counts = cut.groupBy(request_col, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(request_col).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(request_col, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(request_col, "_slice").orderBy("_order"))
    return (cut.withColumn("_place", place).join(offsets, [request_col, "_slice"])
            .withColumn(out_col, F.col("_before") + F.col("_place") - 1).drop("_order", "_slice", "_place", "_before", "_n"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """``(key, response)``, a row a key; NULL where every call so far failed, the least text of several answers."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path).groupBy("key").agg(F.min("response").alias("response"))


def answered(requests: DataFrame, call, path: str, retry_failed: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """The answers to ``requests`` (key, ...), a row a key, from the table at ``path``, after asking what it lacks.

    ``call`` turns rows of ``requests`` into ``(key, response)``.  Failed calls
    are kept as NULL and asked again only with ``retry_failed``.
    """
    spark = requests.sparkSession
    known = read_answers(spark, path)
    if retry_failed:
        known = known.where(F.col("response").isNotNull())
    missing = cut_lineage(requests.dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti"))
    turn = F.pmod(F.xxhash64("key"), F.lit(rounds))
    sizes = {r["turn"] for r in missing.groupBy(turn.alias("turn")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `rounds` rows
    for k in sorted(sizes):
        call(missing.where(turn == k)).write.mode("append").parquet(path)
    return read_answers(spark, path).join(requests.select("key").distinct(), "key", "left_semi")
