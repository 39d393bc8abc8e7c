"""Helpers shared by the training-data operators.

Intermediate tables go to the shared checkpoint folder as Parquet
(:func:`staged`), so a lost executor never forces upstream text work to run
again and both readers of a table see the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizlens.plans.sizing import broadcast_if_small
from quizlens.session import scratch_path, ship_package

#: Fixed value: the word class of the contracts, runs of anything but these six characters.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Largest table of (id, hash) pairs that is broadcast; beyond it the join is a shuffle join.
BROADCAST_PAIRS = 50_000


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh Parquet folder under the shared checkpoint folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete the folders of staged tables that nothing reads any more: what was made of them must be staged itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._staged_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ready(df: DataFrame) -> SparkSession:
    """The session, with this package importable on every executor."""
    ship_package(df.sparkSession)
    return df.sparkSession


def hash32(*parts) -> Column:
    """A seeded uniform integer in [0, 2^32): the first 32 bits of the MD5 of the parts joined by ``|``.

    A missing part counts as an empty string.
    """
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def source_key(col: str) -> Column:
    """A source name as a non-null string whose order is by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(col).cast("string")), F.lit("1"))


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, name: str, total: str | None = None) -> DataFrame:
    """Zero-based rank of each row within ``group`` (no columns: the whole table), by ``order``.

    Rows are sorted by ranges of (group, order) and staged as ``name``; a rank
    is the place in the range plus the rows of the group in earlier ranges, a
    sum over the table of (group, range) counts.  A number of the row ends the
    order, so ranges cut groups, rows that share their whole order, and copies
    of one row alike: none of them can fill one task.  Such rows take their
    places in any order.  ``df`` is read twice, so it should be a staged table
    (the numbers of its rows are then those of its files).  ``total`` names an
    extra column with the size of the group.  Grouping columns must not be null.
    """
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    placed = staged(numbered.orderBy(*group, *order, "__row").drop("__row").withColumn("__at", F.monotonically_increasing_id()), name)
    cut = placed.withColumn("__part", F.shiftrightunsigned("__at", 33))
    counts = cut.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    running, whole = Window.partitionBy(*group).orderBy("__part"), Window.partitionBy(*group)
    offsets = counts.select(*group, "__part", "__first", (F.sum("__n").over(running) - F.col("__n")).alias("__off"),
                            F.sum("__n").over(whole).alias("__total"))
    offsets, _ = broadcast_if_small(offsets, BROADCAST_PAIRS)
    done = cut.join(offsets, [*group, "__part"]).withColumn(out, F.col("__off") + F.col("__at") - F.col("__first"))
    if total:
        done = done.withColumn(total, F.col("__total"))
    return done.drop("__at", "__part", "__first", "__off", "__total")


def ordered_ranks(df: DataFrame, order: list, out: str, name: str) -> DataFrame:
    """Zero-based rank of every row in a global sort, without a one-task window.

    A range-partitioned sort is staged with each row's partition and place;
    only the row count of each partition (one number per partition) is summed
    up in one place.
    """
    placed = staged(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__off"))
    return (placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
            .withColumn(out, F.col("__off") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("__part", "__at", "__off"))


def text_hash(text_col: str) -> Column:
    """With the id, names a row; rows that agree in both have the same text."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``decisions`` (id, h, kept), one row per row, keeps.

    ``h`` is :func:`text_hash`.  Of rows that agree in id and text and of
    which some are kept and some not, one stays.  The columns travel as one
    struct, so names used in here cannot clash with the table's own.
    """
    pairs = staged(decisions.groupBy("id", "h").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"),
                                                    F.count_if("kept").alias("stay")), "decisions")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("h"), F.struct("*").alias("row"))

    def matches(table: DataFrame, how: str) -> DataFrame:
        table, _ = broadcast_if_small(table.select(F.col("id").alias("i"), F.col("h").alias("g")), BROADCAST_PAIRS)
        return rows.join(table, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), how)

    copies = pairs.where(F.col("kept") & (F.col("stay") < F.col("n")))
    out = matches(pairs.where(~F.col("kept") | (F.col("stay") < F.col("n"))), "left_anti").select("row.*")
    if copies.isEmpty():
        return out
    return out.unionByName(matches(copies, "left_semi").dropDuplicates(["id", "h"]).select("row.*"))
