"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the rank
as a fraction of the source's size orders all rows, which interleaves the
sources in proportion; equal cuts of that order are the shards, so every
shard holds each source's share of the mixture and shard sizes differ by one
row at most.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import drop_staged, hash32, ranked, source_key, staged

SHARDS = 16
SEED = 20


def stratified_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id",
                      text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus one; a null text counts as empty
    and a null source is a source of its own.  Repeated rows each get a slot
    of their own (equal rows are interchangeable, so which copy gets which
    slot is of no effect).  Rows with a null id are ranked like any other.
    An empty table gives an empty result; fewer rows than shards leave some
    shards empty.  Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), source_key(source_col).alias("src"),
                       (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       hash32(seed, F.col(id_col).cast("string")).alias("h"))
    rows = staged(rows, "shard-rows")
    by_source = ranked(rows, ["src"], ["h", "doc_id", "text_crc32", "size"], "rank", "shard-sources", total="n")
    drop_staged(rows)
    # Each source starts at its own fraction of a step, so that many sources
    # of one row each do not all meet at the same place of the order.
    start = hash32(seed, F.lit("start"), F.col("src")) / F.lit(4294967296.0)
    fraction = (F.col("rank") + start) / F.col("n")
    placed = by_source.withColumn("frac", fraction).select("doc_id", "size", "text_crc32", "src", "rank", "frac")
    placed = staged(placed, "shard-fractions")
    order = ranked(placed, [], ["frac", "src", "rank"], "pos", "shard-order", total="n")
    drop_staged(placed)
    return order.select("doc_id", "size", "text_crc32",
                        F.expr(f"cast(pos * {shards} div n as int)").alias("shard"),
                        F.expr(f"pos - ((pos * {shards} div n) * n + {shards - 1}) div {shards}").alias("slot"))
