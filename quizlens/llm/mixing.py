"""Mixing sources to target weights by repetition rates.

Tokens are summed per source, each source's target is its weight's share of
all tokens (capped at a number of repeats, the excess shared out again), and
the repetition rate is target over size.  Every document is emitted
floor(rate) times, plus once more when its seeded hash falls below the
fraction that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import BROADCAST_PAIRS, WORD_PATTERN, hash32, ordered_ranks, shuffle_width, source_key, staged
from quizlens.plans.sizing import broadcast_if_small

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = 3
#: Largest per-source table that is broadcast; beyond it the join is a shuffle join.
BROADCAST_SOURCES = 20_000
#: Equal rows that are written out one after the other; more of them are parted.
RUN = 65_536


def words(text_col: str):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(src, source_size, target)`` from rows of ``(src, size)``.

    Water filling: with a level L, a source gets ``min(cap, L * weight)``.
    Sources above their cap are fixed at it and L is computed anew from what
    is left, until no other source is above.  Only L (one number) and the
    number of capped sources are held on the driver.
    """
    per_source = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    ranks = ordered_ranks(per_source, ["src"], "rank", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = ranks.select("src", "source_size", weight.alias("w"),
                         (F.col("source_size") * F.lit(float(max_repeats))).alias("cap"))
    level, capped = 0.0, -1
    while True:
        over = (F.col("cap") < F.lit(level) * F.col("w")) if capped >= 0 else F.lit(False)
        row = table.agg(F.sum("source_size").alias("total"),
                        F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("fixed"),
                        F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w"),
                        F.count_if(over).alias("n")).first()
        if row["n"] == capped or not row["w"]:
            break
        capped, level = row["n"], (row["total"] - row["fixed"]) / row["w"]
    return table.select("src", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def text_key(text_col: str):
    """MD5 of a text in hexadecimal; a null text counts as empty."""
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def copies(seed: int, id_col: str, key_col: str, number):
    """Copies of a document: floor(rate), and one more with the fraction as its probability.

    ``number`` counts the rows that agree in source, id and text from 0, so
    each of them draws for itself.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    draw = hash32(seed, F.lit("copy"), name, F.col(key_col), number.cast("string")) / F.lit(4294967296.0)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _numbered(groups: DataFrame) -> DataFrame:
    """Each group ``n`` times over, with ``number`` from its ``first`` on.

    A large group is cut into runs that are spread before they are written
    out, so one that holds a third of all rows is many tasks.
    """
    runs = groups.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    if groups.where(F.col("n") > RUN).limit(1).count():
        runs = runs.repartition(shuffle_width(groups.sparkSession))
    last = F.least(F.col("__run") + F.lit(RUN), F.col("n")) - 1
    return (runs.withColumn("number", F.explode(F.sequence("__run", last)))
            .withColumn("number", F.col("number") + F.col("first")).drop("__run", "n", "first"))


def _places(variants: DataFrame) -> DataFrame:
    """``variants`` with ``first``, the rows of their (src, id, key) that come before them by ``whole``.

    Counted in slices of ``whole``, so that no task takes a whole (src, id, key).
    """
    group, part = ("src", "id", "key"), F.substring("whole", 1, 3)
    slices = variants.groupBy(*group, part.alias("part")).agg(F.sum("n").alias("rows"))
    offsets = slices.select(*[F.col(c).alias(f"o_{c}") for c in (*group, "part")],
                            (F.sum("rows").over(Window.partitionBy(*group).orderBy("part")) - F.col("rows")).alias("offset"))
    within = F.sum("n").over(Window.partitionBy(*group, "part").orderBy("whole")) - F.col("n")
    same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in (*group, "part")]
    return (variants.withColumn("part", part).withColumn("within", within).join(offsets, same)
            .withColumn("first", F.col("within") + F.col("offset")).select("src", "id", "key", "n", "row", "first"))


def _targets(sizes: DataFrame, weights, max_repeats) -> DataFrame:
    return broadcast_if_small(source_targets(sizes, weights, max_repeats), BROADCAST_SOURCES)[0]


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)``, one row per row of ``docs``.

    A null or empty text has size 0 and so adds nothing to what is taken; a
    null source is a source of its own, after all others.  Rows that repeat
    an id draw each for itself, also where they repeat the text.  A null id
    draws as an empty string.  An empty table gives an empty result.  Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), source_key(source_col).alias("src"), text_key(text_col).alias("key"),
                       words(text_col).alias("size"))
    groups = staged(rows.groupBy("doc_id", "src", "key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    table = _targets(groups.select("src", (F.col("size") * F.col("n")).alias("size")), weights, max_repeats)
    return (_numbered(groups.join(table, "src").withColumn("first", F.lit(0).cast("long")))
            .withColumn("copies", copies(seed, "doc_id", "key", F.col("number")))
            .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with their columns, each repeated as often as the mix takes it.

    The columns travel as one struct, so names used in here cannot clash with
    the table's own.  Nulls, empty texts and repeated rows: as in
    :func:`mix_plan`.  Rows that agree in source, id and text are counted in
    the order of their other columns, and whole copies as one row with its
    number; a table without such rows is not shuffled.
    """
    keys = docs.select(source_key(source_col).alias("src"), F.col(id_col).alias("id"), text_key(text_col).alias("key"),
                       words(text_col).alias("size"))
    counted = staged(keys.groupBy("src", "id", "key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    table = _targets(counted.select("src", (F.col("size") * F.col("n")).alias("size")), weights, max_repeats)
    rows = docs.select(source_key(source_col).alias("src"), F.col(id_col).alias("id"), text_key(text_col).alias("key"),
                       F.struct("*").alias("row"))
    again = counted.where(F.col("n") > 1).select(F.col("src").alias("s"), F.col("id").alias("i"), F.col("key").alias("k"))
    again, _ = broadcast_if_small(again, BROADCAST_PAIRS)
    same = (F.col("src") == F.col("s")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))
    once = rows.withColumn("number", F.lit(0).cast("long"))
    if not again.isEmpty():
        variants = (rows.join(again, same, "left_semi").withColumn("whole", F.sha2(F.to_json("row"), 256))
                    .groupBy("src", "id", "key", "whole").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row")))
        numbered = _numbered(staged(_places(staged(variants, "mix-variants")), "mix-copies"))
        once = once.join(again, same, "left_anti").unionByName(numbered.select(once.columns))
    many = once.join(table, "src").withColumn("copies", copies(seed, "id", "key", F.col("number"))).where(F.col("copies") > 0)
    return many.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
