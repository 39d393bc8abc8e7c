"""Sheet preparation: metadata block extraction (P1) and the rubric filter.

The wiki-style block ``{{knowledge objective ... }}`` at the top of a sheet
holds ``|key=value`` lines.  Extraction is pure column work: ``locate`` and
``substring`` cut the block, ``split``/``filter``/``transform`` parse its
handful of lines, ``try_element_at(.., -1)`` keeps the last value of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlens.functions.text import py_strip

# Block markers, the wanted keys in output order, the rubric
# value that marks a sheet as multimedia, and the output layout pieces.
BLOCK_START = "{{knowledge objective"
BLOCK_END = "}}"
METADATA_KEYS = ("Item_parent", "Title", "Description", "Item", "Rubric")
MULTIMEDIA_RUBRIC = "Multimedia content"
VALUE_TRAILING_CHARS = ",}"
PROPERTY_SEPARATOR = ";\n"
PROPERTIES_END = ";\n\n"


def _properties(block: Column) -> Column:
    """array<struct<k,v>> of the block's ``key=value`` lines, in line order."""
    lines = F.transform(F.split(block, "\n"), lambda l: py_strip(l))
    with_eq = F.filter(lines, lambda l: F.instr(l, "=") > 0)
    return F.transform(with_eq, lambda l: F.struct(
        F.trim(F.substring_index(l, "=", 1), F.lit("|")).alias("k"),
        F.rtrim(py_strip(F.substring(l, F.instr(l, "=") + 1, 1 << 30)), F.lit(VALUE_TRAILING_CHARS)).alias("v"),
    ))


def _last_value(props: Column, key: str) -> Column:
    return F.try_element_at(F.filter(props, lambda p: p["k"] == key), F.lit(-1))["v"]


def extract_sheet_metadata(df: DataFrame, input_col: str = "content_raw",
                           content_col: str = "content_cleaned",
                           rubric_col: str = "rubric") -> DataFrame:
    """Add the cleaned content (properties first, then the body) and the rubric.

    Without a block, or with a block that never closes, the content passes
    through untouched and the rubric is ``''``.  Text before the block is
    dropped.  A NULL input gives NULL content and rubric.
    """
    c = F.col(input_col)
    tmp = df.withColumn("_start", F.locate(BLOCK_START, c))
    tmp = tmp.withColumn("_end", F.when(F.col("_start") > 0,
                                       F.expr(f"locate('{BLOCK_END}', `{input_col}`, _start)")).otherwise(0))
    has_block = (F.col("_start") > 0) & (F.col("_end") > 0)
    block = F.substring(c, F.col("_start"), F.col("_end") + 2 - F.col("_start"))
    tmp = tmp.withColumn("_props", F.when(has_block, _properties(block)))
    tmp = tmp.withColumn("_rest", F.when(has_block, py_strip(F.substring(c, F.col("_end") + 2, 1 << 30))))
    formatted = []
    for key in METADATA_KEYS:
        v = _last_value(F.col("_props"), key)
        formatted.append(F.when(F.length(v) > 0, F.concat(F.lit(f"**{key}:** "), v)))
    body = F.concat_ws(PROPERTY_SEPARATOR, *formatted)
    head = F.when(F.length(body) > 0, F.concat(body, F.lit(PROPERTIES_END))).otherwise(F.lit(""))
    cleaned = F.when(has_block, F.concat(head, F.col("_rest"))).otherwise(c)
    rubric = F.when(c.isNull(), F.lit(None).cast("string")).when(
        has_block, F.coalesce(_last_value(F.col("_props"), "Rubric"), F.lit(""))).otherwise(F.lit(""))
    return (tmp.withColumn(content_col, cleaned)
            .withColumn(rubric_col, rubric)
            .drop("_start", "_end", "_props", "_rest"))


def drop_multimedia(df: DataFrame, rubric_col: str = "rubric") -> DataFrame:
    """Keep sheets whose rubric is not exactly the multimedia marker (empty kept)."""
    return df.where(F.col(rubric_col).isNull() | (F.col(rubric_col) != MULTIMEDIA_RUBRIC))
