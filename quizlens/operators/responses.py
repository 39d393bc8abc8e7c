"""Model responses: strict JSON validation (R1-R2), parsing (R3), reports
and the MCQ / answer clean-up steps (P4-P8).

Strict parsing: the response is wrapped as ``[response, "#end#"]`` and parsed
with ``try_parse_json``; it is valid only if that gives a two-element array
whose second element is the marker, so trailing text or a second value is
rejected.  Fields must be JSON strings (numbers are not coerced); extra keys
are ignored; duplicate keys resolve last-wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlens.functions.text import py_lstrip, py_strip

# The MCQ record's fields, the answer record's field, the
# end marker of the strict parse, and the answer clean-up dictionary.
MCQ_FIELDS = ("question", "option_a", "option_b", "option_c", "option_d", "correct_option")
ANSWER_FIELD = "answer_option"
END_MARK = "#end#"
ANSWER_REMAP = {"": "A", "3": "D", "0": "A", "1": "B"}
RESPONSE_ANSWER_KEY = "answer"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def allow_duplicate_keys(spark) -> None:
    """Duplicate JSON keys resolve last-wins (the validator being reproduced
    accepts them); Spark rejects them unless this runtime option is on."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strict_json(text: str | Column) -> Column:
    """Variant ``[value, "#end#"]`` or NULL; read fields under ``$[0]``."""
    wrapped = F.concat(F.lit("["), _col(text), F.lit(f',"{END_MARK}"]'))
    return F.try_parse_json(wrapped)


def _strict_ok(v: Column) -> Column:
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce((F.size(items) == 2)
                      & (F.try_variant_get(v, "$[1]", "string") == END_MARK), F.lit(False))


def _is_string(v: Column, field: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$[0].{field}", "variant")) == "STRING",
                      F.lit(False))


def record_json(text: str | Column, fields) -> Column:
    """struct of string ``fields`` when ``text`` is a strict JSON object holding
    all of them as strings, else NULL."""
    v = strict_json(text)
    ok = _strict_ok(v)
    for f in fields:
        ok = ok & _is_string(v, f)
    rec = F.struct(*[F.try_variant_get(v, f"$[0].{f}", "string").alias(f) for f in fields])
    return F.when(ok, rec)


def validate_mcq_json(df: DataFrame, response_col: str = "response", out_col: str = "mcq") -> DataFrame:
    """The six-field MCQ record or NULL."""
    allow_duplicate_keys(df.sparkSession)
    return df.withColumn(out_col, record_json(response_col, MCQ_FIELDS))


def validate_answer_json(df: DataFrame, response_col: str = "response", out_col: str = "answer") -> DataFrame:
    """R2: the one-field answer record or NULL."""
    allow_duplicate_keys(df.sparkSession)
    return df.withColumn(out_col, record_json(response_col, (ANSWER_FIELD,)))


def parse_response_col(text: str | Column) -> Column:
    """R3 as a Column: greedy first ``{`` to last ``}``; field ``answer`` if
    the object parses (JSON null -> NULL, non-string -> its JSON text), the
    object text when the field is absent, else the stripped response."""
    t = _col(text)
    obj = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    v = strict_json(obj)
    parsed = (F.length(obj) > 0) & _strict_ok(v)
    ans = F.try_variant_get(v, f"$[0].{RESPONSE_ANSWER_KEY}", "variant")
    picked = (F.when(ans.isNull(), obj)
              .when(F.is_variant_null(ans), F.lit(None).cast("string"))
              .when(F.schema_of_variant(ans) == "STRING", F.try_variant_get(ans, "$", "string"))
              .otherwise(F.to_json(ans)))
    return F.when(parsed, picked).otherwise(py_strip(t))


def parse_response(df: DataFrame, response_col: str = "response", out_col: str = "parsed") -> DataFrame:
    allow_duplicate_keys(df.sparkSession)
    return df.withColumn(out_col, parse_response_col(response_col))


def response_report(df: DataFrame, record_col: str, by: list[str]) -> DataFrame:
    """Rows, valid and invalid counts per run (replaces printed messages)."""
    return (df.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col(record_col).isNotNull()).alias("n_valid"),
                 F.count_if(F.col(record_col).isNull()).alias("n_invalid")))


def flatten_mcq(df: DataFrame, mcq_col: str = "mcq", id_col: str = "id") -> DataFrame:
    """Id plus the six MCQ fields as columns."""
    return df.select(id_col, *[F.col(f"{mcq_col}.{f}").alias(f) for f in MCQ_FIELDS])


def fill_invalid_mcq(df: DataFrame, mcq_col: str = "mcq") -> DataFrame:
    """P5: an invalid MCQ becomes one with six empty strings."""
    empty = F.struct(*[F.lit("").alias(f) for f in MCQ_FIELDS])
    return df.withColumn(mcq_col, F.coalesce(F.col(mcq_col), empty))


def find_invalid(df: DataFrame, mcq_col: str = "mcq", id_col: str = "id") -> DataFrame:
    """Ids whose validated value is missing."""
    return df.where(F.col(mcq_col).isNull()).select(id_col)


def remap_values(df: DataFrame, col: str, mapping: dict[str, str] = ANSWER_REMAP,
                 out_col: str | None = None) -> DataFrame:
    """Replace whole values found in ``mapping``; others pass through."""
    c = F.col(col)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    expr = c if expr is None else expr.otherwise(c)
    return df.withColumn(out_col or col, expr)


def normalise_answer(df: DataFrame, col: str, out_col: str = "model_answer",
                     first_letter: bool = False) -> DataFrame:
    """Upper-case; with ``first_letter`` also keep the first character
    after left-stripping (empty string stays empty)."""
    up = F.upper(F.col(col))
    if first_letter:
        up = F.substring(py_lstrip(up), 1, 1)
    return df.withColumn(out_col, up)
