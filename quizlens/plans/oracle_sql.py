"""DuckDB SQL fragments that restate each rule independently of Spark.

These build the oracle side of the correctness check: the same semantics
written with DuckDB's list and regex functions (RE2), run on the same
parquet tables.  Only the fixed values are shared with the Spark side.
"""

from __future__ import annotations

from quizlens.functions.text import (
    ENGLISH_STOP_WORDS, FUSED_WORDS, NEGATION_WORDS, PY_WHITESPACE_CODEPOINTS,
    QUESTION_WORDS,
)

WS_CLASS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WORD = r"\pL\pN_"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


WS_CHARS = " || ".join(f"chr({cp})" for cp in PY_WHITESPACE_CODEPOINTS)


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS_CLASS}]+')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def sentence_count(x: str) -> str:
    return (f"(length({x}) - length(replace(replace(replace({x}, '.', ''), '!', ''), '?', '')))")


def syllables(x: str) -> str:
    return (f"list_sum(list_transform({words(x)}, "
            f"lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')))))")


def readability(x: str) -> str:
    w, s, y = word_count(x), sentence_count(x), syllables(x)
    return (f"CASE WHEN {w} > 0 AND {s} > 0 THEN "
            f"0.39::DOUBLE * ({w}::DOUBLE / {s}) + 11.8::DOUBLE * ({y}::DOUBLE / {w}) - 15.59::DOUBLE END")


def _starts_with(x: str, words_) -> str:
    alt = "|".join(words_)
    return f"regexp_matches({strip(x)}, {lit('(?i)^(' + alt + ')([^' + WORD + ']|$)')})"


def negation(x: str) -> str:
    return _starts_with(x, NEGATION_WORDS)


def question(x: str) -> str:
    return f"(ends_with({strip(x)}, '?') OR {_starts_with(x, QUESTION_WORDS)})"


def tokens(x: str) -> str:
    cleaned = f"trim(lower(regexp_replace({x}, '[^{WORD}]+', ' ', 'g')))"
    split = f"list_filter(string_split({cleaned}, ' '), lambda t: t <> '')"
    cases = " ".join(f"WHEN {lit(a + b)} THEN [{lit(a)}, {lit(b)}]" for a, b in FUSED_WORDS)
    fused = f"flatten(list_transform({split}, lambda t: CASE t {cases} ELSE [t] END))"
    return f"list_filter({fused}, lambda t: NOT list_contains({str_list(ENGLISH_STOP_WORDS)}, t))"


def trigrams(tk: str) -> str:
    """Distinct 'a b c' trigrams of a token-list column ``tk``."""
    return (f"list_distinct(list_transform(range(1, len({tk}) - 1), "
            f"lambda i: {tk}[i] || ' ' || {tk}[i + 1] || ' ' || {tk}[i + 2]))")


def dot(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def cosine(a: str, b: str) -> str:
    na = f"sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])))"
    nb = f"sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"
    return f"({dot(a, b)} / greatest({na} * {nb}, 1e-8))"


def metadata_ctes(src: str = "sheets_raw", col: str = "content_raw") -> str:
    """CTEs ``md1..md3`` restating the metadata-block rules over ``src``."""
    props = (f"list_transform(list_filter(list_transform(string_split(substring({col}, s, e + 2 - s), chr(10)), "
             f"lambda l: {strip('l')}), lambda l: contains(l, '=')), "
             f"lambda l: {{'k': trim(split_part(l, '=', 1), '|'), "
             f"'v': rtrim({strip('substring(l, strpos(l, ' + lit('=') + ') + 1)')}, ',}}')}})")
    return f"""md1 AS (SELECT *, strpos({col}, '{{{{knowledge objective') AS s FROM {src}),
md2 AS (SELECT *, CASE WHEN s > 0 THEN strpos(substring({col}, s), '}}}}') ELSE 0 END AS rel FROM md1),
md3 AS (SELECT *, (s > 0 AND rel > 0) AS has_block, s + rel - 1 AS e FROM md2),
md4 AS (SELECT *, CASE WHEN has_block THEN {props} END AS props,
               CASE WHEN has_block THEN {strip(f'substring({col}, e + 2)')} END AS rest FROM md3)"""


def metadata_select(col: str = "content_raw", keys=("Item_parent", "Title", "Description", "Item", "Rubric")) -> str:
    def last(k):
        return f"list_filter(props, lambda p: p.k = {lit(k)})[-1].v"
    parts = ", ".join(f"CASE WHEN length({last(k)}) > 0 THEN {lit('**' + k + ':** ')} || {last(k)} END" for k in keys)
    body = f"concat_ws(';' || chr(10), {parts})"
    return (f"CASE WHEN has_block THEN (CASE WHEN length({body}) > 0 THEN {body} || ';' || chr(10) || chr(10) ELSE '' END) || rest "
            f"ELSE {col} END AS content_cleaned, "
            f"CASE WHEN {col} IS NULL THEN NULL WHEN has_block THEN coalesce({last('Rubric')}, '') ELSE '' END AS rubric")


def strict_record(x: str, fields) -> str:
    """Struct-free form: a boolean validity test of a strict JSON object with string fields."""
    cond = " AND ".join(f"coalesce(json_type({x}, '$.{f}') = 'VARCHAR', false)" for f in fields)
    return (f"(coalesce(json_valid({x}), false) AND "
            f"CASE WHEN json_valid({x}) THEN json_type({x}) = 'OBJECT' AND {cond} ELSE false END)")


def field(x: str, f: str, valid: str) -> str:
    return f"CASE WHEN {valid} THEN {x} ->> '$.{f}' END"
