"""Registered queries: one Spark job per operator plus its DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)``, reads the provided tables (through the
fixtures of FIXTURES.md) and returns a DataFrame whose column names match the
oracle SQL, so both engines can be compared row for row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlens.operators import joins, scores
from quizlens.plans import fixtures as fx
from quizlens.plans import oracle_sql as O
from quizlens.plans.sizing import broadcast_if_small, cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _mcqs(spark, sf):
    return fx.load(spark, sf, "mcqs")


def _sheets(spark, sf):
    return fx.load(spark, sf, "sheets")


# ------------------------------------------------------------ T1-T3, J4

@register("starts_with_negation", fx.cte("mcqs") + f"""
SELECT mcq_id, {O.negation('question')} AS starts_with_negation FROM mcqs""")
def q_negation(spark, sf):
    return scores.starts_with_negation(_mcqs(spark, sf)).select("mcq_id", "starts_with_negation")


@register("is_question", fx.cte("mcqs") + f"""
SELECT mcq_id, {O.question('question')} AS is_question FROM mcqs""")
def q_is_question(spark, sf):
    return scores.is_question(_mcqs(spark, sf)).select("mcq_id", "is_question")


@register("readability", fx.cte("mcqs") + f"""
SELECT mcq_id, {O.readability('question')} AS readability FROM mcqs""")
def q_readability(spark, sf):
    return scores.readability(_mcqs(spark, sf)).select("mcq_id", "readability")


@register("attach_sheet", fx.cte("mcqs", "sheets") + """
SELECT m.mcq_id, m.id, s.content_gpt FROM mcqs m LEFT JOIN sheets s ON m.id = s.id""")
def q_attach_sheet(spark, sf):
    return joins.attach_sheet(_mcqs(spark, sf), _sheets(spark, sf)).select("mcq_id", "id", "content_gpt")


# ------------------------------------------------------------ T4, T5

_QT = f"""qtok AS (SELECT mcq_id, {O.tokens('question')} AS tk FROM mcqs WHERE question IS NOT NULL),
qt AS (SELECT DISTINCT mcq_id, unnest({O.trigrams('tk')}) AS trigram FROM qtok)"""

def _paired_sql(extra: str = "") -> str:
    return fx.cte("mcqs", "sheets") + f""",
sk AS (SELECT id, content_gpt, sha256(content_gpt) AS skey FROM sheets),
merged AS (SELECT m.mcq_id, m.id, m.question, sk.content_gpt, sk.skey FROM mcqs m LEFT JOIN sk ON m.id = sk.id),
stok AS (SELECT skey, {O.tokens('content_gpt')} AS tk FROM sk WHERE skey IS NOT NULL),
st AS (SELECT DISTINCT skey, unnest({O.trigrams('tk')}) AS trigram FROM stok),
{_QT},
pairs AS (SELECT DISTINCT mcq_id, skey FROM merged WHERE skey IS NOT NULL),
counts AS (SELECT p.mcq_id, p.skey, count(*) AS n, count(st.trigram) AS seen
           FROM qt JOIN pairs p ON qt.mcq_id = p.mcq_id
           LEFT JOIN st ON st.skey = p.skey AND st.trigram = qt.trigram
           GROUP BY p.mcq_id, p.skey)
SELECT m.mcq_id, m.id,
       CASE WHEN m.question IS NULL OR m.content_gpt IS NULL THEN NULL
            WHEN c.n IS NULL THEN 0.0 ELSE (c.n - c.seen) / c.n END AS originality{extra}
FROM merged m LEFT JOIN counts c ON m.mcq_id = c.mcq_id AND m.skey = c.skey"""


@register("originality_paired", _paired_sql())
def q_originality_paired(spark, sf):
    return scores.originality_paired(_mcqs(spark, sf), _sheets(spark, sf)).select("mcq_id", "id", "originality")


@register("originality_corpus", fx.cte("mcqs", "sheets") + f""",
{_QT},
ctok AS (SELECT {O.tokens('content_gpt')} AS tk FROM sheets WHERE content_gpt IS NOT NULL),
ct AS (SELECT DISTINCT unnest({O.trigrams('tk')}) AS trigram FROM ctok),
counts AS (SELECT qt.mcq_id, count(*) AS n, count(ct.trigram) AS seen
           FROM qt LEFT JOIN ct ON qt.trigram = ct.trigram GROUP BY qt.mcq_id)
SELECT m.mcq_id,
       CASE WHEN m.question IS NULL THEN NULL
            WHEN c.n IS NULL THEN 0.0 ELSE (c.n - c.seen) / c.n END AS originality_corpus
FROM mcqs m LEFT JOIN counts c ON m.mcq_id = c.mcq_id""")
def q_originality_corpus(spark, sf):
    return (scores.originality_corpus(_mcqs(spark, sf), _sheets(spark, sf))
            .select("mcq_id", "originality_corpus"))


@register("originality_corpus_filtered", ORACLE["originality_corpus"])
def q_originality_corpus_filtered(spark, sf):
    """The same scores by the plan for vocabularies above the broadcast bound."""
    return (scores.originality_corpus(_mcqs(spark, sf), _sheets(spark, sf), broadcast_rows=0)
            .select("mcq_id", "originality_corpus"))


# ------------------------------------------------------------ helpers

from quizlens.functions import prompts as PR  # noqa: E402
from quizlens.functions import text as TX  # noqa: E402
from quizlens.operators import lemmas, models, responses, sheets as sheet_ops, tables  # noqa: E402
from quizlens.plans import jobs, stubs  # noqa: E402
from quizlens.session import scratch_path  # noqa: E402
from quizlens.sources import clustered, files, ranges, sheet_store  # noqa: E402

_S = ", ".join  # column list helper for SQL
_MCQ_FIELDS = responses.MCQ_FIELDS


def _fx(spark, sf, name):
    return fx.load(spark, sf, name)


def _tree_root(spark, sf) -> str:
    """Materialise the sheets_raw fixture as a folder tree of .txt files."""
    root = scratch_path(spark, "sheet-tree")
    files.write_text_tree(_fx(spark, sf, "sheets_raw"), root)
    return root


def _split_list(spark) -> DataFrame:
    path = scratch_path(spark, "split") + "/test_folders.json"
    files.write_text_file(spark, path, fx.TEST_FOLDERS_JSON)
    return files.read_split_list(spark, path)


_FOLDERS_SQL = _S(O.lit(f) for f in fx.TEST_FOLDERS)


# ------------------------------------------------------------ S, P1, P2, J

@register("read_sheet_tree", fx.cte("sheets_raw") + """
SELECT folder, id, content_raw FROM sheets_raw""")
def q_read_sheet_tree(spark, sf):
    return files.read_sheet_tree(spark, _tree_root(spark, sf))


@register("refresh_sheets", fx.cte("sheets_raw") + """
SELECT folder, id, CASE WHEN substring(id, -1) IN ('3', '8') THEN concat(content_raw, chr(10), 'second edition') ELSE content_raw END AS content_raw
FROM sheets_raw""")
def q_refresh_sheets(spark, sf):
    """The whole tree after two refreshes: between them a tenth of the files is added and a fifth is written again."""
    root, store = scratch_path(spark, "sheet-tree"), scratch_path(spark, "sheet-store")
    raw = _fx(spark, sf, "sheets_raw")
    end = F.substring("id", -1, 1)
    files.write_text_tree(raw.where(end != "7"), root)
    sheet_store.refresh_sheets(spark, root, store)
    files.write_text_tree(raw.where(end == "7"), root)
    second = F.concat("content_raw", F.lit("\nsecond edition")).alias("content_raw")
    files.write_text_tree(raw.where(end.isin("3", "8")).select("folder", "id", second), root)
    sheet_store.refresh_sheets(spark, root, store)
    return sheet_store.read_sheet_store(spark, store)


_META_SQL = fx.cte("sheets_raw") + ",\n" + O.metadata_ctes() + f"""
SELECT folder, id, {O.metadata_select()} FROM md4"""


@register("extract_sheet_metadata", _META_SQL)
def q_extract_sheet_metadata(spark, sf):
    return (sheet_ops.extract_sheet_metadata(_fx(spark, sf, "sheets_raw"))
            .select("folder", "id", "content_cleaned", "rubric"))


_KEPT_SQL = f"SELECT * FROM ({_META_SQL}) WHERE rubric IS NULL OR rubric <> 'Multimedia content'"


@register("drop_multimedia", _KEPT_SQL)
def q_drop_multimedia(spark, sf):
    return sheet_ops.drop_multimedia(q_extract_sheet_metadata(spark, sf))


@register("ingest_sheets", _KEPT_SQL)
def q_ingest_sheets(spark, sf):
    return (jobs.ingest_sheets(spark, _tree_root(spark, sf))
            .select("folder", "id", "content_cleaned", "rubric"))


@register("read_csv_table", fx.cte("mcqs") + f"""
SELECT {_S(f"nullif({c}, '') AS {c}" for c in ("id",) + _MCQ_FIELDS)} FROM mcqs""")
def q_read_csv_table(spark, sf):
    path = scratch_path(spark, "mcqs-csv")
    files.write_csv_table(_fx(spark, sf, "mcqs").drop("mcq_id"), path)
    return files.read_csv_table(spark, path, files.MCQS_SCHEMA)


@register("write_csv_table", fx.cte("sheets") + """
SELECT folder, id, nullif(content_gpt, '') AS content_gpt FROM sheets""")
def q_write_csv_table(spark, sf):
    path = scratch_path(spark, "sheets-csv")
    files.write_csv_table(_fx(spark, sf, "sheets"), path)
    return files.read_csv_table(spark, path, files.SHEETS_SCHEMA)


@register("read_json_records", fx.cte("exam_items") + """
SELECT id, question, cop, opa, opb, opc, opd FROM exam_items""")
def q_read_json_records(spark, sf):
    path = scratch_path(spark, "exam-json")
    files.write_json_records(_fx(spark, sf, "exam_items"), path)
    return files.read_json_records(spark, path, files.EXAM_SCHEMA)


# Ranges far below the usual size, so that each file of these tables has some.
SMALL_RANGE = 64 * 1024


@register("read_csv_ranges", ORACLE["read_csv_table"])
def q_read_csv_ranges(spark, sf):
    path = scratch_path(spark, "mcqs-csv")
    files.write_csv_table(_fx(spark, sf, "mcqs").drop("mcq_id"), path)
    return ranges.read_csv_ranges(spark, path, files.MCQS_SCHEMA, SMALL_RANGE)


@register("read_json_ranges", ORACLE["read_json_records"])
def q_read_json_ranges(spark, sf):
    path = scratch_path(spark, "exam-json")
    files.write_json_records(_fx(spark, sf, "exam_items"), path)
    return ranges.read_json_ranges(spark, path, files.EXAM_SCHEMA, SMALL_RANGE)


@register("test_split", fx.cte("sheets") + f"""
SELECT folder, id, content_gpt FROM sheets WHERE folder IN ({_FOLDERS_SQL})""")
def q_test_split(spark, sf):
    return joins.test_split(_sheets(spark, sf), _split_list(spark))


@register("train_split", fx.cte("sheets") + f"""
SELECT folder, id, content_gpt FROM sheets WHERE folder IS NULL OR folder NOT IN ({_FOLDERS_SQL})""")
def q_train_split(spark, sf):
    return joins.train_split(_sheets(spark, sf), _split_list(spark))


@register("test_split_partitioned", fx.cte("sheets") + f"""
SELECT folder, id, content_gpt FROM sheets WHERE folder IN ({_FOLDERS_SQL})""")
def q_test_split_partitioned(spark, sf):
    """J3 over sheets stored partitioned by folder: only the listed folders are read."""
    path = scratch_path(spark, "sheets-by-folder")
    files.write_sheets_table(_sheets(spark, sf), path)
    stored = files.read_sheets_table(spark, path)
    return joins.test_split(stored, _split_list(spark)).select("folder", "id", "content_gpt")


@register("semi_join_sheets", fx.cte("mcqs", "sheets") + """
SELECT folder, id FROM sheets WHERE id IN (SELECT id FROM mcqs)""")
def q_semi_join_sheets(spark, sf):
    return joins.semi_join_sheets(_sheets(spark, sf), _mcqs(spark, sf)).select("folder", "id")


@register("semi_join_mcqs", fx.cte("mcqs", "sheets") + """
SELECT mcq_id, id FROM mcqs WHERE id IN (SELECT id FROM sheets)""")
def q_semi_join_mcqs(spark, sf):
    return joins.semi_join_mcqs(_mcqs(spark, sf), _sheets(spark, sf)).select("mcq_id", "id")


@register("key_coverage", fx.cte("mcqs", "sheets") + """,
q AS (SELECT id, count(*) AS q_rows FROM mcqs GROUP BY id),
s AS (SELECT id, count(*) AS s_rows FROM sheets GROUP BY id),
b AS (SELECT q.q_rows, s.s_rows FROM q FULL OUTER JOIN s ON q.id = s.id)
SELECT 'mcq_rows' AS measure, CAST(coalesce(sum(q_rows), 0) AS BIGINT) AS value FROM b
UNION ALL SELECT 'sheet_rows', CAST(coalesce(sum(s_rows), 0) AS BIGINT) FROM b
UNION ALL SELECT 'mcq_ids', count(q_rows) FROM b
UNION ALL SELECT 'sheet_ids', count(s_rows) FROM b
UNION ALL SELECT 'mcq_ids_without_sheet', count(*) FILTER (WHERE s_rows IS NULL) FROM b
UNION ALL SELECT 'sheet_ids_without_mcq', count(*) FILTER (WHERE q_rows IS NULL) FROM b
UNION ALL SELECT 'duplicated_sheet_ids', count(*) FILTER (WHERE s_rows > 1) FROM b""")
def q_key_coverage(spark, sf):
    return joins.key_coverage(_mcqs(spark, sf), _sheets(spark, sf))


# ------------------------------------------------------------ R, P4-P8, A1

_MCQ_VALID = O.strict_record("response", _MCQ_FIELDS)
_ANS_VALID = O.strict_record("response", (responses.ANSWER_FIELD,))


def _validated_mcqs(spark, sf):
    return responses.validate_mcq_json(_fx(spark, sf, "model_outputs"), "response", "mcq")


@register("validate_mcq_json", fx.cte("model_outputs") + f"""
SELECT id, {_MCQ_VALID} AS valid, {_S(O.field('response', f, _MCQ_VALID) + ' AS ' + f for f in _MCQ_FIELDS)}
FROM model_outputs""")
def q_validate_mcq_json(spark, sf):
    v = _validated_mcqs(spark, sf)
    return v.select("id", F.col("mcq").isNotNull().alias("valid"), *[F.col(f"mcq.{f}").alias(f) for f in _MCQ_FIELDS])


@register("flatten_mcq", fx.cte("model_outputs") + f"""
SELECT CAST(id AS VARCHAR) AS id, {_S(O.field('response', f, _MCQ_VALID) + ' AS ' + f for f in _MCQ_FIELDS)}
FROM model_outputs""")
def q_flatten_mcq(spark, sf):
    v = _validated_mcqs(spark, sf).withColumn("id", F.col("id").cast("string"))
    return responses.flatten_mcq(v, "mcq", "id")


@register("fill_invalid_mcq", fx.cte("model_outputs") + f"""
SELECT id, {_S("coalesce(" + O.field('response', f, _MCQ_VALID) + ", '') AS " + f for f in _MCQ_FIELDS)}
FROM model_outputs""")
def q_fill_invalid_mcq(spark, sf):
    return responses.flatten_mcq(responses.fill_invalid_mcq(_validated_mcqs(spark, sf)), "mcq", "id")


@register("find_invalid", fx.cte("model_outputs") + f"""
SELECT id FROM model_outputs WHERE NOT {_MCQ_VALID}""")
def q_find_invalid(spark, sf):
    return responses.find_invalid(_validated_mcqs(spark, sf))


def _answers(spark, sf):
    v = responses.validate_answer_json(_fx(spark, sf, "answer_outputs"), "response", "answer")
    return v.withColumn("answer_option", F.col("answer")[responses.ANSWER_FIELD])


_ANS_OPTION = O.field("response", responses.ANSWER_FIELD, _ANS_VALID)
_UPPER_SQL = "upper(replace(a, 'ß', 'SS'))"      # the sharp s has a capital of its own in DuckDB
_REMAP_SQL = (f"CASE {_UPPER_SQL} " + " ".join(f"WHEN {O.lit(k)} THEN {O.lit(v)}" for k, v in responses.ANSWER_REMAP.items())
              + f" ELSE {_UPPER_SQL} END")


@register("validate_answer_json", fx.cte("answer_outputs") + f"""
SELECT id, temperature, {_ANS_OPTION} AS answer_option FROM answer_outputs""")
def q_validate_answer_json(spark, sf):
    return _answers(spark, sf).select("id", "temperature", "answer_option")


@register("remap_values", fx.cte("answer_outputs") + f"""
SELECT id, temperature, {_REMAP_SQL} AS model_answer FROM (SELECT id, temperature, {_ANS_OPTION} AS a FROM answer_outputs)""")
def q_remap_values(spark, sf):
    up = responses.normalise_answer(_answers(spark, sf), "answer_option", "model_answer")
    return responses.remap_values(up, "model_answer").select("id", "temperature", "model_answer")


@register("normalise_answer", fx.cte("answer_outputs") + f"""
SELECT id, temperature, model_answer, substring(ltrim(model_answer, {O.WS_CHARS}), 1, 1) AS first_letter FROM (
  SELECT id, temperature, {_REMAP_SQL} AS model_answer FROM (SELECT id, temperature, {_ANS_OPTION} AS a FROM answer_outputs))""")
def q_normalise_answer(spark, sf):
    df = models.model_answers(_fx(spark, sf, "answer_outputs"), "response", "model_answer")
    df = responses.normalise_answer(df, "model_answer", "first_letter", first_letter=True)
    return df.select("id", "temperature", "model_answer", "first_letter")


@register("distinct_values", fx.cte("answer_outputs") + f"""
SELECT DISTINCT {_REMAP_SQL} AS model_answer FROM (SELECT {_ANS_OPTION} AS a FROM answer_outputs)""")
def q_distinct_values(spark, sf):
    df = models.model_answers(_fx(spark, sf, "answer_outputs"), "response", "model_answer")
    return tables.distinct_values(df, "model_answer")


@register("response_report", fx.cte("answer_outputs") + f"""
SELECT temperature, count(*) AS n_rows, count(*) FILTER (WHERE {_ANS_VALID}) AS n_valid,
       count(*) FILTER (WHERE NOT {_ANS_VALID}) AS n_invalid
FROM answer_outputs GROUP BY temperature""")
def q_response_report(spark, sf):
    return responses.response_report(_answers(spark, sf), "answer", ["temperature"])


_PARSE_M = r"regexp_extract(response, '(?s)(\{.*\})', 1)"


@register("parse_response", fx.cte("model_outputs") + f"""
SELECT id, CASE WHEN m <> '' AND coalesce(json_valid(m), false) THEN
    CASE WHEN NOT json_exists(m, '$.answer') THEN m
         WHEN json_type(m, '$.answer') = 'NULL' THEN NULL
         WHEN json_type(m, '$.answer') = 'VARCHAR' THEN m ->> '$.answer'
         ELSE CAST(json_extract(m, '$.answer') AS VARCHAR) END
  ELSE {O.strip('response')} END AS parsed
FROM (SELECT id, response, {_PARSE_M} AS m FROM model_outputs)""")
def q_parse_response(spark, sf):
    return responses.parse_response(_fx(spark, sf, "model_outputs")).select("id", "parsed")


# ------------------------------------------------------------ P3, O1-O4, T6, T7

@register("project_columns", fx.cte("mcqs") + f"""
SELECT {_S(("id",) + _MCQ_FIELDS)} FROM mcqs""")
def q_project_columns(spark, sf):
    return tables.project_columns(_mcqs(spark, sf), ["id", *_MCQ_FIELDS])


@register("restore_order", fx.cte("mcqs") + f"""
SELECT mcq_id, {O.readability('question')} AS readability FROM mcqs ORDER BY mcq_id""")
def q_restore_order(spark, sf):
    return tables.restore_order(scores.readability(_mcqs(spark, sf)).select("mcq_id", "readability"), ["mcq_id"])


HEAD_ROWS = 50


@register("head_n", fx.cte("mcqs") + f"""
SELECT mcq_id, id FROM mcqs ORDER BY mcq_id LIMIT {HEAD_ROWS}""")
def q_head_n(spark, sf):
    return tables.head_n(_mcqs(spark, sf).select("mcq_id", "id"), HEAD_ROWS, ["mcq_id"])


@register("union_batches", fx.cte("answer_outputs") + f"""
SELECT id, temperature, {_ANS_OPTION} AS answer_option, CAST(NULL AS VARCHAR) AS note
FROM answer_outputs WHERE temperature < 0.6
UNION ALL
SELECT id, temperature, {_ANS_OPTION} AS answer_option, 'last run' AS note
FROM answer_outputs WHERE temperature > 0.6""")
def q_union_batches(spark, sf):
    a = _answers(spark, sf).select("id", "temperature", "answer_option")
    runs = [a.where(F.col("temperature") == t) for t in (0.1, 0.5)]
    runs.append(a.where(F.col("temperature") == 0.7).withColumn("note", F.lit("last run")))
    return tables.union_batches(runs)


@register("set_difference", fx.cte("mcqs", "sheets") + f""",
qtok AS (SELECT mcq_id, id, {O.tokens('question')} AS tk FROM mcqs WHERE question IS NOT NULL),
qt AS (SELECT DISTINCT mcq_id, id, unnest({O.trigrams('tk')}) AS trigram FROM qtok),
stok AS (SELECT id, {O.tokens('content_gpt')} AS tk FROM sheets
         WHERE content_gpt IS NOT NULL AND id IN (SELECT id FROM mcqs)),
st AS (SELECT DISTINCT id, unnest({O.trigrams('tk')}) AS trigram FROM stok)
SELECT mcq_id, trigram FROM qt
WHERE id IN (SELECT id FROM sheets WHERE content_gpt IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM st WHERE st.id = qt.id AND st.trigram = qt.trigram)""")
def q_set_difference(spark, sf):
    return scores.trigram_difference(_mcqs(spark, sf), _sheets(spark, sf))


# A (form, lemma) table from the data: words of the sheets with an ending, without it.  "es" and "s"
# both end some words, so a form can have two lemmas; the smaller one counts.
_LEMMAS_SQL = f"""words AS (SELECT DISTINCT unnest({O.tokens('content_gpt')}) AS form FROM sheets WHERE content_gpt IS NOT NULL),
lemma_rows AS (SELECT form, substring(form, 1, length(form) - 1) AS lemma FROM words WHERE length(form) > 4 AND form LIKE '%s'
    UNION ALL SELECT form, substring(form, 1, length(form) - 2) AS lemma FROM words WHERE length(form) > 4 AND form LIKE '%es'),
lem AS (SELECT form, min(lemma) AS lemma FROM lemma_rows GROUP BY form),
q0 AS (SELECT row_number() OVER () AS rid, mcq_id, id, question FROM mcqs),
s0 AS (SELECT row_number() OVER () AS rid, id, content_gpt FROM sheets),
qp AS (SELECT rid, unnest(tk) AS w, generate_subscripts(tk, 1) AS pos FROM (SELECT rid, {O.tokens('question')} AS tk FROM q0 WHERE question IS NOT NULL)),
sp AS (SELECT rid, unnest(tk) AS w, generate_subscripts(tk, 1) AS pos FROM (SELECT rid, {O.tokens('content_gpt')} AS tk FROM s0 WHERE content_gpt IS NOT NULL)),
ql AS (SELECT rid, list(coalesce(lemma, w) ORDER BY pos) AS tk FROM qp LEFT JOIN lem ON form = w GROUP BY rid),
sl AS (SELECT rid, list(coalesce(lemma, w) ORDER BY pos) AS tk FROM sp LEFT JOIN lem ON form = w GROUP BY rid),
qt AS (SELECT DISTINCT q0.rid, q0.mcq_id, q0.id, unnest({O.trigrams('tk')}) AS trigram FROM ql JOIN q0 USING (rid)),
st AS (SELECT DISTINCT s0.rid, s0.id, unnest({O.trigrams('tk')}) AS trigram FROM sl JOIN s0 USING (rid))"""


def _lemma_table(spark, sf) -> DataFrame:
    words = _sheets(spark, sf).select(F.explode(TX.content_tokens("content_gpt")).alias("form")).distinct()
    # Both cuts of a word in one pass over the sheets; what ends in "es" ends in "s".
    cut = [F.when(F.col("form").endswith(end), F.expr(f"substring(form, 1, length(form) - {len(end)})")) for end in ("s", "es")]
    long = words.where((F.length("form") > 4) & F.col("form").endswith("s"))
    return cut_lineage(long.select("form", F.explode(F.array_compact(F.array(*cut))).alias("lemma")))


@register("originality_paired_lemmas", fx.cte("mcqs", "sheets") + f""",
{_LEMMAS_SQL},
counts AS (SELECT qt.rid, s0.rid AS srid, count(*) AS n, count(st.trigram) AS seen FROM qt JOIN s0 ON qt.id = s0.id
    LEFT JOIN st ON st.rid = s0.rid AND st.trigram = qt.trigram GROUP BY qt.rid, s0.rid)
SELECT q0.mcq_id, q0.id, CASE WHEN question IS NULL OR content_gpt IS NULL THEN NULL WHEN n IS NULL THEN 0.0
    ELSE (n - seen) / n END AS originality
FROM q0 LEFT JOIN s0 ON q0.id = s0.id LEFT JOIN counts ON counts.rid = q0.rid AND counts.srid = s0.rid""")
def q_originality_paired_lemmas(spark, sf):
    out = scores.originality_paired(_mcqs(spark, sf), _sheets(spark, sf), lemmas=_lemma_table(spark, sf))
    return out.select("mcq_id", "id", "originality")


@register("score_questions_lemmas", ORACLE["originality_paired_lemmas"])
def q_score_questions_lemmas(spark, sf):
    """Job A with a lemma table: the same scores as T4's."""
    out = jobs.score_questions(_mcqs(spark, sf), _sheets(spark, sf), compute_relevance=False, compute_ambiguity=False,
                               lemmas=_lemma_table(spark, sf))
    return out.select("mcq_id", "id", "originality")


@register("set_difference_lemmas", fx.cte("mcqs", "sheets") + f""",
{_LEMMAS_SQL}
SELECT mcq_id, trigram FROM qt WHERE id IN (SELECT id FROM s0 WHERE content_gpt IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM st WHERE st.id = qt.id AND st.trigram = qt.trigram)""")
def q_set_difference_lemmas(spark, sf):
    return scores.trigram_difference(_mcqs(spark, sf), _sheets(spark, sf), lemmas=_lemma_table(spark, sf))


@register("content_tokens", fx.cte("mcqs") + f""",
qtok AS (SELECT mcq_id, {O.tokens('question')} AS tk FROM mcqs)
SELECT mcq_id, CAST(generate_subscripts(tk, 1) - 1 AS INTEGER) AS pos, unnest(tk) AS token FROM qtok""")
def q_content_tokens(spark, sf):
    m = _mcqs(spark, sf)
    return m.select("mcq_id", F.posexplode(TX.content_tokens("question")).alias("pos", "token"))


LENGTH_BOUNDS = (8, 60)


@register("length_score", fx.cte("mcqs") + f"""
SELECT mcq_id, CASE WHEN n IS NULL THEN NULL
  WHEN n >= {LENGTH_BOUNDS[0]} AND n <= {LENGTH_BOUNDS[1]} THEN 1.0
  WHEN n > {LENGTH_BOUNDS[1]} THEN ({float(LENGTH_BOUNDS[1])}::DOUBLE / n) * ({float(LENGTH_BOUNDS[1])}::DOUBLE / n)
  ELSE (n / {float(LENGTH_BOUNDS[0])}::DOUBLE) * (n / {float(LENGTH_BOUNDS[0])}::DOUBLE) END AS length_score
FROM (SELECT mcq_id, {O.word_count('question')} AS n FROM mcqs)""")
def q_length_score(spark, sf):
    return scores.length_score(_mcqs(spark, sf), *LENGTH_BOUNDS).select("mcq_id", "length_score")


# ------------------------------------------------------------ T8, T9, A3

# Vectors are broadcast only when their rows and bytes are measured to be few.
VECTOR_BROADCAST_ROWS = 100_000


def _vectors(spark, sf) -> DataFrame:
    emb = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return broadcast_if_small(emb, VECTOR_BROADCAST_ROWS)[0]


_ALL_SQL = "(SELECT count(*) FROM embeddings)"


@register("relevance", fx.cte("mcqs") + f"""
SELECT m.mcq_id, round({O.cosine('q.embedding', 's.embedding')}, 6) AS relevance
FROM mcqs m
LEFT JOIN embeddings q ON q.vec_id = m.mcq_id % {_ALL_SQL}
LEFT JOIN embeddings s ON s.vec_id = (m.mcq_id * 7 + 3) % {_ALL_SQL}""")
def q_relevance(spark, sf):
    """Every question and every sheet has a vector, taken in turn from the embeddings table."""
    emb = _vectors(spark, sf)
    n = fx.table(spark, sf, "embeddings").count()
    qv = emb.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    sv = emb.select(F.col("vec_id").alias("s_id"), F.col("embedding").alias("s_vec"))
    pairs = (_mcqs(spark, sf).select("mcq_id", (F.col("mcq_id") % n).alias("q_id"), ((F.col("mcq_id") * 7 + 3) % n).alias("s_id"))
             .join(qv, "q_id", "left").join(sv, "s_id", "left"))
    return (scores.relevance(pairs, "q_vec", "s_vec")
            .select("mcq_id", F.round("relevance", 6).alias("relevance")))


def _option_vectors(spark, sf) -> DataFrame:
    n = fx.table(spark, sf, "embeddings").count()
    emb = _vectors(spark, sf)
    m = _mcqs(spark, sf)
    opts = m.select("mcq_id", F.inline(F.array(*[
        F.struct(F.lit(l).alias("letter"), ((F.col("mcq_id") * 4 + k) % n).alias("vec_id"))
        for k, l in enumerate(scores.OPTION_LETTERS)])))
    return opts.join(emb, "vec_id", "left").select("mcq_id", "letter", "embedding")


_OV_SQL = ",\nov AS (" + " UNION ALL ".join(
    f"SELECT m.mcq_id, '{l}' AS letter, e.embedding FROM mcqs m LEFT JOIN embeddings e "
    f"ON e.vec_id = (4 * m.mcq_id + {k}) % {_ALL_SQL}" for k, l in enumerate("abcd")) + ")"

_AMB_SQL = fx.cte("mcqs") + _OV_SQL + f""",
sims AS (SELECT m.mcq_id, {O.cosine('c.embedding', 'o.embedding')} AS sim
         FROM mcqs m JOIN ov c ON c.mcq_id = m.mcq_id AND c.letter = lower(m.correct_option)
         JOIN ov o ON o.mcq_id = m.mcq_id AND o.letter <> lower(m.correct_option))"""


@register("ambiguity", _AMB_SQL + """
SELECT m.mcq_id, CASE WHEN m.correct_option IS NULL THEN NULL
  WHEN lower(m.correct_option) NOT IN ('a', 'b', 'c', 'd') THEN 0.0
  ELSE round((SELECT sum(sim) FROM sims WHERE sims.mcq_id = m.mcq_id) / 3, 6) END AS ambiguity
FROM mcqs m""")
def q_ambiguity(spark, sf):
    out = scores.ambiguity(_mcqs(spark, sf), _option_vectors(spark, sf))
    return out.select("mcq_id", F.round("ambiguity", 6).alias("ambiguity"))


@register("mean_over_options", _AMB_SQL + """
SELECT m.mcq_id, CASE WHEN m.correct_option IS NULL THEN NULL
  WHEN lower(m.correct_option) NOT IN ('a', 'b', 'c', 'd') THEN 0.0
  ELSE round((SELECT avg(sim) FROM sims WHERE sims.mcq_id = m.mcq_id), 6) END AS mean_similarity
FROM mcqs m""")
def q_mean_over_options(spark, sf):
    """A3 as an array mean: the cosines to the non-correct options, averaged."""
    from quizlens.functions.vectors import cosine

    ov = _option_vectors(spark, sf)
    vecs = ov.groupBy("mcq_id").agg(F.map_from_entries(F.collect_list(F.struct("letter", "embedding"))).alias("v"))
    m = _mcqs(spark, sf).select("mcq_id", F.lower("correct_option").alias("c")).join(vecs, "mcq_id", "left")
    c = F.col("c")
    others = F.filter(F.array(*[F.lit(x) for x in scores.OPTION_LETTERS]), lambda x: x != c)
    sims = F.transform(others, lambda x: cosine(F.try_element_at("v", c), F.try_element_at("v", x)))
    # Three options are left where the correct letter is one of the four.
    m = m.withColumns({f"sim{k}": F.get(sims, F.lit(k)) for k in range(3)})
    mean = tables.mean_over(["sim0", "sim1", "sim2"])
    score = (F.when(c.isNull(), F.lit(None).cast("double"))
             .when(~c.isin(*scores.OPTION_LETTERS), F.lit(0.0))
             .otherwise(F.round(mean, 6)))
    return m.select("mcq_id", score.alias("mean_similarity"))


# ------------------------------------------------------------ summary, job A

def _scored(spark, sf):
    m = _mcqs(spark, sf)
    return m.withColumns({"readability": TX.readability("question"),
                          "starts_with_negation": TX.starts_with_negation("question"),
                          "is_question": TX.is_question("question"),
                          "length_score": TX.length_score("question", *LENGTH_BOUNDS)})


_SUMMARY_COLS = ("readability", "starts_with_negation", "is_question", "length_score")


def _length_sql(n: str) -> str:
    lo, hi = (float(x) for x in LENGTH_BOUNDS)
    return (f"CASE WHEN {n} IS NULL THEN NULL WHEN {n} >= {lo} AND {n} <= {hi} THEN 1.0 "
            f"WHEN {n} > {hi} THEN ({hi}::DOUBLE / {n}) * ({hi}::DOUBLE / {n}) "
            f"ELSE ({n} / {lo}::DOUBLE) * ({n} / {lo}::DOUBLE) END")


_SUMMARY_SQL = fx.cte("mcqs") + f""",
sc AS (SELECT {O.readability('question')} AS readability,
              CAST({O.negation('question')} AS DOUBLE) AS starts_with_negation,
              CAST({O.question('question')} AS DOUBLE) AS is_question,
              {_length_sql(O.word_count('question'))} AS length_score FROM mcqs)
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS score, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
    f"round(avg({c}), 6) AS mean, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM sc"
    for c in _SUMMARY_COLS)


@register("score_summary", _SUMMARY_SQL)
def q_score_summary(spark, sf):
    s = scores.score_summary(_scored(spark, sf), list(_SUMMARY_COLS))
    return s.select("score", "n_rows", "n_null", F.round("mean", 6).alias("mean"),
                    F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


@register("score_questions", _paired_sql(f""",
       {O.readability('m.question')} AS readability, {O.negation('m.question')} AS starts_with_negation,
       {O.question('m.question')} AS is_question"""))
def q_score_questions(spark, sf):
    df = jobs.score_questions(_mcqs(spark, sf), _sheets(spark, sf), compute_relevance=False,
                              compute_ambiguity=False)
    return df.select("mcq_id", "id", "originality", "readability", "starts_with_negation", "is_question")


# ------------------------------------------------------------ G1-G3

_JUDGE_SQL_PARTS = ["'Context:' || chr(10) || '-----' || chr(10)", "coalesce(s.content_gpt, '')",
                    "chr(10) || '-----' || chr(10)", "'-----' || chr(10)", "'Question:' || chr(10)",
                    "coalesce(m.question, '')", "chr(10)", "'Options:' || chr(10)",
                    "'a) '", "coalesce(m.option_a, '')", "chr(10) || 'b) '", "coalesce(m.option_b, '')",
                    "chr(10) || 'c) '", "coalesce(m.option_c, '')", "chr(10) || 'd) '", "coalesce(m.option_d, '')",
                    "chr(10)", "'Correct option: '", "coalesce(m.correct_option, '')", "chr(10)",
                    "'-----' || chr(10)"]


@register("build_judge_prompt", fx.cte("mcqs", "sheets") + f"""
SELECT m.mcq_id, {' || '.join(_JUDGE_SQL_PARTS)} AS prompt
FROM mcqs m LEFT JOIN sheets s ON m.id = s.id""")
def q_build_judge_prompt(spark, sf):
    df = joins.attach_sheet(_mcqs(spark, sf), _sheets(spark, sf))
    return df.select("mcq_id", PR.judge_prompt(context_col="content_gpt").alias("prompt"))


@register("build_generation_prompt", fx.cte("sheets") + f"""
SELECT id, {O.lit(PR.GENERATION_TEMPLATE_HEAD)} || coalesce(content_gpt, '') || {O.lit(PR.GENERATION_TEMPLATE_TAIL)} AS prompt
FROM sheets""")
def q_build_generation_prompt(spark, sf):
    return _sheets(spark, sf).select("id", PR.generation_prompt("content_gpt").alias("prompt"))


_EXAM_SQL_PARTS = [O.lit(PR.EXAM_TEMPLATE_HEAD), "coalesce(question, '')", O.lit(PR.EXAM_TEMPLATE_OPTIONS)]
for _label, _c in zip(PR.EXAM_OPTION_LABELS, ("opa", "opb", "opc", "opd")):
    _EXAM_SQL_PARTS += [O.lit(_label), f"coalesce({_c}, '')"]
_EXAM_SQL_PARTS.append(O.lit(PR.EXAM_TEMPLATE_TAIL))


# Exceptions by invention; the lexicon is the words of the questions, the forms are those of the sheets.
_EXCEPTIONS = (("than", "thing"), ("onan", "an"), ("ofed", "nowhere"), ("hes", "her"), ("ation", "ing"))


@register("noun_lemmas", fx.cte("mcqs", "sheets") + f""",
forms AS (SELECT DISTINCT unnest({O.tokens('content_gpt')}) AS form FROM sheets WHERE content_gpt IS NOT NULL),
lexicon AS (SELECT DISTINCT unnest({O.tokens('question')}) AS lemma FROM mcqs WHERE question IS NOT NULL),
exceptions AS (SELECT * FROM (VALUES {_S(f"({O.lit(a)}, {O.lit(b)})" for a, b in _EXCEPTIONS)}) e(form, lemma)),
endings AS (SELECT * FROM (VALUES {_S(f"({O.lit(a)}, {O.lit(b)})" for a, b in lemmas.NOUN_ENDINGS)}) e(ending, put)),
plain AS (SELECT form FROM forms WHERE form NOT IN (SELECT form FROM exceptions)),
one AS (SELECT form, left(form, length(form) - length(ending)) || put AS c FROM plain, endings WHERE ends_with(form, ending)),
two AS (SELECT form, left(c, length(c) - length(ending)) || put AS c FROM one, endings WHERE ends_with(c, ending)),
three AS (SELECT form, left(c, length(c) - length(ending)) || put AS c FROM two, endings WHERE ends_with(c, ending)),
candidates AS (SELECT form, 1 AS r, form AS c FROM forms UNION ALL SELECT form, 1, c FROM one UNION ALL SELECT form, 2, c FROM two
    UNION ALL SELECT form, 3, c FROM three UNION ALL SELECT f.form, 1, e.lemma FROM forms f JOIN exceptions e USING (form)),
found AS (SELECT form, arg_min(c, (r, length(c), c <> form, c)) AS lemma FROM candidates WHERE c IN (SELECT lemma FROM lexicon) GROUP BY form)
SELECT form, lemma FROM found WHERE form <> lemma""")
def q_noun_lemmas(spark, sf):
    words = {c: df.select(F.explode(TX.content_tokens(c)).alias("word")) for df, c in ((_sheets(spark, sf), "content_gpt"), (_mcqs(spark, sf), "question"))}
    exceptions = spark.createDataFrame(_EXCEPTIONS, "form string, lemma string")
    return lemmas.noun_lemmas(words["content_gpt"], words["question"], exceptions, "word", "word")


@register("build_exam_prompt", fx.cte("exam_items") + f"""
SELECT id, {' || '.join(_EXAM_SQL_PARTS)} AS prompt FROM exam_items""")
def q_build_exam_prompt(spark, sf):
    return _fx(spark, sf, "exam_items").select("id", PR.exam_prompt().alias("prompt"))


# ------------------------------------------------------------ model-backed

JUDGE_SYSTEM = "Rate the question from 1 to 5. Answer with one digit."


def _judge_sql(context: bool = False, options: bool = True) -> str:
    """The judge prompt of a question row ``m`` (and its sheet ``s``)."""
    return " || ".join(_JUDGE_SQL_PARTS[0 if context else 3:7] + (_JUDGE_SQL_PARTS[7:17] if options else []) + _JUDGE_SQL_PARTS[17:])


def _size_sql(prompt: str, system: str | None = JUDGE_SYSTEM, temperature: str = str(models.JUDGE_TEMPERATURE)) -> str:
    """:func:`stubs.request_size` of a request."""
    return f"(length({prompt}) + {len(system or '')} + CAST(round(10 * {temperature}) AS BIGINT))"


def _verdict_sql(context: bool = False, options: bool = True) -> str:
    return f"CAST({_size_sql(_judge_sql(context, options))} % 5 + 1 AS VARCHAR)"


@register("llm_map", fx.cte("mcqs") + f""",
sized AS (SELECT mcq_id, {_size_sql(_judge_sql())} AS n FROM mcqs m)
SELECT mcq_id, CASE WHEN n % 13 <> 0 THEN CAST(n % 5 + 1 AS VARCHAR) END AS verdict FROM sized""")
def q_llm_map(spark, sf):
    df = _mcqs(spark, sf).select("mcq_id", PR.judge_prompt().alias("prompt"))
    return models.llm_map(df, "prompt", "verdict", stubs.StubJudge(fail_every=13),
                          system=JUDGE_SYSTEM).select("mcq_id", "verdict")


@register("llm_map_stored", ORACLE["llm_map"])
def q_llm_map_stored(spark, sf):
    """The same run with its raw answers kept in a folder; the result is read back from there."""
    df = _mcqs(spark, sf).select("mcq_id", PR.judge_prompt().alias("prompt"))
    return models.llm_map(df, "prompt", "verdict", stubs.StubJudge(fail_every=13), system=JUDGE_SYSTEM,
                          store=scratch_path(spark, "answers")).select("mcq_id", "verdict")


def _letters_sql(x: str) -> str:
    """:class:`stubs.LetterEmbedder` of a text, as a list of floats."""
    text = f"coalesce({x}, '')"
    counts = [f"(length({text}) - length(replace({text}, '{c}', '')))" for c in stubs.LetterEmbedder.LETTERS]
    return (f"(SELECT list_transform(n, lambda c: CAST(CASE WHEN list_dot_product(n, n) = 0 THEN 0.0 "
            f"ELSE c / sqrt(list_dot_product(n, n)) END AS FLOAT)) FROM (SELECT CAST([{_S(counts)}] AS DOUBLE[]) AS n))")


@register("embed_texts", fx.cte("sheets") + f"""
SELECT id, list_transform({_letters_sql('content_gpt')}, lambda v: round(v::DOUBLE, 4)) AS embedding FROM sheets""")
def q_embed_texts(spark, sf):
    out = models.embed_texts(_sheets(spark, sf), "content_gpt", stubs.LetterEmbedder())
    return out.select("id", F.transform("embedding", lambda v: F.round(v.cast("double"), 4)).alias("embedding"))


@register("embed_texts_bucketed", fx.cte("sheets") + f""",
cut AS (SELECT id, array_to_string(regexp_extract_all(content_gpt, {O.lit(stubs.WordTokenizer.PATTERN)})
                                   [1:{models.EMBED_TOKENS - models.EMBED_SPECIAL_TOKENS}], ' ') AS body FROM sheets)
SELECT id, list_transform({_letters_sql('body')}, lambda v: round(v::DOUBLE, 4)) AS embedding FROM cut""")
def q_embed_texts_bucketed(spark, sf):
    out = models.embed_texts_bucketed(_sheets(spark, sf), "content_gpt", stubs.LetterEmbedder(), stubs.WordTokenizer())
    return out.select("id", F.transform("embedding", lambda v: F.round(v.cast("double"), 4)).alias("embedding"))


_CLEAN_PROMPT_SQL = f"{O.lit(PR.CLEANING_USER_HEAD)} || coalesce(content_cleaned, '')"
_UNWIKI_SQL = f"regexp_replace(body, {O.lit(r'\[\[|\]\]|' + chr(39) + '{2,3}')}, '', 'g')"


@register("clean_sheets", f"""
WITH kept AS ({_KEPT_SQL}),
sized AS (SELECT id, coalesce(content_cleaned, '') AS body,
    {_size_sql(_CLEAN_PROMPT_SQL, PR.CLEANING_SYSTEM_PROMPT, str(models.CLEANING_TEMPERATURE))} AS n FROM kept)
SELECT id, CASE WHEN n % 17 <> 0 THEN {O.strip(_UNWIKI_SQL)} END AS content_gpt FROM sized""")
def q_clean_sheets(spark, sf):
    kept = sheet_ops.drop_multimedia(sheet_ops.extract_sheet_metadata(_fx(spark, sf, "sheets_raw")))
    return models.clean_sheets(kept, stubs.StubCleaner()).select("id", "content_gpt")


# What the stub generator makes of a request of size n, as JSON text.
_GENERATED_SQL = ("""'{"question": "What about ' || n || '?", "option_a": "' || n % 7 || '", "option_b": ' || """
                  """CASE WHEN n % 6 = 0 THEN CAST(n % 11 AS VARCHAR) ELSE '"' || n % 11 || '"' END || """
                  """', "option_c": "' || n % 13 || '", "option_d": "' || n % 17 || '", "correct_option": "' || """
                  """substring('abcd', CAST(n % 4 + 1 AS INT), 1) || '"}'""")
_GENERATION_PROMPT_SQL = (f"{O.lit(PR.GENERATION_TEMPLATE_HEAD)} || coalesce(content_gpt, '') || "
                          f"{O.lit(PR.GENERATION_TEMPLATE_TAIL)}")
_RUNS_SQL = fx.cte("sheets") + f""",
temps AS (SELECT unnest([{_S(f"{t}::DOUBLE" for t in models.GENERATION_TEMPERATURES)}]) AS temperature),
runs AS (SELECT id, temperature, {_size_sql(_GENERATION_PROMPT_SQL, None, "temperature")} AS n
         FROM sheets, temps WHERE folder IN ({_FOLDERS_SQL}))"""


@register("generate_questions", _RUNS_SQL + f"""
SELECT id, temperature, {_GENERATED_SQL} AS response FROM runs""")
def q_generate_questions(spark, sf):
    base = joins.test_split(_sheets(spark, sf), _split_list(spark))
    return models.generate_questions(base.select("id", "content_gpt"), stubs.StubGenerator()).select(
        "id", "temperature", "response")


@register("generate_questions_stored", ORACLE["generate_questions"])
def q_generate_questions_stored(spark, sf):
    """The same run in two halves on one folder of answers: the second asks only what the first left."""
    base = joins.test_split(_sheets(spark, sf), _split_list(spark)).select("id", "content_gpt")
    store = scratch_path(spark, "generated")
    models.generate_questions(base.where(F.crc32(F.col("id").cast("binary")) % 2 == 0), stubs.StubGenerator(), store=store)
    return models.generate_questions(base, stubs.StubGenerator(), store=store).select("id", "temperature", "response")


@register("generate_questions_job", _RUNS_SQL + f""",
made AS (SELECT id, temperature, {_GENERATED_SQL} AS response FROM runs)
SELECT id, temperature, {_MCQ_VALID} AS valid,
    {_S("coalesce(" + O.field('response', f, _MCQ_VALID) + ", '') AS " + f for f in _MCQ_FIELDS)} FROM made""")
def q_generate_questions_job(spark, sf):
    return jobs.generate_questions_job(_sheets(spark, sf), _split_list(spark), stubs.StubGenerator())


def _criterion(fn, name, out_col, context=False, options=True):
    @register(name, fx.cte("mcqs", "sheets") + f"""
SELECT m.mcq_id, {_verdict_sql(context, options)} AS {out_col} FROM mcqs m LEFT JOIN sheets s ON m.id = s.id""")
    def q(spark, sf):
        df = joins.attach_sheet(_mcqs(spark, sf), _sheets(spark, sf))
        return fn(df, JUDGE_SYSTEM, stubs.StubJudge(), out_col).select("mcq_id", out_col)
    return q


_criterion(models.answerability, "answerability", "gpt_answer", context=True)
_criterion(models.disclosure, "disclosure", "disclosure", options=False)
_criterion(models.difficulty, "difficulty", "difficulty")
_criterion(models.distractors_quality, "distractors_quality", "distractors_quality")


_ANSWERS = stubs.StubExamAnswerer.ANSWERS
_EXAM_RUNS_SQL = fx.cte("exam_items") + f""",
runs AS (SELECT unnest([{_S(O.lit(r) for r in models.EXAM_RUNS)}]) AS run, unnest([{_S(f"{t}::DOUBLE" for t in models.EXAM_RUNS.values())}]) AS temperature),
sized AS (SELECT e.*, run, temperature, {_size_sql(' || '.join(_EXAM_SQL_PARTS), None, "temperature")} AS n FROM exam_items e, runs),
said AS (SELECT *, ([{_S(O.lit(x) for x in _ANSWERS)}])[CAST(n % {len(_ANSWERS)} + 1 AS INT)] AS a FROM sized),
answered AS (SELECT *, {_REMAP_SQL} AS model_answer FROM said)"""


@register("answer_exam", _EXAM_RUNS_SQL + """
SELECT id, run, temperature, model_answer FROM answered""")
def q_answer_exam(spark, sf):
    return jobs.answer_exams(_fx(spark, sf, "exam_items"), stubs.StubExamAnswerer()).select(
        "id", "run", "temperature", "model_answer")


@register("exam_results", _EXAM_RUNS_SQL + f"""
SELECT {_S(jobs.EXAM_RESULT_COLS)} FROM answered WHERE run = '0.7'""")
def q_exam_results(spark, sf):
    return jobs.exam_results(jobs.answer_exams(_fx(spark, sf, "exam_items"), stubs.StubExamAnswerer()), "0.7")


_CORRECT_SQL = "CASE lower(correct_option) " + " ".join(f"WHEN '{x}' THEN {x}" for x in "abcd") + " END"
_AMBIGUITY_SQL = " + ".join(f"CASE WHEN letter = '{x}' THEN 0.0 ELSE {O.cosine('r', x)} END" for x in "abcd")


@register("score_questions_full", fx.cte("mcqs", "sheets") + f""",
corpus AS ({ORACLE['originality_corpus']}),
vecs AS (SELECT mcq_id, lower(correct_option) AS letter, correct_option, {_S(f"{_letters_sql('option_' + x)} AS {x}" for x in 'abcd')} FROM mcqs),
amb AS (SELECT mcq_id, CASE WHEN letter IS NULL THEN NULL WHEN letter NOT IN ('a', 'b', 'c', 'd') THEN 0.0 ELSE ({_AMBIGUITY_SQL}) / 3 END AS ambiguity
    FROM (SELECT *, {_CORRECT_SQL} AS r FROM vecs)),
qv AS (SELECT mcq_id, {_letters_sql('question')} AS v FROM mcqs),
sv AS (SELECT id, content_gpt, {_letters_sql('content_gpt')} AS v FROM sheets)
SELECT m.mcq_id, m.id, CASE WHEN m.question IS NOT NULL AND s.content_gpt IS NOT NULL THEN round({O.cosine('qv.v', 's.v')}, 5) END AS relevance,
    round(amb.ambiguity, 5) AS ambiguity, corpus.originality_corpus, {_verdict_sql(True)} AS gpt_answer,
    {_verdict_sql(options=False)} AS disclosure, {_verdict_sql()} AS difficulty, {_verdict_sql()} AS distractors_quality
FROM mcqs m LEFT JOIN sv s ON m.id = s.id JOIN corpus ON corpus.mcq_id = m.mcq_id JOIN amb ON amb.mcq_id = m.mcq_id
JOIN qv ON qv.mcq_id = m.mcq_id""")
def q_score_questions_full(spark, sf):
    out = jobs.score_questions(
        _mcqs(spark, sf), _sheets(spark, sf), compute_corpus_originality=True,
        completer=stubs.StubJudge(), embedder=stubs.LetterEmbedder(),
        answerability_system_prompt=JUDGE_SYSTEM, disclosure_system_prompt=JUDGE_SYSTEM,
        difficulty_system_prompt=JUDGE_SYSTEM, distractors_quality_system_prompt=JUDGE_SYSTEM)
    return out.select("mcq_id", "id", F.round("relevance", 5).alias("relevance"), F.round("ambiguity", 5).alias("ambiguity"),
                      "originality_corpus", "gpt_answer", "disclosure", "difficulty", "distractors_quality")


@register("score_csv_job", fx.cte("mcqs", "sheets") + f"""
SELECT m.id, {O.readability("nullif(question, '')")} AS readability,
    {O.negation("nullif(question, '')")} AS starts_with_negation, nullif(s.content_gpt, '') AS content_gpt
FROM mcqs m LEFT JOIN sheets s ON m.id = s.id""")
def q_score_csv_job(spark, sf):
    """Question and sheet CSV files in, scored questions as a CSV file out, read back; all of them gzip files."""
    paths = [scratch_path(spark, f"job-{x}") for x in ("mcqs", "sheets", "scored")]
    files.write_csv_table(_fx(spark, sf, "mcqs").drop("mcq_id"), paths[0], compression="gzip")
    files.write_csv_table(_sheets(spark, sf), paths[1], compression="gzip")
    jobs.score_csv_job(spark, *paths, compute_originality=False, compute_relevance=False, compute_ambiguity=False,
                       compute_is_question=False, compression="gzip")
    kinds = {"readability": "double", "starts_with_negation": "boolean"}
    names = spark.read.options(**files.CSV_OPTIONS).csv(paths[2]).columns
    read = files.read_csv_table(spark, paths[2], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    return read.select("id", "readability", "starts_with_negation", "content_gpt")


@register("score_csv_shipped", fx.cte("mcqs") + f"""
SELECT m.id, nullif(question, '') AS question, CAST({_size_sql(_judge_sql())} % 5 + 1 AS VARCHAR) AS distractors_quality FROM mcqs m""")
def q_score_csv_shipped(spark, sf):
    """The command as it ships: no merge, the judge of the distractors alone, every column of the question file kept."""
    paths = [scratch_path(spark, f"shipped-{x}") for x in ("mcqs", "scored")]
    files.write_csv_table(_fx(spark, sf, "mcqs").drop("mcq_id"), paths[0], compression="gzip")
    off = {f"compute_{x}": False for x in ("originality", "readability", "negation", "is_question", "relevance", "ambiguity")}
    jobs.score_csv_job(spark, paths[0], None, paths[1], merge=False, completer=stubs.StubJudge(),
                       distractors_quality_system_prompt=JUDGE_SYSTEM, compression="gzip", **off)
    return files.read_csv_header(spark, paths[1]).select("id", "question", "distractors_quality")


# ------------------------------------------------------------ joins of tables stored by id

def _clustered(spark, sf):
    """The question and sheet tables, stored by their id."""
    out = []
    for name in ("mcqs", "sheets"):
        path = scratch_path(spark, f"{name}-clustered")
        out.append(clustered.write_clustered(_fx(spark, sf, name), f"quizlens_{path.rsplit('-', 1)[1]}", path))
    return out


@register("attach_sheet_clustered", ORACLE["attach_sheet"])
def q_attach_sheet_clustered(spark, sf):
    return clustered.joined(*_clustered(spark, sf), joins.attach_sheet).select("mcq_id", "id", "content_gpt")


@register("originality_paired_clustered", ORACLE["originality_paired"])
def q_originality_paired_clustered(spark, sf):
    return clustered.joined(*_clustered(spark, sf), scores.originality_paired).select("mcq_id", "id", "originality")


@register("semi_join_sheets_clustered", ORACLE["semi_join_sheets"])
def q_semi_join_sheets_clustered(spark, sf):
    mcqs, sheets = _clustered(spark, sf)
    return clustered.joined(sheets, mcqs, joins.semi_join_sheets).select("folder", "id")


@register("semi_join_mcqs_clustered", ORACLE["semi_join_mcqs"])
def q_semi_join_mcqs_clustered(spark, sf):
    return clustered.joined(*_clustered(spark, sf), joins.semi_join_mcqs).select("mcq_id", "id")
