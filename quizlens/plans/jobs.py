"""The toolkit's three jobs, each one Spark plan built from the operators.

A. :func:`score_questions` - left join questions to sheets, add every enabled
   score (expressions, trigram joins, vector joins, model criteria).
B. :func:`ingest_sheets` - sheet tree -> metadata -> rubric filter -> optional
   model clean-up.
C. :func:`generate_questions_job` / :func:`answer_exams` - split, generate,
   validate, repair, flatten; and the exam-answering runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlens.functions import prompts as PR
from quizlens.functions import text as TX
from quizlens.functions.vectors import cosine
from quizlens.operators import joins, models, responses, scores, sheets as sheet_ops
from quizlens.plans.sizing import cut_lineage
from quizlens.sources import files, sheet_store

OPTION_COLS = ("option_a", "option_b", "option_c", "option_d")


def _text_key(c) -> F.Column:
    return F.sha2(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")), 256)


def text_vectors(texts: DataFrame, embedder: models.EmbedderFactory, text_col: str = "text") -> DataFrame:
    """``(_tkey, embedding)`` for the distinct texts of ``texts``; embedded once
    and checkpointed, since several scores join against it."""
    return cut_lineage(models.key_vectors(texts, text_col, embedder))


def score_questions(mcqs: DataFrame, sheets: DataFrame | None = None, *,
                    merge: bool = True, key_col: str = "mcq_id", sheet_id_col: str = "id",
                    sheet_col: str = "content_gpt",
                    question_col: str = "question", option_a_col: str = "option_a",
                    option_b_col: str = "option_b", option_c_col: str = "option_c",
                    option_d_col: str = "option_d", correct_option_col: str = "correct_option",
                    compute_originality: bool = True, originality_col: str = "originality",
                    compute_corpus_originality: bool = False,
                    corpus_originality_col: str = "originality_corpus",
                    compute_readability: bool = True, readability_col: str = "readability",
                    compute_negation: bool = True, negation_col: str = "starts_with_negation",
                    compute_is_question: bool = True, is_question_col: str = "is_question",
                    compute_relevance: bool = True, relevance_col: str = "relevance",
                    compute_ambiguity: bool = True, ambiguity_col: str = "ambiguity",
                    compute_answerability: bool = True, answerability_col: str = "gpt_answer",
                    answerability_system_prompt: str | None = None,
                    compute_disclosure: bool = True, disclosure_col: str = "disclosure",
                    disclosure_system_prompt: str | None = None,
                    compute_difficulty: bool = True, difficulty_col: str = "difficulty",
                    difficulty_system_prompt: str | None = None,
                    compute_distractors_quality: bool = True,
                    distractors_quality_col: str = "distractors_quality",
                    distractors_quality_system_prompt: str | None = None,
                    completer: models.CompleterFactory | None = None,
                    embedder: models.EmbedderFactory | None = None,
                    vectors: DataFrame | None = None,
                    stop_words=TX.ENGLISH_STOP_WORDS, lemmas: dict[str, str] | DataFrame | None = None,
                    temp: float = models.JUDGE_TEMPERATURE,
                    max_completion_tokens: int = models.JUDGE_MAX_TOKENS, store: str | None = None) -> DataFrame:
    """Score every question row; each enabled criterion adds one column.

    ``merge=True`` left-joins ``sheets`` (J4) to bring ``sheet_col``;
    with ``merge=False`` the question table must already hold it, if a
    criterion that is asked for reads the sheet (both originalities,
    relevance, answerability); others need no sheet at all.  Vector
    scores need ``vectors`` (``text``, ``embedding``) or an ``embedder``;
    model criteria need a ``completer`` and their system prompt (G12).  A bad
    row yields NULL in the affected score only.  ``key_col`` identifies a
    question row.  ``store`` names a folder that keeps the model's answers (see
    :func:`quizlens.operators.models.llm_map`).

    A criterion that has its prompt but no ``completer`` is an error, not a
    missing column.  ``lemmas`` and ``stop_words`` go to both originality
    scores.

    Plan: row-local scores and tokens are added on each table's own
    partitions; the wide rows meet in the sheet join, where paired
    originality is a set comparison inside the row.  Vector scores and corpus
    originality are computed on narrow tables keyed by question or by
    (question, sheet text), of distinct keys, and joined once more.  Model
    criteria come before those joins and send their prompts alone into Python.
    """
    sheet = sheet_col
    option_cols = (option_a_col, option_b_col, option_c_col, option_d_col)
    criteria = [
        (compute_answerability, answerability_system_prompt, answerability_col,
         dict(include_options=True, include_correct_option=True, context_col=sheet)),
        (compute_disclosure, disclosure_system_prompt, disclosure_col,
         dict(include_options=False, include_correct_option=True)),
        (compute_difficulty, difficulty_system_prompt, difficulty_col,
         dict(include_options=True, include_correct_option=True)),
        (compute_distractors_quality, distractors_quality_system_prompt, distractors_quality_col,
         dict(include_options=True, include_correct_option=True)),
    ]
    asked = [c for c in criteria if c[0] and c[1] is not None]     # G12
    if asked and completer is None:
        raise ValueError(f"{', '.join(c[2] for c in asked)}: a system prompt is given but no completer")

    exprs = {}
    if compute_readability:
        exprs["_fk"] = TX.readability_counts(question_col)
    if compute_negation:
        exprs[negation_col] = TX.starts_with_negation(question_col)
    if compute_is_question:
        exprs[is_question_col] = TX.is_question(question_col)
    base = mcqs.withColumns(exprs) if exprs else mcqs
    if compute_readability:
        base = base.withColumn(readability_col, TX.readability_from_counts("_fk")).drop("_fk")
    if compute_originality:
        tokens = scores.RowTokens(stop_words, lemmas)
        base = tokens.add(base, question_col, "_qtk")

    if merge:
        if sheets is None:
            raise ValueError("merge=True needs the sheets table")
        sk = scores.sheet_keys(sheets, sheet_id_col, sheet)
        side = tokens.add(sk, sheet, "_stk") if compute_originality else sk
        wide = base.join(side.withColumnRenamed("id", sheet_id_col), sheet_id_col, "left")     # J4
        cites = mcqs.select(key_col, F.col(sheet_id_col).alias("id"))
        pairs = cites.join(sk.select("id", "_skey"), "id").select(key_col, "_skey").distinct()
        corpus = sheets
    elif not (compute_originality or compute_corpus_originality or compute_relevance):
        wide, sk = base, None       # nothing reads a sheet
    else:
        wide = base.withColumn("_skey", F.sha2(F.col(sheet), 256))
        sk = wide.where(F.col("_skey").isNotNull()).select("_skey", sheet).dropDuplicates(["_skey"])
        pairs = wide.where(F.col("_skey").isNotNull()).select(key_col, "_skey").distinct()
        if compute_originality:
            wide = tokens.add(wide, sheet, "_stk")
        corpus = sk
    out = wide
    if compute_originality:
        out = tokens.novelty(out, "_qtk", "_stk", originality_col)

    cols = dict(question_col=question_col, option_a_col=option_a_col, option_b_col=option_b_col,
                option_c_col=option_c_col, option_d_col=option_d_col,
                correct_option_col=correct_option_col)
    # G6-G9 in one pass over the rows, before the scores are joined: the texts
    # that only the prompts need do not travel any further.
    requests = [(PR.judge_prompt(**cols, **layout), out_name, system, temp, max_completion_tokens)
                for _, system, out_name, layout in asked]
    out = models.llm_map_many(out, requests, completer, store=store)
    answers = [r[1] for r in requests]
    # The joins below ask only whether there is a question: its text need not travel for that.
    out = out.withColumn("_noq", F.col(question_col).isNull())

    per_key = []            # tables with one row per question
    if compute_corpus_originality:
        cc = scores.corpus_counts(mcqs, corpus, key_col, question_col, sheet, stop_words, lemmas).select(
            key_col, F.col("_n").alias("_cn"), F.col("_seen").alias("_cseen"))
        per_key.append((cc, corpus_originality_col,
                        F.when(F.col("_noq"), F.lit(None).cast("double"))
                        .when(F.col("_cn").isNull(), F.lit(0.0))
                        .otherwise((F.col("_cn") - F.col("_cseen")) / F.col("_cn"))))
    if compute_relevance or compute_ambiguity:
        vt = _vectors_for(mcqs, sk, vectors, embedder, question_col, sheet, option_cols)
    if compute_ambiguity:
        long = scores.options_long(mcqs, key_col, option_cols)
        ov = (long.withColumn("_tkey", _text_key("option_text"))
              .join(vt, "_tkey", "left").select(key_col, "letter", "embedding"))
        per_key.append((scores.option_vector_maps(ov, key_col), ambiguity_col,
                        scores.ambiguity_from_map(correct_option_col, "_vecs")))
    if per_key:
        narrow = per_key[0][0]
        for table, _, _ in per_key[1:]:
            narrow = narrow.join(table, key_col, "full")
        out = out.join(narrow, key_col, "left")
        for _, name, expr in per_key:
            out = out.withColumn(name, expr)
    if compute_relevance:
        qv = (mcqs.select(key_col, _text_key(question_col).alias("_tkey")).distinct()
              .join(vt, "_tkey").select(key_col, F.col("embedding").alias("_qv")))
        sv = vt.select(F.col("_tkey").alias("_skey"), F.col("embedding").alias("_sv"))
        rel = pairs.join(qv, key_col).join(sv, "_skey").select(key_col, "_skey", cosine("_qv", "_sv").alias("_rel"))
        # A NULL sheet key finds no row; a NULL question has a vector but no score.
        out = out.join(rel, [key_col, "_skey"], "left").withColumn(
            relevance_col, F.when(~F.col("_noq"), F.col("_rel")))
    helpers = {"_noq", "_skey", "_cn", "_cseen", "_rel", "_vecs"}
    out = out.drop(*[c for c in out.columns if c in helpers])
    last = [a for a in answers if a not in wide.columns]
    return out.select(*[c for c in out.columns if c not in last], *last) if last else out


def _vectors_for(mcqs, sk, vectors, embedder, question_col, sheet_col, option_cols) -> DataFrame:
    """``(_tkey, embedding)`` for every question, sheet and option text; the least of several vectors of a text."""
    if vectors is not None:
        return vectors.groupBy(_text_key("text").alias("_tkey")).agg(F.min("embedding").alias("embedding"))
    if embedder is None:
        raise ValueError("vector scores need `vectors` or an `embedder`")
    texts = mcqs.select(F.col(question_col).alias("text"))
    if sk is not None:
        texts = texts.unionByName(sk.select(F.col(sheet_col).alias("text")))
    for c in option_cols:
        texts = texts.unionByName(mcqs.select(F.col(c).alias("text")))
    return text_vectors(texts, embedder, "text")


def ingest_sheets(spark: SparkSession, root: str, completer: models.CompleterFactory | None = None,
                  drop_multimedia: bool = True, output: str | None = None, store: str | None = None) -> DataFrame:
    """Job B: read the tree, extract metadata, drop multimedia sheets, and
    (with a completer) add the model-cleaned text ``content_gpt``.  A failed
    call leaves NULL; no row is lost.

    With ``output`` the result is compacted once into Parquet partitioned by
    folder and read back from there: later jobs scan a few columnar files
    instead of one small text file per sheet, and folder splits prune.  With
    ``store`` the texts come from a stored copy of the tree, for which only
    files that are new or changed since the last run are read.
    """
    if store is not None:
        sheet_store.refresh_sheets(spark, root, store)
    raw = files.read_sheet_tree(spark, root) if store is None else sheet_store.read_sheet_store(spark, store)
    df = sheet_ops.extract_sheet_metadata(raw)
    if drop_multimedia:
        df = sheet_ops.drop_multimedia(df)
    if completer is not None:
        df = models.clean_sheets(df, completer)
    if output is not None:
        files.write_sheets_table(df, output)
        return files.read_sheets_table(spark, output)
    return df


def generate_questions_job(sheets: DataFrame, folders: DataFrame | None,
                           completer: models.CompleterFactory, content_col: str = "content_gpt",
                           temperatures=models.GENERATION_TEMPERATURES,
                           fill_invalid: bool = True, store: str | None = None) -> DataFrame:
    """Job C: test split -> generation per temperature -> strict validation ->
    repair of invalid records -> flat MCQ rows ``(id, temperature, fields...)``."""
    base = joins.test_split(sheets, folders) if folders is not None else sheets
    gen = models.generate_questions(base.select("id", content_col), completer, content_col,
                                    temperatures, store=store)
    v = responses.validate_mcq_json(gen, "response", "mcq")
    v = v.withColumn("valid", F.col("mcq").isNotNull())
    if fill_invalid:
        v = responses.fill_invalid_mcq(v, "mcq")
    return v.select("id", "temperature", "valid",
                    *[F.col(f"mcq.{f}").alias(f) for f in responses.MCQ_FIELDS])


def answer_exams(items: DataFrame, completer: models.CompleterFactory,
                 runs: dict[str, float] = models.EXAM_RUNS, store: str | None = None) -> DataFrame:
    """Job C': answer every exam item once per run; validated, upper-cased,
    remapped model answers in long form ``(id, ..., run, temperature, model_answer)``."""
    answered = models.answer_exam(items, completer, runs, store=store)
    return models.model_answers(answered, "response", "model_answer")


# The columns of an exam result table, in their order.
EXAM_RESULT_COLS = ("id", "question", "cop", "opa", "opb", "opc", "opd", "model_answer")


def exam_results(answers: DataFrame, run: str) -> DataFrame:
    """The result table of one run of :func:`answer_exams`: the exam item and the model's answer."""
    return answers.where(F.col("run") == run).select(*EXAM_RESULT_COLS)


#: Columns that carry the place of a row of a CSV file: the file, and a number that ascends within it.
PLACE = ("_file", "_place")


def in_place(table: DataFrame) -> DataFrame:
    """A table read from files, with the place of each row (:data:`PLACE`).

    The numbered rows are stored in the shared checkpoint folder, so every
    later read sees the same number for a row.
    """
    return cut_lineage(table.withColumns({"_file": F.col("_metadata.file_path"), "_place": F.monotonically_increasing_id()}))


def score_csv_job(spark: SparkSession, mcqs_path: str, sheets_path: str | None, output: str, id_col: str = "id",
                  merge: bool = True, compression: str | None = None, **options) -> None:
    """The toolkit's command: question and sheet CSV files in, scored questions as CSV out, in the order of the input.

    The question file's columns are those of its header, and all of them are
    in the result.  Sheets that no question cites are left out first (J1);
    with ``merge=False`` no sheet file is needed.  ``options`` go to
    :func:`score_questions`.  The result's files, read in the order of their
    names, hold the rows in the order of the input (file by file); they are
    written by ranges, in parallel, and compressed where ``compression`` names
    a codec (``gzip``); compressed input files are read by their extension.
    """
    mcqs = in_place(files.read_csv_header(spark, mcqs_path))
    sheets = None
    if merge:
        sheets = joins.semi_join_sheets(files.read_csv_table(spark, sheets_path, files.SHEETS_SCHEMA), mcqs, id_col)
    scored = score_questions(mcqs, sheets, merge=merge, key_col="_place", sheet_id_col=id_col, **options)
    files.write_csv_table(scored, output, order_by=PLACE, compression=compression)
