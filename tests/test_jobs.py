"""The three end-to-end jobs on fixture data."""

from pyspark.sql import functions as F

from quizlens.operators import responses
from quizlens.plans import fixtures as fx
from quizlens.plans import jobs, stubs
from quizlens.sources import files
from conftest import SF_SMALL


def test_ingest_keeps_rows_when_model_fails(spark, scratch):
    raw = fx.load(spark, SF_SMALL, "sheets_raw")
    files.write_text_tree(raw, scratch)
    plain = jobs.ingest_sheets(spark, scratch)
    cleaned = jobs.ingest_sheets(spark, scratch, completer=stubs.StubCleaner(fail_every=5))
    n = plain.count()
    assert cleaned.count() == n
    assert plain.where(F.col("rubric") == "Multimedia content").count() == 0
    nulls = cleaned.where(F.col("content_gpt").isNull()).count()
    assert 0 < nulls < n


def test_generation_job_validates_and_repairs(spark):
    sheets = fx.load(spark, SF_SMALL, "sheets")
    folders = spark.createDataFrame([(f,) for f in fx.TEST_FOLDERS], "folder string")
    out = jobs.generate_questions_job(sheets, folders, stubs.StubGenerator(invalid_every=4))
    n_test = sheets.where(F.col("folder").isin(list(fx.TEST_FOLDERS))).count()
    assert out.count() == 3 * n_test
    assert sorted(r[0] for r in out.select("temperature").distinct().collect()) == [0.1, 0.5, 0.7]
    bad = out.where(~F.col("valid"))
    assert bad.count() > 0
    assert bad.where(F.concat_ws("", *responses.MCQ_FIELDS) != "").count() == 0
    assert out.where(F.col("valid") & F.col("question").isNull()).count() == 0


def test_answer_exams_runs_and_remaps(spark):
    items = fx.load(spark, SF_SMALL, "exam_items")
    out = jobs.answer_exams(items, stubs.StubExamAnswerer())
    assert out.count() == 3 * items.count()
    runs = {(r["run"], r["temperature"]) for r in out.select("run", "temperature").distinct().collect()}
    assert runs == {("0.1", 0.5), ("0.5", 0.5), ("0.7", 0.7)}
    answers = {r[0] for r in out.select("model_answer").distinct().collect()}
    assert answers <= {"A", "B", " C) X", "D"}


def test_score_without_merge_equals_merge(spark):
    m = fx.load(spark, SF_SMALL, "mcqs")
    s = fx.load(spark, SF_SMALL, "sheets")
    cols = ["mcq_id", "originality", "readability", "starts_with_negation", "is_question"]
    merged = jobs.score_questions(m, s, compute_relevance=False, compute_ambiguity=False).select(cols)
    pre = m.join(s.select("id", "content_gpt"), "id", "left")
    rowwise = jobs.score_questions(pre, merge=False, compute_relevance=False,
                                   compute_ambiguity=False).select(cols)
    assert merged.exceptAll(rowwise).count() == 0 and rowwise.exceptAll(merged).count() == 0


def test_full_job_with_vectors(spark):
    m = fx.load(spark, SF_SMALL, "mcqs")
    s = fx.load(spark, SF_SMALL, "sheets")
    out = jobs.score_questions(m, s, compute_corpus_originality=True, embedder=stubs.LetterEmbedder())
    assert out.count() == m.join(s, "id", "left").count() > m.count()     # some sheet ids occur twice
    rows = out.select("relevance", "ambiguity", "originality_corpus", "content_gpt", "correct_option").collect()
    for r in rows:
        assert (r["relevance"] is None) == (r["content_gpt"] is None)
        assert r["relevance"] is None or -1.0001 <= r["relevance"] <= 1.0001
        assert 0.0 <= r["originality_corpus"] <= 1.0
        if r["correct_option"] not in ("a", "b", "c", "d", "A", "B", "C", "D"):
            assert r["ambiguity"] == 0.0


def test_ingest_compacts_to_partitioned_parquet(spark, scratch):
    raw = fx.load(spark, SF_SMALL, "sheets_raw")
    files.write_text_tree(raw, scratch + "/tree")
    direct = jobs.ingest_sheets(spark, scratch + "/tree")
    stored = jobs.ingest_sheets(spark, scratch + "/tree", output=scratch + "/sheets")
    cols = ["folder", "id", "content_cleaned", "rubric"]
    assert stored.select(cols).exceptAll(direct.select(cols)).count() == 0
    assert direct.select(cols).exceptAll(stored.select(cols)).count() == 0
    plan = stored.where(F.col("folder") == "IC-001")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "IC-001" in plan


def test_prompts_file_drives_which_criteria_run(spark, scratch):
    files.write_text_file(spark, scratch + "/prompts.json",
                          files.prompts_json({"distractors_quality_prompt": "Rate the distractors 1-5."}))
    prompts = files.read_prompts(spark, scratch + "/prompts.json")
    m = fx.load(spark, SF_SMALL, "mcqs")
    s = fx.load(spark, SF_SMALL, "sheets")
    out = jobs.score_questions(
        m, s, compute_relevance=False, compute_ambiguity=False, completer=stubs.StubJudge(),
        answerability_system_prompt=prompts.get("answerability_prompt"),
        disclosure_system_prompt=prompts.get("disclosure_prompt"),
        difficulty_system_prompt=prompts.get("difficulty_prompt"),
        distractors_quality_system_prompt=prompts.get("distractors_quality_prompt"),
        distractors_quality_col="distractor_quality")
    assert "distractor_quality" in out.columns
    assert not {"gpt_answer", "disclosure", "difficulty"} & set(out.columns)
    assert out.count() == m.join(s, "id", "left").count()
    assert out.where(F.col("distractor_quality").isNull()).count() == 0


def test_prompt_without_completer_is_an_error(spark):
    import pytest

    m = spark.createDataFrame([(1, "s", "q")], "mcq_id long, id string, question string")
    s = spark.createDataFrame([("s", "t")], "id string, content_gpt string")
    with pytest.raises(ValueError, match="completer"):
        jobs.score_questions(m, s, disclosure_system_prompt="Rate it.", compute_relevance=False, compute_ambiguity=False)


def test_stored_answers_are_made_once(spark, scratch):
    """A counting completer is called once a row, however many reports read the answers."""
    from quizlens.operators import models

    log = scratch + "-calls"
    files.arrow_fs(log)[0].create_dir(files.arrow_fs(log)[1], recursive=True)
    base = files.arrow_fs(log)[1]

    def factory():
        import os
        import uuid

        def complete(system, prompts, temperature, max_tokens, **options):
            for _ in prompts:
                open(os.path.join(base, uuid.uuid4().hex), "w").close()
            return [uuid.uuid4().hex for _ in prompts]
        return complete

    import os
    df = spark.range(30).selectExpr("id", "concat('p', id) as prompt", "repeat('text', 10) as sheet")
    out = models.llm_map(df, "prompt", "answer", factory, temperature=0.7, store=scratch, partitions=3)
    first, second = (sorted(map(tuple, out.collect())) for _ in range(2))
    assert first == second and out.where("answer is null").count() == 0
    assert len(os.listdir(base)) == 30
    again = models.llm_map(df, "prompt", "answer", factory, temperature=0.7, store=scratch, partitions=3)
    assert sorted(map(tuple, again.collect())) == first and len(os.listdir(base)) == 30


def test_texts_do_not_travel_past_the_prompts(spark):
    """Job A, all criteria: what the prompts alone need is dropped before the scores are joined."""
    from quizlens.plans import catalog as C

    plan = C.QUERIES["score_questions_full"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("ArrowEvalPython")]      # parents come first
    assert "SortMergeJoin" in above and "Exchange" in above
    for node in above.split("\n"):
        assert "Exchange" not in node or ("content_gpt" not in node and "question#" not in node and "option_d" not in node), node
