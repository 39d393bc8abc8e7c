"""Plan shape: no Python in the expression scores, no cartesian products,
broadcast only behind the size check, JVM-side trigram pipeline."""

import pytest

from quizlens.operators import scores
from quizlens.plans import catalog
from quizlens.plans import fixtures as fx
from conftest import SF_SMALL

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["starts_with_negation", "is_question", "readability", "originality_paired",
                                  "originality_corpus", "length_score", "relevance", "ambiguity",
                                  "extract_sheet_metadata", "validate_mcq_json", "parse_response",
                                  "score_questions", "set_difference"])
def test_no_python_and_no_cartesian(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF_SMALL))
    for node in PY_NODES:
        assert node not in plan, (name, node)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_corpus_plan_switches_on_bound(spark):
    m = fx.load(spark, SF_SMALL, "mcqs")
    s = fx.load(spark, SF_SMALL, "sheets")
    small = _plan(scores.originality_corpus(m, s, broadcast_rows=10**9))
    assert "BroadcastHashJoin" in small
    large = _plan(scores.originality_corpus(m, s, broadcast_rows=0))
    assert "SortMergeJoin" in large


def test_trigram_joins_are_sort_merge(spark):
    plan = _plan(catalog.QUERIES["originality_paired"](spark, SF_SMALL))
    assert "SortMergeJoin" in plan


def test_scan_prunes_columns(spark):
    plan = _plan(catalog.QUERIES["readability"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_split_prunes_folder_partitions(spark):
    from quizlens.plans import catalog as C

    df = C.QUERIES["test_split_partitioned"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and " IN (IC-001" in plan


def _skewed(spark, n=4000):
    """Questions and sheets with a third of all questions on one sheet, and one trigram in all of those."""
    from pyspark.sql import functions as F

    word = lambda k: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(k))
    text = F.concat_ws(" ", *[word(x) for x in "abcdefgh"])
    hot = F.concat_ws(" ", F.lit("alpha beta gamma"), text)
    q = spark.range(n).select(F.col("id").alias("mcq_id"), F.concat(F.lit("S"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string")).alias("id"),
                              F.when(F.col("id") % 3 == 0, hot).otherwise(text).alias("question"))
    s = spark.range(n).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("id"),
                              F.concat_ws(" ", F.when(F.col("id") % 2 == 0, F.lit("alpha beta gamma")), text).alias("content_gpt"))
    return q, s


@pytest.fixture()
def low_skew_thresholds(spark):
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
           "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.coalescePartitions.enabled": "false",
           "spark.sql.shuffle.partitions": "48"}
    old = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _executed(df):
    """The plan of ``df`` after it ran (the same plan object)."""
    df._jdf.queryExecution().toRdd().count()
    return _plan(df)


def _hot_share(df):
    """Join nodes that AQE split."""
    plan = _executed(df)
    assert "isFinalPlan=true" in plan
    return plan.count("skew=true")


def test_hot_sheet_is_split_in_the_executed_plans(spark, low_skew_thresholds):
    from quizlens.operators import joins
    from quizlens.plans import jobs

    q, s = _skewed(spark)
    assert _hot_share(scores.originality_paired(q, s))
    assert _hot_share(joins.attach_sheet(q, s))
    assert _hot_share(joins.semi_join_mcqs(q, s))
    assert _hot_share(jobs.score_questions(q.withColumns({c: F_lit("x") for c in jobs.OPTION_COLS + ("correct_option",)}), s,
                                           compute_relevance=False, compute_ambiguity=False))


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_hot_ids_of_a_semi_join_are_one_row(spark, low_skew_thresholds):
    """J1's right side is aggregated before its shuffle, whatever the number of questions on one sheet."""
    from quizlens.operators import joins

    q, s = _skewed(spark)
    plan = _executed(joins.semi_join_sheets(s, q))
    assert "HashAggregate" in plan and "LeftSemi" in plan


def test_hot_trigram_is_split_in_the_executed_plans(spark, low_skew_thresholds):
    q, s = _skewed(spark)
    assert _hot_share(scores.corpus_counts(q, s, broadcast_rows=0))


def test_judges_leave_the_sheet_text_behind(spark):
    """A criterion that does not use the sheet neither reads nor sends its text."""
    from quizlens.plans import catalog as C

    for name in ("disclosure", "difficulty", "distractors_quality"):
        plan = _plan(C.QUERIES[name](spark, SF_SMALL))
        for node in plan.split("\n"):
            if "Exchange" in node or "ArrowEvalPython" in node:
                assert "content_gpt" not in node, (name, node)
        assert "ArrowEvalPython" in plan


def test_sheets_table_is_clustered_by_folder(spark, scratch):
    from quizlens.sources import files
    import os

    s = fx.load(spark, SF_SMALL, "sheets").repartition(16)
    files.write_sheets_table(s, scratch)
    base = scratch.removeprefix("file:")
    counts = [len([f for f in os.listdir(f"{base}/{d}") if f.endswith(".parquet")]) for d in os.listdir(base) if "=" in d]
    assert len(counts) == 20 and sum(counts) <= 28
