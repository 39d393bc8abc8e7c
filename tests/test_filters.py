"""The Bloom filter: nothing that is held is lost, what else passes is as measured; T5 above the broadcast bound."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quizlens.operators import filters, scores
from quizlens.plans import fixtures as fx


def values(spark, start, end):
    return spark.range(start, end).select(F.concat(F.lit("value "), F.col("id").cast("string")).alias("v"))


def passed(spark, blocks):
    held, absent = values(spark, 0, 3000), values(spark, 10_000, 40_000)
    table = filters.bloom_filter(held.unionByName(held), "v", blocks)
    assert table.count() <= blocks
    assert filters.may_contain(held, "v", table, blocks).count() == 3000
    rate = filters.false_rate(table, blocks)
    through = filters.may_contain(absent, "v", table, blocks).count()
    assert abs(through - 30_000 * rate) < 6 * (30_000 * rate) ** 0.5 + 30
    return rate


def test_nothing_held_is_lost_and_the_false_rate_is_as_measured(spark):
    few, many = passed(spark, filters.block_count(3000)), passed(spark, 16)
    assert few < 0.01 < 0.3 < many
    assert passed(spark, 1) > 0.99


def test_filters_merge_by_or(spark):
    whole = filters.bloom_filter(values(spark, 0, 500), "v", 32)
    parts = filters.bloom_filter(values(spark, 0, 200), "v", 32).unionByName(filters.bloom_filter(values(spark, 150, 500), "v", 32))
    merged = parts.groupBy("block").agg(*[F.bit_or(f"word{w}").alias(f"word{w}") for w in range(filters.WORDS)])
    assert sorted(whole.collect()) == sorted(merged.collect())


def test_null_empty_and_repeated_values(spark):
    rows = spark.createDataFrame([(None,), ("",), ("",), ("é\x00",)], "v string")
    table = filters.bloom_filter(rows, "v", 8)
    assert sorted(r["v"] for r in filters.may_contain(rows, "v", table, 8).collect()) == ["", "", "é\x00"]
    none = filters.bloom_filter(rows.limit(0), "v", 8)
    assert filters.false_rate(none, 8) == 0.0 and filters.may_contain(rows, "v", none, 8).count() == 0


def test_block_count_is_bounded():
    assert filters.block_count(0) == 1
    assert filters.block_count(10**12) == filters.MAX_BLOCKS
    assert filters.block_count(1000) * filters.WORDS * filters.WORD_BITS >= 1000 * filters.BITS_A_VALUE


def trigrams(spark):
    q = fx.load(spark, SF_SMALL, "mcqs").where("question is not null").limit(40).withColumn(
        "question", F.concat_ws(" ", "question", F.concat(F.lit("only here "), F.col("mcq_id").cast("string"))))
    qt = scores.trigram_rows(q, ["mcq_id"], "question")
    ct = scores.trigram_rows(fx.load(spark, SF_SMALL, "sheets").where("content_gpt is not null"), [], "content_gpt")
    return q, qt, ct


def test_only_asked_trigrams_are_shuffled(spark):
    q, qt, ct = trigrams(spark)
    bound = scores.trigram_bound(q, "question")[0]
    blocks = filters.block_count(bound)
    matches = ct.join(qt.select("trigram").distinct(), "trigram", "left_semi").count()
    absent = ct.count() - matches
    rate = filters.false_rate(filters.bloom_filter(qt, "trigram", blocks), blocks)
    through = scores.asked_trigrams(qt, ct, bound).count()
    assert 0 < matches <= through <= matches + 2 * rate * absent + 50 < matches + absent / 10


def test_a_filter_that_is_too_full_is_not_used(spark):
    q, qt, ct = trigrams(spark)
    assert scores.asked_trigrams(qt, ct, 10, max_blocks=1).count() == ct.count()


def test_filtered_plan_probes_before_the_shuffle_and_scores_are_equal(spark):
    m, s = fx.load(spark, SF_SMALL, "mcqs"), fx.load(spark, SF_SMALL, "sheets")
    qt = scores.trigram_rows(m, ["mcq_id"], "question")
    ct = scores.trigram_rows(s.where("content_gpt is not null"), [], "content_gpt")
    plan = scores.asked_trigrams(qt, ct, 10**6).distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")   # parents come first
    assert not any(n in plan for n in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"))
    pick = lambda df: {r["mcq_id"]: r["originality_corpus"] for r in df.collect()}
    assert pick(scores.originality_corpus(m, s, broadcast_rows=0)) == pick(scores.originality_corpus(m, s, broadcast_rows=10**9))


def test_a_filter_that_must_fill_up_is_not_built(spark, monkeypatch):
    """A bound far above the largest filter's bits: the questions are not read for it, and the scores stay."""
    m, s = fx.load(spark, SF_SMALL, "mcqs"), fx.load(spark, SF_SMALL, "sheets")
    pick = lambda df: {r["mcq_id"]: r["originality_corpus"] for r in df.collect()}
    want = pick(scores.originality_corpus(m, s, broadcast_rows=0))
    built = []
    monkeypatch.setattr(scores, "bloom_filter", lambda *a: built.append(a))
    real = scores.asked_trigrams
    monkeypatch.setattr(scores, "asked_trigrams", lambda qt, ct, bound: real(qt, ct, bound, max_blocks=1))
    assert pick(scores.originality_corpus(m, s, broadcast_rows=0)) == want and not built
