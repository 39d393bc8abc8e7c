"""Stateless scores on a stream; per-batch trigram scores via foreachBatch."""

from quizlens.operators import scores
from quizlens.plans import fixtures as fx
from quizlens.streaming import scoring
from conftest import SF_SMALL


def test_score_stream_matches_batch(spark, scratch):
    mcqs = fx.load(spark, SF_SMALL, "mcqs")
    sheets = fx.load(spark, SF_SMALL, "sheets")
    src = scratch + "/mcqs"
    mcqs.write.parquet(src)
    stream = spark.readStream.schema(mcqs.schema).parquet(src)
    q = (scoring.score_stream(stream, sheets).writeStream.format("memory")
         .queryName("scored_stream").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT mcq_id, readability, starts_with_negation, is_question, content_gpt FROM scored_stream")
    want = scoring.score_stream(mcqs, sheets).select(got.columns)
    assert got.count() == mcqs.join(sheets, "id", "left").count() > 200     # some sheet ids occur twice
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_validate_stream(spark, scratch):
    outs = fx.load(spark, SF_SMALL, "model_outputs")
    src = scratch + "/outs"
    outs.write.parquet(src)
    stream = spark.readStream.schema(outs.schema).parquet(src)
    q = scoring.validate_stream(stream).writeStream.format("memory").queryName("valid_stream").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT count(*) FROM valid_stream WHERE mcq IS NOT NULL").first()[0]
    assert got == scoring.validate_stream(outs).where("mcq IS NOT NULL").count() == 50


def test_batch_scoring_foreach_batch(spark, scratch):
    mcqs = fx.load(spark, SF_SMALL, "mcqs")
    sheets = fx.load(spark, SF_SMALL, "sheets")
    src = scratch + "/mcqs-src"
    mcqs.write.parquet(src)
    stream = spark.readStream.schema(mcqs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query, out = scoring.start_batch_scoring(
        stream, lambda b: scores.originality_paired(b, sheets).select("mcq_id", "originality"),
        trigger_once=True)
    query.awaitTermination(300)
    got = spark.read.parquet(out).select("mcq_id", "originality")
    want = scores.originality_paired(mcqs, sheets).select("mcq_id", "originality")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
