"""Scoring on streaming DataFrames.

Nothing in the toolkit is stateful: the text scores (T1-T3), the prompt
builders (G1-G3) and the response parsers (R1-R3) are plain expressions, so
they apply unchanged to a ``readStream`` source.  The sheet lookup is a
stream-static left join.  Set-based scores (trigram originality) need whole
tables, so they run per micro-batch through ``foreachBatch`` with the batch
operators, appending to a table in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quizlens.functions import text as T
from quizlens.operators import responses
from quizlens.session import scratch_path


def score_stream(questions: DataFrame, sheets: DataFrame | None = None, *,
                 question_col: str = "question", id_col: str = "id",
                 sheet_col: str = "content_gpt") -> DataFrame:
    """Add readability, negation and question-form scores to a (streaming)
    question table; with ``sheets`` (static) also attach the sheet text."""
    out = questions.withColumns({
        "readability": T.readability(question_col),
        "starts_with_negation": T.starts_with_negation(question_col),
        "is_question": T.is_question(question_col),
    })
    if sheets is not None:
        out = out.join(sheets.select(id_col, sheet_col), id_col, "left")
    return out


def validate_stream(outputs: DataFrame, response_col: str = "response") -> DataFrame:
    """Strict MCQ validation and response parsing on a (streaming) table."""
    v = responses.validate_mcq_json(outputs, response_col, "mcq")
    return responses.parse_response(v, response_col, "parsed")


def start_batch_scoring(stream: DataFrame, score_batch: Callable[[DataFrame], DataFrame],
                        output_path: str | None = None, checkpoint_path: str | None = None,
                        trigger_once: bool = False) -> tuple[StreamingQuery, str]:
    """Run ``score_batch`` (any batch job, e.g. a trigram score against a
    static sheet table) on every micro-batch and append the result as
    parquet.  Paths default to fresh folders under ``spark.checkpoint.dir``;
    the sink is idempotent per batch id (a replayed batch overwrites its own
    partition), so a restarted query does not duplicate rows."""
    spark = stream.sparkSession
    output_path = output_path or scratch_path(spark, "stream-out")
    checkpoint_path = checkpoint_path or scratch_path(spark, "stream-ckpt")

    def write(batch: DataFrame, batch_id: int) -> None:
        (score_batch(batch).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(output_path))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start(), output_path
