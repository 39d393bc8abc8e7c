"""Texts on their way to the embedder."""

from quizlens.operators import models
from quizlens.plans import stubs


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_shuffled_once_for_their_vectors(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a b", None, "", "c"])], "i long, t string").repartition(2).cache()
    vectors = models.key_vectors(df, "t", stubs.LetterEmbedder())
    assert _plan(vectors).split("InMemoryTableScan")[0].count("Exchange") == 1
    assert vectors.count() == 3 and vectors.select("_tkey").distinct().count() == 3
