"""The compression classifier: held-out accuracy, fixed scores, and what it may not see."""

import random
import zlib

import numpy as np
import pytest

import odd_rows
from quizlens.llm import toxicity

BAD = ("grumblefoot", "snaggletooth", "blatherskite", "numbskullery", "dunderheaded")


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(8)
    docs, labels = [], []
    for k in range(1200):
        words = odd_rows.words(r.randint(20, 120), k).split()
        toxic = k % 6 == 0
        if toxic:
            for _ in range(r.randint(3, 6)):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_documents(spark, tables):
    docs, labels, truth = tables
    got = toxicity.scored(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    hit = [r["predicted"] for r in held if truth[r["doc_id"]]]
    wrong = [r["predicted"] for r in held if not truth[r["doc_id"]]]
    assert np.mean(hit) > 0.95 and np.mean(wrong) < 0.03


def test_labels_of_held_out_rows_are_not_learned(spark, tables):
    docs, labels, _ = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.scored(docs, t).collect())) for t in (labels, turned))
    assert a == b


def test_equal_texts_score_alike_and_clean_keeps_the_rest(spark, tables):
    docs, labels, truth = tables
    from pyspark.sql import functions as F

    twice = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 5000))
    scores = {}
    for r in toxicity.scored(twice, labels).join(twice, "doc_id").collect():
        assert scores.setdefault(r["text"], r["score"]) == r["score"]
    kept = {r["doc_id"] for r in toxicity.clean(docs, labels).collect()}
    assert np.mean([k in kept for k, t in truth.items() if not t]) > 0.97
    assert np.mean([k in kept for k, t in truth.items() if t]) < 0.05


def test_copies_add_no_evidence():
    texts = [odd_rows.words(50, k).encode() for k in range(240)]
    bad = [t + b" " + BAD[k % 2].encode() + b" " + str(k).encode() + b" x" for k, t in enumerate(texts[:20])]
    odd = b"a family text with strangeword in it"
    words = toxicity.characteristic_words(bad + [odd] * 50, texts[20:])
    assert set(words[:2]) == {BAD[0].encode(), BAD[1].encode()} and b"strangeword" not in words


def test_without_labels(spark):
    docs = odd_rows.table(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}
