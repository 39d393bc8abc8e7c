"""T5 by packed blocks of trigrams."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quizlens.operators import packed, scores


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(n, seed):
    pick = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "cats", "cat", "the", "fishes", "ß", "x"]
    return [pick.choice([None, "", "the of"]) if pick.random() < 0.1 else " ".join(pick.choices(words, k=pick.randrange(40))) for _ in range(n)]


def _counts(df):
    return sorted(((r["mcq_id"], r["_n"], r["_seen"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("key", ["long", "string"])
@pytest.mark.parametrize("lemmas", [False, True])
def test_packed_counts_equal_those_by_rows(spark, monkeypatch, key, lemmas):
    q = _texts(300, 1) + ["one two three four"] * 40
    rows = [(None if i % 50 == 7 else i // 2, t) for i, t in enumerate(q)]
    m = spark.createDataFrame([(None if k is None else k if key == "long" else f"k{k}", t) for k, t in rows], f"mcq_id {key}, question string").repartition(3)
    s = spark.createDataFrame([(t,) for t in _texts(120, 2) + ["zero one two three"] * 9], "content_gpt string").repartition(2)
    lem = spark.createDataFrame([("cats", "cat"), ("fishes", "two words"), ("x", "")], "form string, lemma string") if lemmas else None
    want = _counts(scores.corpus_counts(m, s, lemmas=lem, broadcast_rows=0))
    monkeypatch.setattr(scores, "ROWS_BOUND", 0)
    monkeypatch.setattr(scores, "FILTER_SHARE", 10**9)
    monkeypatch.setattr(packed, "LEAST_BOUND", 500)         # several parts
    got = scores.corpus_counts(m, s, lemmas=lem, broadcast_rows=0)
    assert "MapInArrow" in _plan(got) and "Generate" not in _plan(got)      # no row for each trigram
    assert _counts(got) == want and any(n != seen for _, n, seen in want)


def test_packed_counts_without_corpus_or_questions(spark, monkeypatch):
    monkeypatch.setattr(scores, "ROWS_BOUND", -1)
    monkeypatch.setattr(scores, "FILTER_SHARE", 10**9)
    m = spark.createDataFrame([(1, "a1 b1 c1 d1"), (2, None)], "mcq_id long, question string")
    s = spark.createDataFrame([("a1 b1 c1",)], "content_gpt string")
    assert _counts(scores.corpus_counts(m, s.limit(0), broadcast_rows=0)) == [(1, 2, 0)]
    assert _counts(scores.corpus_counts(m, s, broadcast_rows=0)) == [(1, 2, 1)]
    assert _counts(scores.corpus_counts(m.limit(0), s, broadcast_rows=0)) == []


def test_a_chunk_without_all_its_blocks_is_an_error():
    size, words = packed._pack(np.array([1, 0], np.uint32).tobytes())
    chunk = pa.table({"chunk": ["c"] * 3, "key": [7, 8, None], "row": [0, 1, None], "rows": [2, 2, 2], "n": [2, 1, 3],
                      "size": [None, None, size], "words": pa.array([None, None, words], pa.binary())})
    assert packed._summed(chunk).to_pydict() == {"key": [7, 8], "n": [2, 1], "seen": [1, 0]}
    with pytest.raises(ValueError, match="all its trigrams"):
        packed._summed(chunk.set_column(4, "n", pa.array([2, 1, 2])))
