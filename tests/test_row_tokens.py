"""Texts compared inside a row: how their tokens travel, lemmas looked up in place, counts in single passes."""

import random

import numpy as np
import pyarrow as pa
import pytest

import pyref
from quizlens.functions import batches as B
from quizlens.functions import text as T
from quizlens.operators import scores


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(n, seed):
    pick = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "cats", "cat", "the", "fishes", "ß", "x"]
    return [pick.choice([None, "", "the of"]) if pick.random() < 0.1 else " ".join(pick.choices(words, k=pick.randrange(40))) for _ in range(n)]


def test_row_comparison_by_numbers_equals_sets(monkeypatch):
    monkeypatch.setattr(B, "SLICE_BYTES", 200)
    q, s = _texts(200, 3), _texts(200, 4)
    stop = T.ENGLISH_STOP_WORDS
    a, b = pa.array(q, pa.string()), pa.array(s, pa.string())
    score, lists = B.novelty(a, b, stop).to_pylist(), B.missing_lists(a, b, stop).to_pylist()
    for x, y, got, missing in zip(q, s, score, lists, strict=True):
        want = None if x is None or y is None else pyref.trigrams(x) - pyref.trigrams(y)
        assert got == (None if want is None else len(want) / len(pyref.trigrams(x)) if pyref.trigrams(x) else 0.0)
        assert sorted(missing) == sorted(want or ())
    assert B.novelty(a.slice(0, 0), b.slice(0, 0), stop).to_pylist() == []


def test_codes_stay_exact_beyond_64_bits():
    a, b, c = (np.array(x, np.int64) for x in ([0, 4_000_000, 0, 4_000_000], [1, 5, 1, 5], [2, 3_999_999, 2, 7]))
    code, bound = B.codes(a, b, c, 5_000_000)
    assert code[0] == code[2] and len(set(code.tolist())) == 3 and 0 <= code.min() and code.max() < bound < 1 << 63
    row, factor = B.by_row(np.array([0, 1, 0, 1]), code, 1 << 62, 1000)
    assert row[0] == row[2] and len(set(row.tolist())) == 3 and (row // factor).tolist() == [0, 1, 0, 1]
    assert [*B.slices(np.array([5, 5, 50, 1]), 10)] == [(0, 2), (2, 3), (3, 4)]


def test_a_lemma_table_of_600000_forms_moves_no_token(spark):
    lem = spark.range(600_000).selectExpr("concat('form', id, 's') AS form", "concat('form', id) AS lemma")
    df = spark.createDataFrame([(0, "form7s eat form8s")], "i long, t string")
    out = scores.with_tokens(df, "t", lemmas=lem)
    assert "Generate" not in _plan(out)
    assert out.first()["_tokens"] == ["form7", "eat", "form8"]
    m = spark.createDataFrame([(1, "s", "form7s eat form8s daily")], "mcq_id long, id string, question string")
    s = spark.createDataFrame([("s", "form7 eat form8")], "id string, content_gpt string")
    assert scores.originality_paired(m, s, lemmas=lem).first()["originality"] == 0.5
    assert [tuple(r) for r in scores.trigram_difference(m, s, lemmas=lem).collect()] == [(1, "eat form8 daily")]


def test_tokens_travel_as_one_string(spark):
    df = spark.createDataFrame([(0, "Cats eat the fishes"), (1, None), (2, "the")], "i long, t string")
    out = scores.RowTokens().add(df, "t", "_tk")
    assert dict(out.dtypes)["_tk"] == "string"
    assert {r["i"]: r["_tk"] for r in out.collect()} == {0: "cats eat fishes", 1: None, 2: ""}


def test_a_dict_of_lemmas_with_spaces_keeps_its_tokens(spark):
    m = spark.createDataFrame([(1, "s", "cats eat fishes daily")], "mcq_id long, id string, question string")
    s = spark.createDataFrame([("s", "cats eat fishes")], "id string, content_gpt string")
    assert scores.originality_paired(m, s, lemmas={"cats": "two words", "eat": ""}).first()["originality"] == 0.5


@pytest.mark.parametrize("text,sentences,words,syllables", [
    ("Why? Stop! Go. e.g.", 5, 4, 4), ("rhythm nth tsk", 0, 3, 3), ("banana strengths", 0, 2, 4), ("", 0, 0, 0), ("a bcd\x85eau", 0, 3, 3)])
def test_readability_counts_in_single_passes(spark, text, sentences, words, syllables):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(T.readability_counts("t").alias("k"), T.trigrams_of(T.content_tokens("t")).alias("x")).first()
    assert (r["k"]["s"], r["k"]["w"], r["k"]["y"]) == (sentences, words, syllables)
