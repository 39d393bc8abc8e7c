"""Texts cut to the tokens a model takes, embedded in batches of bounded memory and padding."""

import random

import pytest

from quizlens.operators import models
from quizlens.plans import stubs


class Recorder:
    """Vectors ``[words, characters]``; notes the words of each text of each batch and fails on bad texts."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        import os
        import uuid

        def embed(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
                f.write(" ".join(str(len(t.split())) for t in texts))
            return [[len(t.split()), len(t)] for t in texts]
        return embed


class PickyTokenizer:
    """Words; fails on a text that holds ``mad``."""

    def __call__(self):
        words = stubs.WordTokenizer()()

        def tokenize(texts):
            if any("mad" in t for t in texts):
                raise ValueError("no tokens")
            return words(texts)
        return tokenize


def batches(folder):
    return [[int(n) for n in open(f).read().split()] for f in folder.iterdir()]


@pytest.mark.parametrize("seed", range(5))
def test_batches_keep_their_bounds(seed):
    rng = random.Random(seed)
    sizes = sorted(rng.choice([0, 1, 5, 40, 512, rng.randrange(600)]) for _ in range(rng.randrange(1, 300)))
    got = models.padded_batches(sizes, 2000, 0.2)
    assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == len(sizes)
    for a, b in got:
        some = [max(n, 1) for n in sizes[a:b]]
        if len(some) > 1:
            assert some[-1] * len(some) <= 2000 and some[-1] * len(some) - sum(some) <= 0.2 * some[-1] * len(some)
    assert models.padded_batches([], 10, 0.1) == []
    assert models.padded_batches([50], 10, 0.1) == [(0, 1)]     # longer than a batch: alone


def test_cut_is_at_the_end_of_the_last_token():
    cut, sizes = models.cut_texts(["a  b\tc d ", " a b", "", "a b c"], stubs.WordTokenizer()(), 3)
    assert cut == ["a  b\tc", " a b", "", "a b c"] and sizes == [3, 2, 0, 3]


def test_cut_texts_batches_and_copies(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([1, 3, 30, 200]) + rng.randrange(4))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate([*texts, *texts[:50], None, "", "one bad text", "mad"])]
    rows += [(1000 + k, "x " * 60 + f"tail {k}") for k in range(20)]       # equal once they are cut
    df = spark.createDataFrame(rows, "k long, t string")
    got = models.embed_texts_bucketed(df, "t", Recorder(str(tmp_path)), PickyTokenizer(), "v", max_tokens=50, batch_tokens=400,
                                      max_padding=0.2, partitions=3).collect()
    assert len(got) == len(rows)
    for r in got:
        words = (r["t"] or "").split()
        if "bad" in words or "mad" in words:
            assert r["v"] is None
        else:
            assert r["v"][0] == min(50, len(words))
    seen = batches(tmp_path)
    assert sum(map(len, seen)) <= len({" ".join((t or "").split()[:50]) for _, t in rows})      # each cut text once
    for b in seen:
        wide = [max(n, 1) for n in b]
        assert len(b) == 1 or max(wide) * len(b) <= 400 and max(wide) * len(b) - sum(wide) <= 0.2 * max(wide) * len(b) + 1e-9



def test_one_length_is_many_tasks(spark):
    """Texts of one length are dealt by their hash too; no task takes them all."""
    df = spark.range(2000).selectExpr("concat('same ', cast(id as string)) AS t")
    out = models.embed_texts_bucketed(df, "t", stubs.LetterEmbedder(), stubs.WordTokenizer(), partitions=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(_tokens" in plan and "_tkey" in plan.split("rangepartitioning(_tokens")[1][:80]
    assert out.count() == 2000


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert models.embed_texts_bucketed(df, "t", stubs.LetterEmbedder(), stubs.WordTokenizer()).count() == 0
