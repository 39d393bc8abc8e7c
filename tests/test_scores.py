"""T4/T5/O4 set scores, T8/T9 vectors, score summary."""

import math

import pytest

import pyref
from quizlens.operators import scores


def _mcq_sheet(spark, pairs):
    m = spark.createDataFrame([(i, f"s{i}", q) for i, (q, _) in enumerate(pairs)],
                              "mcq_id long, id string, question string")
    s = spark.createDataFrame([(f"s{i}", t) for i, (_, t) in enumerate(pairs)], "id string, content_gpt string")
    return m, s


PAIRS = [
    ("a b", "x y z"),                                            # fewer than 3 tokens -> 0
    ("the of and is it", "alpha beta gamma"),                    # all stop words -> 0
    ("alpha beta gamma delta", "alpha beta gamma delta"),        # identical -> 0
    ("alpha beta gamma", "delta epsilon zeta"),                  # disjoint -> 1
    ("alpha beta gamma alpha beta gamma", "alpha beta gamma"),   # duplicates once
    ("m² ½ cup flour", "m² ½ cup sugar"),                        # word characters
    ("I cannot go home now", "can go home"),                     # fused words
    ("one two three four five", None),                           # no sheet text -> NULL
]


def test_originality_paired_edges(spark):
    m, s = _mcq_sheet(spark, PAIRS)
    got = {r["mcq_id"]: r["originality"] for r in scores.originality_paired(m, s).collect()}
    for i, (q, t) in enumerate(PAIRS):
        want = None if t is None else pyref.originality(q, t)
        assert got[i] == want, (q, t)


def test_originality_rowwise_matches_paired(spark):
    m, s = _mcq_sheet(spark, PAIRS)
    merged = m.join(s, "id", "left")
    a = {r["mcq_id"]: r["originality"] for r in scores.originality_rowwise(merged).collect()}
    b = {r["mcq_id"]: r["originality"] for r in scores.originality_paired(m, s).collect()}
    assert a == b


def test_duplicate_sheet_ids_multiply_rows(spark):
    m = spark.createDataFrame([(1, "s", "alpha beta gamma delta")], "mcq_id long, id string, question string")
    s = spark.createDataFrame([("s", "alpha beta gamma"), ("s", "beta gamma delta")], "id string, content_gpt string")
    got = sorted(r["originality"] for r in scores.originality_paired(m, s).collect())
    assert got == [0.5, 0.5]
    s2 = spark.createDataFrame([("s", "alpha beta gamma"), ("s", "zzz yyy xxx")], "id string, content_gpt string")
    got = sorted(r["originality"] for r in scores.originality_paired(m, s2).collect())
    assert got == [0.5, 1.0]


@pytest.mark.parametrize("texts,score", [
    (("alpha beta gamma",) * 2, 0.5),                    # identical rows
    ((None, None), None),                                # both without text
    (("alpha beta gamma", "beta gamma delta"), 0.5),     # different texts
])
def test_duplicate_sheet_rows_give_one_row_each(spark, texts, score):
    """The merge rule: a question has as many rows as its id has sheet rows, in every operator."""
    from pyspark.sql import functions as F
    from quizlens.operators import joins
    from quizlens.plans import jobs, stubs

    m = spark.createDataFrame([(1, "s", "alpha beta gamma delta")], "mcq_id long, id string, question string")
    s = spark.createDataFrame([("s", t) for t in texts], "id string, content_gpt string")
    full = m.withColumns({c: F.lit("x") for c in jobs.OPTION_COLS}).withColumn("correct_option", F.lit("a"))
    assert joins.attach_sheet(m, s).count() == 2
    assert [r["originality"] for r in scores.originality_paired(m, s).collect()] == [score] * 2
    for vectors in (False, True):
        out = jobs.score_questions(full, s, compute_relevance=vectors, compute_ambiguity=vectors, compute_corpus_originality=True,
                                   embedder=stubs.LetterEmbedder()).collect()
        assert [r["originality"] for r in out] == [score] * 2
        assert len(out) == 2 and (not vectors or all((r["relevance"] is None) == (score is None) for r in out))
    # The row-wise form on the merged table, too.
    assert jobs.score_questions(joins.attach_sheet(full, s), merge=False, compute_relevance=False, compute_ambiguity=False).count() == 2


def test_a_form_with_two_lemmas_takes_the_smaller(spark):
    m, s = _mcq_sheet(spark, [("gamma leaves fall", "gamma leaf fall")])
    lem = spark.createDataFrame([("leaves", "leave"), ("leaves", "leaf")], "form string, lemma string")
    assert [r["originality"] for r in scores.originality_paired(m, s, lemmas=lem).collect()] == [0.0]
    assert scores.trigram_difference(m, s, lemmas=lem).collect() == []


@pytest.mark.parametrize("rows", [10**6, 0])    # broadcast and shuffle plan of the lemma table
def test_lemma_table_size_changes_no_result(spark, rows, monkeypatch):
    monkeypatch.setattr(scores, "LEMMA_BROADCAST_ROWS", rows)
    m, s = _mcq_sheet(spark, [("cats eat fishes daily", "cat eat fish daily"), (None, "x y z"), ("", "a")])
    lem = spark.createDataFrame([("cats", "cat"), ("fishes", "fish")], "form string, lemma string")
    got = {r["mcq_id"]: r["originality"] for r in scores.originality_paired(m, s, lemmas=lem).collect()}
    assert got == {0: 0.0, 1: None, 2: 0.0}


def test_a_small_lemma_table_moves_no_text(spark):
    """The lemmas come to the rows: neither the texts nor their tokens are shuffled or regrouped."""
    df = spark.createDataFrame([(0, "Cats eat fishes daily"), (1, None), (2, ""), (3, "the of"), (4, "no form, cats"), (5, "Cats eat fishes daily")],
                               "i long, t string").repartition(1).cache()
    lem = spark.createDataFrame([("cats", "cat"), ("cats", "cattle"), ("fishes", "fish"), ("form", None), (None, "x")], "form string, lemma string")
    out = scores.with_tokens(df, "t", lemmas=lem)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0] and "Generate" not in plan
    want = {0: ["cat", "eat", "fish", "daily"], 1: None, 2: [], 3: [], 4: ["form", "cat"], 5: ["cat", "eat", "fish", "daily"]}
    assert {r["i"]: r["_tokens"] for r in out.collect()} == want
    assert {r["i"]: r["_tokens"] for r in out.where("i > 2").collect()} == {k: v for k, v in want.items() if k > 2}
    assert scores.with_tokens(df, "t", lemmas=lem.limit(0)).where("i = 0").first()["_tokens"] == ["cats", "eat", "fishes", "daily"]


@pytest.mark.parametrize("bound", [10**9, 0])  # broadcast plan and sort-merge plan
def test_corpus_le_paired_min(spark, bound):
    m, s = _mcq_sheet(spark, PAIRS[:7])
    corpus = scores.originality_corpus(m, s, broadcast_rows=bound)
    got = {r["mcq_id"]: r["originality_corpus"] for r in corpus.collect()}
    texts = [t for _, t in PAIRS[:7]]
    for i, (q, _) in enumerate(PAIRS[:7]):
        want = min(pyref.originality(q, t) for t in texts) if pyref.trigrams(q) else 0.0
        q_tri = pyref.trigrams(q)
        all_tri = set().union(*(pyref.trigrams(t) for t in texts))
        exact = len(q_tri - all_tri) / len(q_tri) if q_tri else 0.0
        assert got[i] == exact
        assert got[i] <= want


def test_set_difference(spark):
    m, s = _mcq_sheet(spark, PAIRS)
    got = {}
    for r in scores.trigram_difference(m, s).collect():
        got.setdefault(r["mcq_id"], set()).add(r["trigram"])
    for i, (q, t) in enumerate(PAIRS):
        want = set() if t is None else pyref.trigrams(q) - pyref.trigrams(t)
        assert got.get(i, set()) == want


def test_relevance_symmetric_and_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]),
                                ([3.0, -1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    ab = [r[0] for r in scores.relevance(df, "a", "b").select("relevance").collect()]
    ba = [r[0] for r in scores.relevance(df, "b", "a").select("relevance").collect()]
    assert ab == ba
    assert ab[0] == 0.0 and math.isclose(ab[1], 1.0) and ab[2] == 0.0


def test_ambiguity_edges(spark):
    m = spark.createDataFrame([(1, "A"), (2, "e"), (3, None), (4, "b"), (5, "c")], "mcq_id long, correct_option string")
    vec = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [1.0, 1.0], "d": [0.0, 0.0]}
    rows = [(k, l, v) for k in (1, 2, 3, 4) for l, v in vec.items()]
    rows += [(5, "a", [1.0, 0.0]), (5, "b", None), (5, "c", [1.0, 0.0]), (5, "d", [1.0, 0.0])]
    ov = spark.createDataFrame(rows, "mcq_id long, letter string, embedding array<float>")
    got = {r["mcq_id"]: r["ambiguity"] for r in scores.ambiguity(m, ov).collect()}
    c = 1 / math.sqrt(2)
    assert math.isclose(got[1], (0.0 + c + 0.0) / 3)      # upper-case letter
    assert got[2] == 0.0                                 # letter outside a-d
    assert got[3] is None                                # null letter
    assert math.isclose(got[4], (0.0 + c + 0.0) / 3)
    assert got[5] is None                                # missing distractor vector


def test_score_summary(spark):
    df = spark.createDataFrame([(1.0, True), (None, False), (3.0, True)], "r double, b boolean")
    got = {r["score"]: r for r in scores.score_summary(df, ["r", "b"]).collect()}
    assert got["r"]["n_rows"] == 3 and got["r"]["n_null"] == 1 and got["r"]["mean"] == 2.0
    assert got["b"]["mean"] == pytest.approx(2 / 3) and got["b"]["min"] == 0.0


LEMMAS = {"cats": "cat", "mice": "mouse", "running": "running", "geese": "goose", "dogs": "dog"}
LEMMA_PAIRS = [
    ("cats chase mice daily", "cat chase mouse daily"),
    ("geese and dogs and cats chase mice", "goose dog cat chase mouse"),
    ("a b", "cats"),
    ("cats chase mice cats chase mice", "cats chase mice"),
]


@pytest.mark.parametrize("as_table", [False, True])
def test_lemma_paths_agree(spark, as_table):
    m, s = _mcq_sheet(spark, LEMMA_PAIRS)
    lem = spark.createDataFrame(list(LEMMAS.items()), "form string, lemma string") if as_table else LEMMAS
    paired = {r["mcq_id"]: r["originality"] for r in scores.originality_paired(m, s, lemmas=lem).collect()}
    corpus = {r["mcq_id"]: r["originality_corpus"]
              for r in scores.originality_corpus(m, s, lemmas=lem).collect()}

    def lem_tri(t):
        toks = [LEMMAS.get(x, x) for x in pyref.tokens(t)]
        return {" ".join(toks[i:i + 3]) for i in range(len(toks) - 2)}

    all_sheet = set().union(*(lem_tri(t) for _, t in LEMMA_PAIRS))
    for i, (q, t) in enumerate(LEMMA_PAIRS):
        qt = lem_tri(q)
        assert paired[i] == (len(qt - lem_tri(t)) / len(qt) if qt else 0.0), q
        assert corpus[i] == (len(qt - all_sheet) / len(qt) if qt else 0.0), q


def test_hot_sheet_under_aqe_skew_split(spark):
    """A third of the questions cite one sheet; results equal with and without
    AQE splitting the skewed partitions."""
    from quizlens.operators import joins

    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    qs = [(i, "s0" if i % 3 == 0 else f"s{i}", " ".join(words[(i + k) % 8] for k in range(5)))
          for i in range(300)]
    m = spark.createDataFrame(qs, "mcq_id long, id string, question string")
    s = spark.createDataFrame([(f"s{i}", " ".join(words[(2 * i + k) % 8] for k in range(6))) for i in range(300)],
                              "id string, content_gpt string")
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}

    def run():
        a = sorted(tuple(r) for r in scores.originality_paired(m, s).select("mcq_id", "originality").collect())
        b = sorted(tuple(r) for r in joins.attach_sheet(m, s).select("mcq_id", "content_gpt").collect())
        return a, b

    try:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        plain = run()
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
        split = run()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    assert plain == split
    assert len(plain[0]) == 300
    for mcq_id, score in plain[0]:
        q = qs[mcq_id][2]
        t = " ".join(words[(2 * int(qs[mcq_id][1][1:]) + k) % 8] for k in range(6))
        assert score == pyref.originality(q, t)
