"""T1-T3, T6 and T7 edge rows, plus property tests against plain Python."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import pyref
from quizlens.functions import text as T

NBSP = "\xa0"


def _eval(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", fn("s").alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_negation_edges(spark):
    cases = {"No.": True, "Nothing": False, "cannot": False, "can't we": True,
             "   not now": True, NBSP + " No way": True, "don’t": False, "NOT": True,
             "isn't it": True, "Noé": False, "": False, "no_way": False}
    got = _eval(spark, list(cases), T.starts_with_negation)
    assert got == list(cases.values())


def test_is_question_edges(spark):
    cases = {"Say it ?  ": True, "WHAT now": True, "Whatever": False, "Which one": False,
             "": False, "how?": True, "Do." : True, "done": False, "x ?\n": True}
    got = _eval(spark, list(cases), T.is_question)
    assert got == list(cases.values())


def test_readability_edges(spark):
    cases = ["", "no marks here", "...", "Rhythm. Myths!", "Café olé.", "a" + NBSP + "b.",
             "One two three. Four five?", "   \n\t"]
    got = _eval(spark, cases, T.readability)
    for text, value in zip(cases, got):
        want = pyref.readability(text)
        if want is None:
            assert value is None, text
        else:
            assert value == want, (text, value, want)


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "s string")
    r = df.select(T.starts_with_negation("s").alias("a"), T.is_question("s").alias("b"),
                  T.readability("s").alias("c"), T.length_score("s", 2, 5).alias("d")).first()
    assert r == (None, None, None, None)


def test_tokens_edges(spark):
    cases = ["I cannot go", "m² and ½ cups", "The the the", "gonna wanna gotta lemme gimme",
             "e-mail: x_y@z.com", "", "  !!  ", "Wanna"]
    got = _eval(spark, cases, T.content_tokens)
    assert got == [pyref.tokens(c) for c in cases]


def test_length_score(spark):
    cases = ["a b", "a b c d", "a b c d e f g h"]
    got = _eval(spark, cases, lambda c: T.length_score(c, 3, 5))
    assert got == [(2 / 3) ** 2, 1.0, (5 / 8) * (5 / 8)]


# Latin letters, digits, numerics, punctuation and Python whitespace; the
# Spark word class equals Python's \w below U+0870.
ALPHABET = st.sampled_from(
    list("abcdeiouyAEIOUYnotwhdsrlk'’?.!,;:-_ \t\n") + ["\xa0", " ", "\x1c", "é", "ß", "²", "½", "Ä"]
)
WORDS = st.sampled_from(["not", "No", "what", "How", "cannot", "wanna", "the", "is", "Do", "x"])
TEXT = st.lists(st.one_of(st.text(ALPHABET, max_size=12), WORDS), max_size=12).map(" ".join)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=50, max_size=80))
def test_properties_against_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    rows = df.select("i", T.starts_with_negation("s").alias("neg"), T.is_question("s").alias("q"),
                     T.readability("s").alias("r"), T.content_tokens("s").alias("tk")).orderBy("i").collect()
    for t, row in zip(texts, rows):
        assert row["neg"] == pyref.negation(t), t
        assert row["q"] == pyref.is_question(t), t
        want = pyref.readability(t)
        assert (row["r"] is None and want is None) or math.isclose(row["r"], want, rel_tol=0, abs_tol=0), t
        assert row["tk"] == pyref.tokens(t), t


def test_trigram_array_distinct(spark):
    df = spark.createDataFrame([("alpha beta gamma alpha beta gamma",)], "s string")
    tri = df.select(T.trigram_array(T.content_tokens("s")).alias("t")).first()["t"]
    assert sorted(tri) == sorted(pyref.trigrams("alpha beta gamma alpha beta gamma"))


def test_fixed_word_lists_are_whole():
    """A word that is missing would go unnoticed where test and code share the list."""
    from quizlens.functions import text as T

    assert len(T.NEGATION_WORDS) == 18 and len(T.QUESTION_WORDS) == 13
