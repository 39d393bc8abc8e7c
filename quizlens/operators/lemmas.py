"""Noun lemmas by rule (T6): exceptions, then endings taken off, kept where a lexicon holds the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlens.plans.sizing import broadcast_if_small

# The endings of English nouns and what stands in their place.
NOUN_ENDINGS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
                ("men", "man"), ("ies", "y"))
#: How often endings are taken off where nothing found so far is in the lexicon.
ROUNDS = 3


def _detached(word: Column) -> Column:
    """What a word leaves when each ending that it has is replaced."""
    found = [F.when(word.endswith(end), F.concat(F.left(word, F.length(word) - F.lit(len(end))), F.lit(put)))
             for end, put in NOUN_ENDINGS]
    return F.filter(F.array(*found), lambda w: w.isNotNull())


def noun_lemmas(forms: DataFrame, lexicon: DataFrame, exceptions: DataFrame, form_col: str = "form", lemma_col: str = "lemma",
                rounds: int = ROUNDS) -> DataFrame:
    """``(form, lemma)`` for the distinct forms that have a lemma other than themselves.

    A form of ``exceptions`` (form, lemma) has itself and its listed lemmas as
    candidates; any other has itself and what is left when endings are taken
    off, again and again while the lexicon (``lemma_col``) holds none.  Of the
    candidates in the lexicon found first, the shortest is the lemma; a form
    goes before another word as long, else the smaller one counts.  Forms
    without a candidate in the lexicon are left out, as they stay what they
    are.  The result is what the originality scores take as ``lemmas``.

    Everything is a column expression or a join on words; NULL forms, lemmas
    and repeated rows change nothing.
    """
    words = forms.select(F.col(form_col).alias("form")).where(F.col("form").isNotNull()).distinct()
    listed = exceptions.select(F.col("form"), F.col("lemma").alias("candidate")).where("form is not null and candidate is not null").distinct()
    listed, _ = broadcast_if_small(listed)
    known = lexicon.select(F.col(lemma_col).alias("candidate")).where(F.col("candidate").isNotNull()).distinct()
    known, _ = broadcast_if_small(known)

    regular = words.join(listed.select("form").distinct(), "form", "left_anti").withColumn("_left0", F.array("form"))
    for k in range(1, rounds + 1):
        regular = regular.withColumn(f"_left{k}", F.flatten(F.transform(f"_left{k - 1}", _detached)))

    def of_round(k: int) -> Column:
        return F.transform(f"_left{k}", lambda w: F.struct(F.lit(max(k, 1)).alias("round"), w.alias("candidate")))

    found = F.concat(*map(of_round, range(rounds + 1)))
    special = words.join(listed, "form").select("form", F.lit(1).alias("round"), "candidate")
    itself = words.join(listed.select("form").distinct(), "form", "left_semi").select("form", F.lit(1).alias("round"), F.col("form").alias("candidate"))
    candidates = regular.select("form", F.explode(found).alias("c")).select("form", "c.round", "c.candidate").unionByName(special).unionByName(itself)
    order = F.struct("round", F.length("candidate").alias("length"), (F.col("candidate") != F.col("form")).alias("other"), "candidate")
    return (candidates.join(known, "candidate", "left_semi").groupBy("form").agg(F.min(order).alias("best"))
            .select("form", F.col("best.candidate").alias("lemma")).where("form <> lemma"))
