"""Language identification by words first, and by shorter and shorter character n-grams for the words not known.

Every training document is counted: its words per language, and the n-grams of
those words.  A known word scores, in each language, minus the logarithm of
its relative frequency there (a penalty where it never occurs).  A word that
is not known scores the mean over its n-grams of the highest order of which any
is known, then the next lower order, down to single letters.  A text's score
is the mean over its words; the lowest language wins.

A word is a run of letters in lower case, cut after 40 letters.  How many words
and n-grams a model knows is a parameter: the most frequent ones of each
language, found by counts of counts, so no language is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import ready, staged
from quizlens.plans.sizing import broadcast_if_small

#: Most words, and n-grams of one order, that a model knows of a language; and most (word, language) numbers in all.
WORDS, GRAMS, CELLS = 50_000, 20_000, 5_000_000
ORDERS = (5, 4, 3, 2, 1)
LONGEST_WORD = 40
#: Score of a word or n-gram in a language where it never occurs (a relative frequency of 10^-7).
PENALTY = 7.0
#: Bytes of text that a worker takes at a time (or one text, where it is longer).
STEP_BYTES = 8_000_000
UNDETERMINED = "und"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words(texts: pa.Array) -> pa.ListArray:
    """The words of each text, with empty strings beside them where a text does not start or end in one."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " ")
    lists = pc.ascii_split_whitespace(spaced)
    if len(lists.values) and (pc.max(pc.utf8_length(lists.values)).as_py() or 0) > LONGEST_WORD:
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(spaced, r"(\pL{%d})" % LONGEST_WORD, r"\1 "))
    return lists


def grams(some: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of its word) of every n-gram of the words, each word with a space on either side."""
    points = np.frombuffer((" " + " ".join(some) + " ").encode("utf-32-le"), dtype="<u4")
    space = points == 32
    n = len(points) - order + 1
    if not some or n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    whole = np.ones(n, bool)
    for k in range(order):
        key = (key + points[k:k + n].astype(np.uint64)) * _SPREAD
        if order == 1 or 0 < k < order - 1:
            whole &= ~space[k:k + n]
    at = np.flatnonzero(whole)
    return key[at], np.cumsum(space)[at] - 1


def word_keys(some: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in some), np.uint64, len(some))


def _steps(texts: pa.Array, step: int) -> Iterator[pa.Array]:
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + step, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def _table(keys: np.ndarray, cells: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and, for each, its score in every language."""
    distinct, which = np.unique(keys, return_inverse=True)
    scores = np.full((len(distinct), len(totals)), PENALTY)
    scores[which, cells] = np.minimum(PENALTY, -np.log10(counts / totals[cells]))
    return distinct, scores


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each key in the table, and whether it is there."""
    known, _ = table
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


@dataclass
class Model:
    """Languages, the one with most words first, and their scores by word and by n-gram."""

    langs: list[str] = field(default_factory=list)
    words: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros((0, 0)))
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def word_scores(self, some: list[str]) -> np.ndarray:
        """One row a word, one column a language."""
        at, known = _look_up(self.words, word_keys(some))
        out = np.full((len(some), len(self.langs)), PENALTY)
        out[known] = self.words[1][at[known]]
        left = np.flatnonzero(~known)
        for order in ORDERS:
            if not len(left) or order not in self.grams:
                continue
            keys, owner = grams([some[k] for k in left], order)
            at, found = _look_up(self.grams[order], keys)
            here = np.bincount(owner[found], minlength=len(left)) > 0
            if not here.any():
                continue
            # The mean over all n-grams of the word; those that no language knows cost the penalty everywhere.
            sums = np.zeros((len(left), len(self.langs)))
            np.add.at(sums, owner[found], self.grams[order][1][at[found]] - PENALTY)
            number = np.bincount(owner, minlength=len(left))
            out[left[here]] = PENALTY + sums[here] / number[here, None]
            left = left[~here]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share of the likelihood, 0 where there is none."""
        names, shares = [], []
        step = max(1, min(STEP_BYTES, 8 * STEP_BYTES // max(1, len(self.langs))))
        for _, some in _steps(texts, step):
            a, b = self._predict(some)
            names += a
            shares.append(b)
        return names, np.concatenate(shares) if shares else np.zeros(0)

    def _predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs:
            return [UNDETERMINED] * n, np.zeros(n)
        lists = words(texts)
        ends = lists.offsets.to_numpy()
        numbered = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        distinct, codes = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        real = np.array([w.isalpha() for w in distinct], dtype=bool) if distinct else np.zeros(0, bool)
        scores = np.zeros((len(distinct), len(self.langs)))
        scores[real] = self.word_scores([w for w, yes in zip(distinct, real) if yes])
        owner = np.repeat(np.arange(n), np.diff(ends))
        number = np.bincount(owner, weights=real[codes], minlength=n) if len(codes) else np.zeros(n)
        sums = np.stack([np.bincount(owner, weights=scores[codes, k], minlength=n) for k in range(len(self.langs))], axis=1) \
            if len(codes) else np.zeros((n, len(self.langs)))
        best = sums.argmin(axis=1)
        share = 1 / np.power(10.0, -np.minimum(sums - sums[np.arange(n), best][:, None], 300)).sum(axis=1)
        letters = number > 0
        for k in np.flatnonzero(~letters).tolist():  # letters that only newer tables of characters know
            letters[k] = any(map(str.isalpha, texts[k].as_py() or ""))
        return [self.langs[b] if yes else UNDETERMINED for b, yes in zip(best.tolist(), letters)], np.where(letters, share, 0.0)


def held_out(id_col: str) -> F.Column:
    """Remainder 2 of crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names = langs.dictionary
        for start, some in _steps(batch.column(1).cast(pa.string()), STEP_BYTES):
            lists = words(some)
            ends = lists.offsets.to_numpy()
            numbered = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
            lang = np.repeat(langs.indices.to_numpy()[start:start + len(some)], np.diff(ends)).astype(np.int64)
            pairs, n = np.unique(lang * max(1, len(numbered.dictionary)) + numbered.indices.to_numpy(), return_counts=True)
            lang, code = np.divmod(pairs, max(1, len(numbered.dictionary)))
            word = numbered.dictionary.take(pa.array(code))
            out = pa.RecordBatch.from_arrays([names.take(pa.array(lang)), word, pa.array(n)], names=["lang", "word", "n"])
            yield out.filter(pc.not_equal(word, ""))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lang, n = langs.indices.to_numpy(), batch.column(2).to_numpy()
        some = batch.column(1).to_pylist()
        for order in ORDERS:
            keys, owner = grams(some, order)
            distinct, code = np.unique(keys, return_inverse=True)
            pairs, which = np.unique(lang[owner].astype(np.int64) * max(1, len(distinct)) + code, return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, which, n[owner])
            who, key = np.divmod(pairs, max(1, len(distinct)))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(who)), pa.array(np.full(len(pairs), order, np.int32)),
                 pa.array(distinct[key].view(np.int64)), pa.array(total)], names=["lang", "gram", "key", "n"])


def most_frequent(counts: DataFrame, by: list[str], most: int) -> DataFrame:
    """The rows of the highest counts within ``by``, at most ``most``: whole levels of about a tenth of a doubling.

    The levels are cut on the small table of how many rows each holds, so no
    group is sorted.  Rows of a level that does not fit whole stay out.
    """
    level = F.floor(8 * F.log2("n")).cast("int")
    sizes = counts.groupBy(*by, level.alias("level")).agg(F.count(F.lit(1)).alias("size"))
    above = F.sum("size").over(Window.partitionBy(*by).orderBy(F.desc("level")))
    cuts = sizes.withColumn("above", above).where(F.col("above") <= most).groupBy(*by).agg(F.min("level").alias("cut"))
    cuts, _ = broadcast_if_small(staged(cuts, "levels"))
    return counts.join(cuts, by).where(level >= F.col("cut")).drop("cut")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", words_kept: int = WORDS,
        grams_kept: int = GRAMS) -> Model:
    """Count every document that is not held out and has a text and a language.

    Words are added up by partial aggregation; n-grams are counted from the
    distinct words of each language, each as often as its word occurs.  What
    comes to the driver is bounded: at most ``words_kept`` words and
    ``grams_kept`` n-grams of an order for each language, fewer where there are
    many languages (CELLS numbers in all).  Without training rows the model is empty.
    """
    ready(docs)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                       held_out(id_col).alias("held")).where("not held and lang is not null and text is not null")
    counts = staged(rows.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
                    .groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row a language
    if not totals:
        return Model()
    langs = [r["lang"] for r in totals]
    number = {lang: k for k, lang in enumerate(langs)}
    share = max(1, CELLS // len(langs) ** 2)
    known = most_frequent(counts, ["lang"], min(words_kept, share)).select("word").distinct()
    known, _ = broadcast_if_small(staged(known, "known-words"))
    found = counts.join(known, "word", "left_semi").toArrow()
    model = Model(langs)
    model.words = _table(word_keys(found["word"].to_pylist()), np.array([number[x] for x in found["lang"].to_pylist()], int),
                         found["n"].to_numpy(), np.array([r["n"] for r in totals], float))
    gram_counts = staged(counts.mapInArrow(_count_grams, "lang string, gram int, key long, n long")
                         .groupBy("lang", "gram", "key").agg(F.sum("n").alias("n")), "gram-counts")
    sums = {(r["lang"], r["gram"]): r["n"] for r in gram_counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()}
    keys = most_frequent(gram_counts, ["lang", "gram"], min(grams_kept, share)).select("gram", "key").distinct()
    keys, _ = broadcast_if_small(staged(keys, "known-grams"))
    found = gram_counts.join(keys, ["gram", "key"], "left_semi").toPandas()
    for order, part in found.groupby("gram"):
        model.grams[int(order)] = _table(part["key"].to_numpy().view(np.uint64), part["lang"].map(number).to_numpy(),
                                         part["n"].to_numpy(), np.array([sums.get((x, order), 1) for x in langs], float))
    return model


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per row of ``docs``, from the texts alone.

    ``lang_pred`` is ``und`` and ``score`` 0 where the text is null or has no
    letter, or the model is empty.  A text of unknown letters gets the
    language with most words.  Equal texts get equal results; a null id is not
    held out.  Other columns are not read.
    """
    shared = ready(docs).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, shares = shared.value.predict(batch.column(2).cast(pa.string()).fill_null(""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(shares, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
