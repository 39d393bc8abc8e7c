"""Scores over a question table (T1-T9) and their summary.

Row-local scores are single ``Column`` expressions; the set-based and vector
scores are joins over exploded rows, so no text or vector is ever gathered
into one task.  Every operator returns its input with the score column added
(NULL where the input text or vector is NULL).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlens.functions import text as T
from quizlens.functions.vectors import cosine
from quizlens.operators import packed
from quizlens.operators.filters import MAX_BLOCKS, WORD_BITS, WORDS, block_count, bloom_filter, false_rate, may_contain
from quizlens.plans.sizing import DEFAULT_BROADCAST_BYTES, DEFAULT_BROADCAST_ROWS, ROW_OVERHEAD, at_most, broadcast_if_small, cut_lineage
from quizlens.session import ship_package

OPTION_LETTERS = ("a", "b", "c", "d")


# ---------------------------------------------------------------- row-local

def starts_with_negation(df: DataFrame, question_col: str = "question",
                         out_col: str = "starts_with_negation") -> DataFrame:
    return df.withColumn(out_col, T.starts_with_negation(question_col))


def is_question(df: DataFrame, question_col: str = "question",
                out_col: str = "is_question") -> DataFrame:
    return df.withColumn(out_col, T.is_question(question_col))


def readability(df: DataFrame, question_col: str = "question",
                out_col: str = "readability") -> DataFrame:
    """Counts projected first, then the grade: each regex pass runs once."""
    counted = df.withColumn("_fk", T.readability_counts(question_col))
    return counted.withColumn(out_col, T.readability_from_counts("_fk")).drop("_fk")


def length_score(df: DataFrame, lower: float, upper: float,
                 question_col: str = "question", out_col: str = "length_score") -> DataFrame:
    return df.withColumn(out_col, T.length_score(question_col, lower, upper))


def relevance(df: DataFrame, question_vec_col: str, sheet_vec_col: str,
              out_col: str = "relevance") -> DataFrame:
    """Cosine between the question vector and its sheet vector."""
    return df.withColumn(out_col, cosine(question_vec_col, sheet_vec_col))


# ---------------------------------------------------------------- trigrams

# A lemma table of at most this size is sent to the tasks as two Arrow arrays (8 bytes a row and its texts).
LEMMA_BROADCAST_ROWS = 3_000_000
LEMMA_BROADCAST_BYTES = 160 * 1024 * 1024


def _lemma_rows(lemmas: DataFrame) -> DataFrame:
    """``(_tok, _lem)``: one row a form; a form listed twice takes its smallest lemma."""
    return lemmas.where(F.col("form").isNotNull()).groupBy(F.col("form").alias("_tok")).agg(F.min("lemma").alias("_lem"))


def _shared_lemmas(table: DataFrame):
    """The rows of a lemma table, which the caller has proven small, as a broadcast pair of Arrow arrays."""
    spark = table.sparkSession
    ship_package(spark)
    rows = table.select("_tok", "_lem").toArrow()
    return spark.sparkContext.broadcast((rows["_tok"].combine_chunks(), rows["_lem"].combine_chunks()))


def _lemma_lookup(table: DataFrame):
    """An Arrow function that puts the lemma of ``table`` (``_tok``, ``_lem``), where it has one, in place of each token.

    The table is broadcast to the tasks; the caller has proven it small.
    """
    shared = _shared_lemmas(table)

    @F.arrow_udf("array<string>")
    def lookup(tokens: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        kind = tokens.type.value_type
        forms, lemmas = (a.cast(kind) for a in shared.value)
        # Only the words change: offsets and NULL lists stay as they are.
        words = pc.coalesce(lemmas.take(pc.index_in(tokens.values, value_set=forms)), tokens.values)
        return pa.Array.from_buffers(tokens.type, len(tokens), tokens.buffers()[:2], tokens.null_count, tokens.offset, children=[words])

    return lookup


def _small_lemmas(lemmas) -> DataFrame | None:
    """The rows of a lemma table that is proven small enough to be sent to the tasks, else None."""
    if not isinstance(lemmas, DataFrame):
        return None
    table = _lemma_rows(lemmas)
    return table if at_most(table, LEMMA_BROADCAST_ROWS, LEMMA_BROADCAST_BYTES) else None


class RowTokens:
    """The tokens of texts that are compared inside a row (T4, O4): how they travel to it, and the comparison.

    Without lemmas the tokens travel as one string, since an array of them
    takes three times its bytes, and JVM expressions compare.  With a lemma
    table that is proven small the normalised text travels, and an Arrow
    function looks its words up and compares word numbers.  Otherwise (a dict,
    or a larger table) the token arrays of :func:`with_tokens` travel.
    """

    def __init__(self, stop_words=T.ENGLISH_STOP_WORDS, lemmas: dict[str, str] | DataFrame | None = None):
        self.stop_words, self.lemmas = tuple(stop_words), lemmas
        small = _small_lemmas(lemmas)
        self.shared = None if small is None else _shared_lemmas(small)

    def add(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        if self.shared is not None:
            return df.withColumn(out_col, T.normalized_text(text_col))
        if self.lemmas:
            return with_tokens(df, text_col, self.stop_words, self.lemmas, out_col)
        return df.withColumn(out_col, F.array_join(T.content_tokens(text_col, self.stop_words), " "))

    def _trigrams(self, df: DataFrame, question: str, sheet: str) -> DataFrame:
        """``df`` with the arrays ``_qtri`` (distinct) and ``_stri``; each step is a projection of its own, made once a row."""
        if not self.lemmas:
            df = df.withColumns({c: F.split(c, " ") for c in (question, sheet)})
        return df.withColumns({"_qtri": T.trigram_array(question), "_stri": T.trigrams_of(sheet)})

    def novelty(self, df: DataFrame, question: str, sheet: str, out_col: str) -> DataFrame:
        """T4 from two columns of :meth:`add`, which are dropped: the share of distinct question trigrams that the sheet lacks.

        NULL when either is NULL (its text is), 0.0 for a question without trigrams.
        """
        if self.shared is not None:
            return df.withColumn(out_col, self._compare("novelty", "double")(question, sheet)).drop(question, sheet)
        n = F.size("_qtri")
        score = (F.when(F.col("_qtri").isNull() | F.col("_stri").isNull(), F.lit(None).cast("double"))
                 .when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_except("_qtri", "_stri")) / n))
        return self._trigrams(df, question, sheet).withColumn(out_col, score).drop(question, sheet, "_qtri", "_stri")

    def missing(self, df: DataFrame, question: str, sheet: str, out_col: str) -> DataFrame:
        """O4 from two columns of :meth:`add`, which are dropped: the distinct question trigrams that the sheet lacks, as an array."""
        if self.shared is not None:
            return df.withColumn(out_col, self._compare("missing_lists", "array<string>")(question, sheet)).drop(question, sheet)
        return (self._trigrams(df, question, sheet).withColumn(out_col, F.array_except("_qtri", "_stri"))
                .drop(question, sheet, "_qtri", "_stri"))

    def _compare(self, name: str, kind: str):
        shared, stop_words = self.shared, self.stop_words

        @F.arrow_udf(kind)
        def compare(question: pa.Array, sheet: pa.Array) -> pa.Array:
            from quizlens.functions import batches

            return getattr(batches, name)(question, sheet, stop_words, shared.value)

        return compare


def with_tokens(df: DataFrame, text_col: str, stop_words=T.ENGLISH_STOP_WORDS,
                lemmas: dict[str, str] | DataFrame | None = None, out_col: str = "_tokens") -> DataFrame:
    """``df`` with the content tokens of a text; NULL for a NULL text.

    ``lemmas`` may be a small dict (applied as a literal map inside the row)
    or a ``(form, lemma)`` DataFrame of any size.  A table whose size is
    proven small is broadcast and looked up inside the row, so no text and no
    token is shuffled.  With a larger one the tokens of the distinct texts (by
    SHA-256) meet it in a sort-merge join and are put back in order; a group
    is one text.  A form listed twice takes its smallest lemma.
    """
    if not isinstance(lemmas, DataFrame):
        return df.withColumn(out_col, T.content_tokens(text_col, stop_words, lemmas))
    table = _lemma_rows(lemmas)
    if at_most(table, LEMMA_BROADCAST_ROWS, LEMMA_BROADCAST_BYTES):
        return df.withColumn(out_col, _lemma_lookup(table)(T.content_tokens(text_col, stop_words)))

    keyed = df.withColumn("_lkey", F.sha2(F.col(text_col), 256))
    texts = keyed.where(F.col(text_col).isNotNull()).select("_lkey", text_col).dropDuplicates(["_lkey"])
    pos = (texts.select("_lkey", T.content_tokens(text_col, stop_words).alias("_tk"))
           .select("_lkey", F.posexplode_outer("_tk").alias("_pos", "_tok")))
    words = (pos.join(table, "_tok", "left").where(F.col("_tok").isNotNull())
             .groupBy("_lkey").agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_lem", "_tok").alias("_w")))).alias("_ws")))
    words = words.select("_lkey", F.transform("_ws", lambda w: w["_w"]).alias("_lemmas"))
    none = F.array().cast("array<string>")
    return (keyed.join(words, "_lkey", "left")
            .withColumn(out_col, F.when(F.col("_lkey").isNotNull(), F.coalesce("_lemmas", none)))
            .drop("_lkey", "_lemmas"))


def trigram_rows(df: DataFrame, key_cols: list[str], text_col: str,
                 stop_words=T.ENGLISH_STOP_WORDS, lemmas: dict[str, str] | DataFrame | None = None,
                 out_col: str = "trigram") -> DataFrame:
    """``(key_cols..., trigram)``, distinct per row, one output row per trigram.

    The token array is projected on its own first so the regex pipeline runs
    once per row; the trigram array is de-duplicated inside the row before exploding (a map-side distinct).
    ``lemmas``: see :func:`with_tokens`.
    """
    toks = with_tokens(df.select(*key_cols, text_col), text_col, stop_words, lemmas).select(*key_cols, "_tokens")
    tri = toks.select(*key_cols, T.trigram_array("_tokens").alias("_tri"))
    # explode_outer + a null filter rather than explode: for explode Catalyst
    # infers ``size(array) > 0`` and pushes it below the projections, inlining
    # the whole token pipeline (several times) into the scan stage.
    rows = tri.select(*key_cols, F.explode_outer("_tri").alias(out_col))
    return rows.where(F.col(out_col).isNotNull())


def _novelty(df: DataFrame, keys: list[str], counts: DataFrame,
             text_cols: list[str], out_col: str) -> DataFrame:
    """Attach ``(n - seen) / n`` per key; 0.0 without trigrams, NULL on NULL text.

    The NULL test is taken before the join, so the texts themselves are only
    carried through the shuffle when the caller keeps them.
    """
    null_input = F.lit(False)
    for c in text_cols:
        null_input = null_input | F.col(c).isNull()
    joined = df.withColumn("_nullin", null_input).join(counts, keys, "left")
    score = (F.when(F.col("_nullin"), F.lit(None).cast("double"))
             .when(F.col("_n").isNull(), F.lit(0.0))
             .otherwise((F.col("_n") - F.col("_seen")) / F.col("_n")))
    return joined.withColumn(out_col, score).drop("_n", "_seen", "_nullin")


def originality_corpus(questions: DataFrame, corpus: DataFrame, key_col: str = "mcq_id",
                       question_col: str = "question", corpus_col: str = "content_gpt",
                       out_col: str = "originality_corpus", stop_words=T.ENGLISH_STOP_WORDS,
                       lemmas: dict[str, str] | DataFrame | None = None,
                       broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Share of a question's distinct trigrams found in no sheet of the corpus (T5).

    Three plans, chosen by a proven size of the question vocabulary (see
    :func:`question_vocabulary`: a length-based bound, then if needed an exact
    bounded count):

    * small question side - the question vocabulary is broadcast, the corpus
      is tokenised and probed map-side without being shuffled, and only the
      matching corpus trigrams (a subset of that vocabulary) move;
    * otherwise, where the questions are few or much smaller than the corpus -
      the corpus is probed map-side with a Bloom filter of the question
      vocabulary (of a fixed largest size); what passes is de-duplicated
      (partial aggregation first) and left-joined to the question trigrams in
      a sort-merge join, which makes the result exact;
    * otherwise - the distinct trigrams of both sides are packed into
      compressed blocks and compared part by part
      (:mod:`quizlens.operators.packed`).
    """
    counts = corpus_counts(questions, corpus, key_col, question_col, corpus_col, stop_words, lemmas,
                           broadcast_rows)
    return _novelty(questions, [key_col], counts, [question_col], out_col)


def corpus_counts(questions: DataFrame, corpus: DataFrame, key_col: str = "mcq_id",
                  question_col: str = "question", corpus_col: str = "content_gpt",
                  stop_words=T.ENGLISH_STOP_WORDS, lemmas: dict[str, str] | DataFrame | None = None,
                  broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``(key, _n, _seen)``: distinct trigrams per question and how many occur in the corpus."""
    q = questions.where(F.col(question_col).isNotNull())
    qt = trigram_rows(q, [key_col], question_col, stop_words, lemmas)
    ct = trigram_rows(corpus.where(F.col(corpus_col).isNotNull()), [], corpus_col, stop_words, lemmas)
    vocab = question_vocabulary(q, qt, question_col, broadcast_rows)
    if vocab is not None:
        hits = F.broadcast(ct.join(vocab, "trigram", "left_semi").distinct())
    elif (counts := _packed_counts(q, corpus, key_col, question_col, corpus_col, stop_words, lemmas)) is not None:
        return counts
    else:
        # Both sides grow with the data: never broadcast on an estimate.  The
        # distinct trigrams are stored first, so that both join inputs come
        # straight from an exchange and AQE can split a hot trigram.
        hits = cut_lineage(asked_trigrams(qt, ct, trigram_bound(q, question_col)[0]).distinct()).hint("merge")
    return (qt.join(hits.withColumn("_hit", F.lit(1)), "trigram", "left")
            .groupBy(key_col)
            .agg(F.count(F.lit(1)).alias("_n"), F.count("_hit").alias("_seen")))


# Up to this bound of question trigrams rows of them are cheap enough, and above it where the corpus is so many times larger
# that a filter of the questions leaves out most of it.
ROWS_BOUND = 4_000_000
FILTER_SHARE = 4


def _packed_counts(q: DataFrame, corpus: DataFrame, key_col: str, question_col: str, corpus_col: str, stop_words, lemmas) -> DataFrame | None:
    """:func:`corpus_counts` by packed blocks, or None where the plan by rows is the better one.

    A dict of lemmas and a lemma table that is not proven small stay with the rows.
    """
    bound, _ = trigram_bound(q, question_col)
    if bound <= ROWS_BOUND or isinstance(lemmas, dict) and lemmas:
        return None
    texts = corpus.where(F.col(corpus_col).isNotNull())
    whole, _ = trigram_bound(texts, corpus_col)
    if bound * FILTER_SHARE <= whole and bound <= MAX_BOUND_A_BIT * MAX_BLOCKS * WORDS * WORD_BITS:
        return None
    shared = None
    if isinstance(lemmas, DataFrame):
        small = _small_lemmas(lemmas)
        if small is None:
            return None
        shared = _shared_lemmas(small)
    return packed.corpus_counts(q, texts, key_col, T.normalized_text(question_col), T.normalized_text(corpus_col), max(bound, whole),
                                stop_words, shared)


# A filter that lets more of the absent trigrams pass is not worth its probes.
MAX_FALSE_RATE = 0.5
# Nor is one worth building where its bound is so far above its bits: texts hold
# about a fifth of the trigrams that their length allows, and at that share it
# would let more pass than the rate above.
MAX_BOUND_A_BIT = 2


def asked_trigrams(qt: DataFrame, ct: DataFrame, bound: int, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The corpus trigrams that a question may hold: all that one does, and few others.

    A Bloom filter of the question trigrams, sized for ``bound`` of them, is
    probed before the corpus is shuffled.  Its rate of false positives is
    measured; a filter that has become too full is not used, and one that the
    bound shows to become so is not built.  Either way the join that follows
    decides, so the result is the same.
    """
    blocks = block_count(bound, max_blocks)
    if bound > MAX_BOUND_A_BIT * blocks * WORDS * WORD_BITS:
        return ct
    table = cut_lineage(bloom_filter(qt, "trigram", blocks))
    if false_rate(table, blocks) > MAX_FALSE_RATE:
        return ct
    return may_contain(ct, "trigram", table, blocks)


# How far above the broadcast bound the cheap estimate may be before the
# exact (shuffling) vocabulary count is no longer worth running.
EXACT_CHECK_FACTOR = 8


def question_vocabulary(q: DataFrame, qt: DataFrame, question_col: str,
                        broadcast_rows: int) -> DataFrame | None:
    """The distinct question trigrams as a broadcast side, or None if too large.

    First a proof from text length alone (no tokenising, no shuffle); when
    that bound is within ``EXACT_CHECK_FACTOR`` of the limit, an exact but
    bounded count of the distinct vocabulary decides.
    """
    rows, size = trigram_bound(q, question_col)
    vocab = qt.select("trigram").distinct()
    if rows <= broadcast_rows and size <= DEFAULT_BROADCAST_BYTES:
        return F.broadcast(vocab)
    if rows <= EXACT_CHECK_FACTOR * broadcast_rows and at_most(vocab, broadcast_rows):
        return F.broadcast(vocab)
    return None


def trigram_bound(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Upper bounds on the trigram rows of a text column and on their bytes.

    Every token takes at least one character plus a separator, so a text of
    length L yields at most ``(L + 1) // 2`` tokens and no more trigrams than
    that; every byte of it is in at most three trigrams.
    """
    row = df.agg(F.sum(F.floor((F.length(text_col) + 1) / 2)).alias("n"), F.sum(F.octet_length(text_col)).alias("b")).first()
    rows = int(row["n"] or 0)
    return rows, 3 * int(row["b"] or 0) + rows * (ROW_OVERHEAD + 2)


def originality_paired(mcqs: DataFrame, sheets: DataFrame, id_col: str = "id", question_col: str = "question",
                       sheet_col: str = "content_gpt", out_col: str = "originality",
                       stop_words=T.ENGLISH_STOP_WORDS,
                       lemmas: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Share of a question's distinct trigrams absent from its own sheet (T4).

    Returns ``mcqs`` left-joined to ``sheets`` on ``id_col`` (rows multiply
    for duplicate sheet ids, as a left merge does) with the score added.
    Both tables are tokenised on their own partitions, each sheet row once
    however many questions cite it; the tokens travel with the one join (see
    :class:`RowTokens`) and the sets are compared inside the row, so a hot
    sheet id is an ordinary skewed join that AQE splits.
    """
    tokens = RowTokens(stop_words, lemmas)
    q = tokens.add(mcqs, question_col, "_qtk")
    s = tokens.add(sheets.select(id_col, sheet_col), sheet_col, "_stk")
    return tokens.novelty(q.join(s, id_col, "left"), "_qtk", "_stk", out_col)


def originality_rowwise(df: DataFrame, question_col: str = "question", sheet_col: str = "content_gpt",
                        out_col: str = "originality", stop_words=T.ENGLISH_STOP_WORDS,
                        lemmas: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """T4 on a table that already holds each question's sheet text: no join at all."""
    tokens = RowTokens(stop_words, lemmas)
    return tokens.novelty(tokens.add(tokens.add(df, question_col, "_qtk"), sheet_col, "_stk"), "_qtk", "_stk", out_col)


def sheet_keys(sheets: DataFrame, id_col: str, sheet_col: str) -> DataFrame:
    """``(id, sheet_col, _skey)``: each sheet row with the SHA-256 of its text."""
    return (sheets.select(F.col(id_col).alias("id"), sheet_col)
            .withColumn("_skey", F.sha2(F.col(sheet_col), 256)))


def trigram_difference(mcqs: DataFrame, sheets: DataFrame, key_col: str = "mcq_id",
                       id_col: str = "id", question_col: str = "question",
                       sheet_col: str = "content_gpt", stop_words=T.ENGLISH_STOP_WORDS,
                       lemmas: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Question trigrams missing from the question's sheet, one row each.

    Questions whose sheet is absent (or has no text) have no difference set.
    Questions and sheets are tokenised once and compared inside the joined
    row, as in T4; a hot sheet is a skewed join that AQE splits.  Rows of
    several sheets with one id count together: for such ids alone trigrams
    are exploded and anti-joined to a stored distinct side on
    ``(id, trigram)``.  Sheets that no question cites are left out before they
    are tokenised where the cited ids are few enough to broadcast.
    """
    asked = mcqs.where(F.col(question_col).isNotNull()).select(key_col, id_col, question_col)
    known = sheets.where(F.col(sheet_col).isNotNull()).select(id_col, sheet_col)
    cited, few = broadcast_if_small(cut_lineage(asked.select(id_col).distinct()))
    if few:
        known = known.join(cited, id_col, "left_semi")
    several = cut_lineage(known.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_col))
    table, _ = broadcast_if_small(several)

    tokens = RowTokens(stop_words, lemmas)
    q = tokens.add(asked, question_col, "_qtk").select(key_col, id_col, "_qtk")
    s = tokens.add(known.join(table, id_col, "left_anti"), sheet_col, "_stk").select(id_col, "_stk")
    # explode_outer: see trigram_rows.
    single = (tokens.missing(q.join(s, id_col), "_qtk", "_stk", "_missing")
              .select(key_col, F.explode_outer("_missing").alias("trigram")).where(F.col("trigram").isNotNull()))
    if several.isEmpty():
        return single
    qt = trigram_rows(asked.join(table, id_col, "left_semi"), [key_col, id_col], question_col, stop_words, lemmas)
    st = cut_lineage(trigram_rows(known.join(table, id_col, "left_semi"), [id_col], sheet_col, stop_words, lemmas).distinct())
    return single.unionByName(qt.join(st.hint("merge"), [id_col, "trigram"], "left_anti").select(key_col, "trigram"))


# ---------------------------------------------------------------- vectors

def ambiguity(mcqs: DataFrame, option_vectors: DataFrame, key_col: str = "mcq_id",
              correct_col: str = "correct_option", letter_col: str = "letter",
              vector_col: str = "embedding", out_col: str = "ambiguity") -> DataFrame:
    """Mean cosine of the correct option's vector with the other three.

    ``option_vectors`` is long: ``(key, letter, vector)``, one row per option.
    The four rows of a question are gathered by a group-by on the key (a
    bounded group of four), then scored with array functions.  A letter
    outside a-d gives 0.0, a NULL letter gives NULL.
    """
    vecs = option_vector_maps(option_vectors, key_col, letter_col, vector_col)
    return (mcqs.join(vecs, key_col, "left")
            .withColumn(out_col, ambiguity_from_map(correct_col, "_vecs")).drop("_vecs"))


def option_vector_maps(option_vectors: DataFrame, key_col: str = "mcq_id", letter_col: str = "letter",
                       vector_col: str = "embedding") -> DataFrame:
    """``(key, _vecs)``: a letter -> vector map per question (groups of four)."""
    return (option_vectors
            .groupBy(key_col)
            .agg(F.map_from_entries(F.collect_list(F.struct(F.lower(letter_col), vector_col)))
                 .alias("_vecs")))


def ambiguity_from_map(correct_col: str, vecs_col: str) -> Column:
    c = F.lower(F.col(correct_col))
    # Sum in option order a..d; the correct option's slot adds an exact 0.0,
    # so the result equals summing the three other cosines left to right.
    total = F.lit(0.0)
    for letter in OPTION_LETTERS:
        sim = cosine(F.try_element_at(vecs_col, c), F.try_element_at(vecs_col, F.lit(letter)))
        total = total + F.when(c == letter, F.lit(0.0)).otherwise(sim)
    return (F.when(c.isNull(), F.lit(None).cast("double"))
            .when(~c.isin(*OPTION_LETTERS), F.lit(0.0))
            .otherwise(total / F.lit(3.0)))


def options_long(mcqs: DataFrame, key_col: str = "mcq_id",
                 option_cols=("option_a", "option_b", "option_c", "option_d"),
                 text_col: str = "option_text") -> DataFrame:
    """``(key, letter, option_text)``: the four options of each question as rows."""
    arr = F.array(*[F.struct(F.lit(l).alias("letter"), F.col(c).alias(text_col))
                    for l, c in zip(OPTION_LETTERS, option_cols)])
    return mcqs.select(key_col, F.inline(arr))


# ---------------------------------------------------------------- summary

def score_summary(df: DataFrame, score_cols: list[str]) -> DataFrame:
    """One row per score: rows, NULLs, mean, min, max (booleans as 0/1)."""
    aggs = []
    for c in score_cols:
        v = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("score"),
                             F.count(F.lit(1)).alias("n_rows"),
                             F.count_if(F.col(c).isNull()).alias("n_null"),
                             F.avg(v).alias("mean"),
                             F.min(v).alias("min"),
                             F.max(v).alias("max")).alias(f"_s{len(aggs)}"))
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.col(f"_s{i}") for i in range(len(aggs))])))
