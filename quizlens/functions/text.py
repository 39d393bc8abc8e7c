"""Text Column builders: strip, word classes, tokens, trigrams, text scores.

Everything here returns a ``Column`` built from JVM-side functions
(``regexp_*``, ``trim``, ``split``, ``slice``, ``arrays_zip``), so the
scores run inside whole-stage codegen or Spark's native array functions and
work unchanged on batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Fixed values.  These must equal the behaviour being reproduced; they are
# listed plainly, in their natural order.
# --------------------------------------------------------------------------

# The characters Python's ``str.isspace()`` / ``str.strip()`` / ``str.split()``
# treat as whitespace (29 code points).  Spark's ``trim`` only drops spaces.
PY_WHITESPACE_CODEPOINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
    0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
PY_WHITESPACE = "".join(chr(cp) for cp in PY_WHITESPACE_CODEPOINTS)
# The same set as a regex class body, valid in Java regex and RE2.
PY_WHITESPACE_CLASS = r"\s\x0b\x1c-\x1f\x85\p{Z}"

# A Python ``\w`` character (Unicode letters, digits, numerics, underscore).
WORD_CLASS = r"\p{L}\p{N}_"

# Negation words a question may start with (case-insensitive, whole word).
NEGATION_WORDS = (
    "not", "no", "don't", "doesn't", "isn't", "aren't", "wasn't", "weren't",
    "won't", "can't", "couldn't", "shouldn't", "wouldn't", "didn't",
    "haven't", "hasn't", "hadn't", "mustn't",
)

# Interrogative words a question may start with (case-insensitive, whole word).
QUESTION_WORDS = (
    "who", "what", "where", "when", "why", "how", "does", "should", "do",
    "did", "could", "will", "would",
)

# English stop words removed before trigrams are formed (the common
# 179-word English list of the NLTK corpus, in its published order).
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her",
    "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "that'll", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "don't", "should", "should've", "now", "d", "ll", "m",
    "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn",
    "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won",
    "won't", "wouldn", "wouldn't",
)

# Fused words the word tokenizer splits in two (whole tokens only).
FUSED_WORDS = (
    ("can", "not"), ("gim", "me"), ("gon", "na"),
    ("got", "ta"), ("lem", "me"), ("wan", "na"),
)

# Readability (Flesch-Kincaid grade) coefficients and the vowel set.
FK_WORDS_PER_SENTENCE = 0.39
FK_SYLLABLES_PER_WORD = 11.8
FK_OFFSET = 15.59
VOWELS = "aeiouy"
SENTENCE_MARKS = ".!?"

# --------------------------------------------------------------------------


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _alternation(words) -> str:
    return "|".join(words)


def py_strip(c: str | Column) -> Column:
    """``str.strip()``: drop Python whitespace at both ends."""
    return F.trim(_col(c), F.lit(PY_WHITESPACE))


def py_lstrip(c: str | Column) -> Column:
    return F.ltrim(_col(c), F.lit(PY_WHITESPACE))


# A character that is no whitespace; printable ASCII is told by the range alone.
_NO_SPACE = f"[!-~[^{PY_WHITESPACE_CLASS}]]"


def word_count(c: str | Column) -> Column:
    """``len(text.split())``: maximal runs of non-whitespace."""
    return F.regexp_count(_col(c), F.lit(f"{_NO_SPACE}+"))


def sentence_count(c: str | Column) -> Column:
    """Occurrences of ``.``, ``!`` and ``?``."""
    return F.regexp_count(_col(c), F.lit(f"[{SENTENCE_MARKS}]"))


def syllable_count(c: str | Column) -> Column:
    """Sum over words of ``max(1, vowel runs in lower(word))``.

    Vowel runs never cross whitespace, so the sum equals the vowel runs of the
    whole lower-cased text plus one per word that holds no vowel.  One regex
    counts both: a vowel run with the consonants before it (and those after
    it, where they end the word), or a word of consonants alone.  Quantifiers
    are possessive, as no shorter run could match.
    """
    other = f"[^{PY_WHITESPACE_CLASS}{VOWELS}]"
    pattern = f"{other}*+[{VOWELS}]++(?:{other}++(?![{VOWELS}]))?+|{other}++"
    return F.regexp_count(F.lower(_col(c)), F.lit(pattern))


def readability_counts(c: str | Column) -> Column:
    """struct<w, s, y>: words, sentence marks, syllables of a text."""
    return F.struct(word_count(c).alias("w"), sentence_count(c).alias("s"),
                    syllable_count(c).alias("y"))


def readability_from_counts(counts: str | Column) -> Column:
    """Flesch-Kincaid grade from :func:`readability_counts`."""
    k = _col(counts)
    w, s, y = k["w"], k["s"], k["y"]
    score = (F.lit(FK_WORDS_PER_SENTENCE) * (w / s)
             + F.lit(FK_SYLLABLES_PER_WORD) * (y / w)
             - F.lit(FK_OFFSET))
    return F.when((w > 0) & (s > 0), score)


def readability(c: str | Column) -> Column:
    """Flesch-Kincaid grade; NULL when there are no words or no sentence marks.

    One expression (usable anywhere a Column is); the DataFrame operator
    projects the counts first so each regex pass runs once per row.
    """
    return readability_from_counts(readability_counts(c))


def _starts_with_word(c: str | Column, words) -> Column:
    pattern = f"(?iu)^(?:{_alternation(words)})(?![{WORD_CLASS}])"
    return py_strip(c).rlike(pattern)


def starts_with_negation(c: str | Column) -> Column:
    """Stripped text starts with a negation word, case-insensitive."""
    return _starts_with_word(c, NEGATION_WORDS)


def is_question(c: str | Column) -> Column:
    """Stripped text ends with ``?`` or starts with an interrogative word."""
    stripped = py_strip(c)
    return stripped.endswith("?") | _starts_with_word(c, QUESTION_WORDS)


def length_score(c: str | Column, lower: float, upper: float) -> Column:
    """1 inside [lower, upper] words, ``(upper/n)^2`` above, ``(n/lower)^2`` below."""
    if lower <= 0 or upper < lower:
        raise ValueError("need 0 < lower <= upper")
    n = word_count(c)
    above = F.lit(float(upper)) / n
    below = n / F.lit(float(lower))
    return (F.when(n.isNull(), None)
            .when((n >= lower) & (n <= upper), F.lit(1.0))
            .when(n > upper, above * above)
            .otherwise(below * below))


# --------------------------------------------------------------------------
# Tokens and trigrams
# --------------------------------------------------------------------------

def _fused_pattern() -> str:
    parts = [f"{a}(?={b}(?![^ ]))" for a, b in FUSED_WORDS]
    return f"(?<![^ ])(?:{'|'.join(parts)})"


def normalized_text(c: str | Column) -> Column:
    """Non-word runs to one space, lower case, trimmed, fused words split.

    The fused words' regex looks at every character; it runs on texts that
    hold one of them, which a plain search tells.
    """
    cleaned = F.trim(F.lower(F.regexp_replace(_col(c), f"[^{WORD_CLASS}]+", " ")))

    def split_fused(t: Column) -> Column:
        held = F.lit(False)
        for parts in FUSED_WORDS:
            held = held | F.contains(t, F.lit("".join(parts)))
        return F.when(held, F.regexp_replace(t, _fused_pattern(), "$0 ")).otherwise(t)

    # The lambda binds the cleaned text, so that it is made once.
    return F.get(F.transform(F.array(cleaned), split_fused), F.lit(0))


def content_tokens(c: str | Column, stop_words=ENGLISH_STOP_WORDS,
                   lemmas: dict[str, str] | None = None) -> Column:
    """Tokens with stop words removed (then lemmatised when a map is given).

    Stop-word removal happens before lemmatising.  ``lemmas`` is a small
    form->lemma dictionary applied as a literal map; large lemma tables go
    through :func:`quizlens.operators.scores.trigram_rows` instead.
    """
    toks = F.split(normalized_text(c), " ")
    stop = [F.lit(w) for w in stop_words]
    if stop:
        toks = F.filter(toks, lambda t: (t != "") & ~t.isin(*stop))
    else:
        toks = F.filter(toks, lambda t: t != "")
    if lemmas:
        mapping = F.create_map(*[F.lit(x) for kv in sorted(lemmas.items()) for x in kv])
        toks = F.transform(toks, lambda t: F.coalesce(F.try_element_at(mapping, t), t))
    return toks


def trigrams_of(tokens: str | Column) -> Column:
    """Consecutive token triples of an array column, as 'a b c' strings, in order and with repeats.

    ``tokens`` should be an already-projected column: it is read at three
    places for each triple.
    """
    t = _col(tokens)
    first = F.slice(t, 1, F.greatest(F.size(t) - 2, F.lit(0)))
    space = F.lit(" ")
    return F.transform(first, lambda x, i: F.concat(x, space, F.get(t, i + 1), space, F.get(t, i + 2)))


def trigram_array(tokens: str | Column) -> Column:
    """Distinct consecutive token triples of an array column: see :func:`trigrams_of`."""
    return F.array_distinct(trigrams_of(tokens))
