"""Trigrams of many texts at once, over Arrow batches of normalised texts.

Words get numbers that hold within one slice of a batch, so trigrams are
compared as whole numbers made of three word numbers: exactly, without
building their strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 4 << 20


def slices(sizes: np.ndarray, most: int = SLICE_BYTES, most_rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """``(start, stop)`` of rows of at most ``most`` bytes together, one row at least."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
        stop = min(max(stop, start + 1), start + most_rows)
        yield start, stop
        start = stop


def text_bytes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def plain(texts) -> pa.Array:
    return texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts


def words(texts: pa.Array, stop_words: tuple[str, ...], lemmas=None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(row, number)`` of the content words of normalised texts, in order, and the words that the numbers stand for.

    ``lemmas`` is a pair of arrays, forms and what stands in their place (NULL: the form itself).
    """
    lists = pc.split_pattern(texts, " ")
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    known, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    kept = ~pc.is_in(known, value_set=pa.array([*stop_words, ""], known.type)).to_numpy(zero_copy_only=False)
    kept = kept[number]
    row, number = row[kept], number[kept].astype(np.int64)
    if lemmas is not None and len(lemmas[0]):
        forms, put = (a.cast(known.type) for a in lemmas)
        coded = pc.coalesce(put.take(pc.index_in(known, value_set=forms)), known).dictionary_encode()
        known, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[number]
    return row, number, known


def without_spaces(known: pa.Array) -> pa.Array:
    """The words for a list that spaces divide; only a lemma can be empty or hold a space, and it gets marks that no word has."""
    if not pc.any(pc.or_(pc.match_substring(known, " "), pc.equal(known, ""))).as_py():
        return known
    return pc.if_else(pc.equal(known, ""), pa.scalar("\x02", known.type), pc.replace_substring(known, " ", "\x01"))


def trigrams(row: np.ndarray, number: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """``(row, code, bound, first)`` of each trigram: equal codes, below ``bound``, are equal trigrams; ``first`` is the place of its first word."""
    first = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    code, bound = codes(number[first], number[first + 1], number[first + 2], known)
    return row[first], code, bound, first


def codes(a: np.ndarray, b: np.ndarray, c: np.ndarray, known: int) -> tuple[np.ndarray, int]:
    """One number below a bound for each triple of numbers below ``known``."""
    pair, pairs = a * known + b, known * known
    if pairs * known >= 1 << 63:
        some, pair = np.unique(pair, return_inverse=True)
        pairs = len(some)
    return pair * known + c, pairs * known


def by_row(row: np.ndarray, code: np.ndarray, bound: int, rows: int) -> tuple[np.ndarray, int]:
    """One number for each (row, code), rising with the row, and the factor of the row in it."""
    if rows * max(bound, 1) >= 1 << 63:
        some, code = np.unique(code, return_inverse=True)
        bound = len(some)
    return row * max(bound, 1) + code, max(bound, 1)


def found(sought: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of the sorted numbers ``sought`` are among the sorted numbers ``among``."""
    if not len(among):
        return np.zeros(len(sought), bool)
    at = np.searchsorted(among, sought)
    return among[np.minimum(at, len(among) - 1)] == sought


def missing(asked: pa.Array, held: pa.Array, stop_words, lemmas=None):
    """For rows of two normalised texts: (row of each distinct asked trigram, whether the other text lacks it, its first word's place, numbers, words)."""
    rows = len(asked)
    row, number, known = words(pa.concat_arrays([asked, held.cast(asked.type)]), stop_words, lemmas)
    row, code, bound, first = trigrams(row, number, len(known))
    mine = row < rows
    code, factor = by_row(np.where(mine, row, row - rows), code, bound, rows)
    sought, place = np.unique(code[mine], return_index=True)
    return sought // factor, ~found(sought, np.unique(code[~mine])), first[mine][place], number, known


def _by_slices(asked: pa.Array, held: pa.Array, run):
    asked, held = plain(asked), plain(held)
    parts = [run(asked.slice(a, b - a), held.slice(a, b - a)) for a, b in slices(text_bytes(asked) + text_bytes(held))]
    return pa.concat_arrays(parts) if parts else run(asked, held)


def novelty(asked: pa.Array, held: pa.Array, stop_words, lemmas=None) -> pa.Array:
    """T4 for each row: the share of the distinct trigrams of ``asked`` that ``held`` lacks."""
    def run(q, s):
        row, lacks, *_ = missing(q, s, stop_words, lemmas)
        n, new = np.bincount(row, minlength=len(q)), np.bincount(row[lacks], minlength=len(q))
        share = np.where(n > 0, new / np.maximum(n, 1), 0.0)
        return pa.array(share, pa.float64(), mask=(q.is_null().to_numpy(zero_copy_only=False) | s.is_null().to_numpy(zero_copy_only=False)))
    return _by_slices(asked, held, run)


def missing_lists(asked: pa.Array, held: pa.Array, stop_words, lemmas=None) -> pa.Array:
    """O4 for each row: the distinct trigrams of ``asked`` that ``held`` lacks; none where either is NULL."""
    def run(q, s):
        row, lacks, first, number, known = missing(q, s, stop_words, lemmas)
        there = ~(q.is_null().to_numpy(zero_copy_only=False) | s.is_null().to_numpy(zero_copy_only=False))
        lacks &= there[row] if len(row) else lacks
        row, first = row[lacks], first[lacks]
        text = pc.binary_join_element_wise(*(known.take(pa.array(number[first + k])) for k in range(3)), " ")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(q)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), text.cast(pa.string()))
    return _by_slices(asked, held, run)
