"""Substring dedup by sliding spans of sentences and of words.

Every run of several consecutive sentences is hashed; runs meet on their hash
over the whole corpus; what is covered by an occurrence of a repeated run that
is not its first is removed.  Texts are cut into sentences at sentence ends,
line ends and before capital letters, so that a passage put into the middle of
another sentence is cut at its own first word.

A repeated stretch need not hold whole sentences, so every window of ``WINDOW``
words is matched too, wherever it starts.  Not every window becomes a row: each
names the smallest hash among its short word runs, its seed.  Equal windows
name equal seeds, so only windows whose seed occurs in two places can repeat,
and only those are hashed and met in a second pass.  No repeated window is
lost by that.

Of equal texts the one of the smallest id stands for all: every span of the
others has occurred before, so their spans need no meeting.  Windows inside
one removed run need none either.  Such a window is gone already, and an
earlier one like it lies in the run's first occurrence, so the first of all
equal windows is never inside a removed run and is always there to meet.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import BROADCAST_PAIRS, drop_staged, ready, shuffle_width, staged, text_hash
from quizlens.plans.sizing import broadcast_if_small

#: A run has at least so many sentences and words; from ``LONG`` words on, the number of sentences does not matter.
SENTENCES = 3
WORDS = 12
LONG = 25
#: Words of a window that counts whatever sentences it holds, and of a seed in it.
WINDOW = 50
SEED = 25
#: Most texts with their ranges that are broadcast; beyond them the joins shuffle.
BROADCAST_TEXTS = BROADCAST_PAIRS // 10
#: Classes of characters, as bits.
_SPACE, _NEWLINE, _CAPITAL, _END, _SINGLE, _SINGLE_END = (1 << k for k in range(6))
_RANGES = {
    _NEWLINE: "\n", _CAPITAL: "A-ZÀ-ÖØ-ÞΑ-ΩА-Я", _END: ".!?।॥؟۔։።", _SINGLE_END: "。！？｡",
    #: Scripts written without spaces: each character is a word.
    _SINGLE: "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
             "\uff00-\uffef\U00020000-\U0003ffff",
}
_BASE = 0x9E3779B97F4A7C15
_CHAR_BASE = 0xD6E8FEB86659FD93
#: Parts hashes of seeds from those of spans.
_TAG = np.uint64(0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread over 64 bits, one to one (the finalizer of SplitMix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse, from 0 to ``n`` at least."""
    if base not in _powers or len(_powers[base][0]) <= n:
        one = np.uint64(1)
        _powers[base] = tuple(np.cumprod(np.append(one, np.full(max(n, 1 << 14), f, dtype=np.uint64)), dtype=np.uint64)
                              for f in (base, pow(base, -1, 1 << 64)))
    return _powers[base]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers_of(base, len(values))[0][:len(values)], dtype=np.uint64)])


def _between(sums: np.ndarray, i, j, base: int) -> np.ndarray:
    """Hash of the values from ``i`` up to ``j``, wherever they stand, and of their number."""
    return _mixed((sums[j] - sums[i]) * _powers_of(base, len(sums))[1][i] + (j - i).astype(np.uint64) * np.uint64(_TAG))


def _classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    out[[k for k in range(1 << 16) if chr(k).isspace()]] = _SPACE
    for bit, chars in _RANGES.items():
        for first, last in re.findall("(.)(?:-(.))?", chars, re.S):
            out[ord(first):ord(last or first) + 1] |= bit
    return out


_CLASS = _classes()
_POINT = _mixed(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * np.uint64(_BASE))


class _Words:
    """The words of a text.

    ``starts`` (code points, with the end of the text), hashes of any stretch
    of words, and ``cuts``: the starts of the sentences, and the text's end.
    A sentence starts after a space that holds a line end, follows a sentence
    end or stands before a capital letter.
    """

    def __init__(self, text: str):
        size = len(text)
        points = np.frombuffer(text.encode(), dtype=np.uint8) if text.isascii() else np.frombuffer(
            text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _CLASS[points]
        space = np.concatenate([[True], kind & _SPACE != 0, [True]])
        single = np.concatenate([[False], kind & (_SINGLE | _SINGLE_END) != 0, [False]])
        edge = space[1:] != space[:-1]
        edge |= (single[1:] | single[:-1]) & ~(space[1:] & space[:-1])
        # Between characters k - 1 and k: a word starts if k is no space, and ends if k - 1 is none.
        first, last = np.flatnonzero(edge & ~space[1:]), np.flatnonzero(edge & ~space[:-1])
        self.n = len(first)
        self.starts = np.append(first, size)
        words = _between(_sums(_POINT[points], _CHAR_BASE), first, last, _CHAR_BASE)
        self.sums = _sums(words, _BASE)
        self.other_sums = _sums(_mixed(words), _CHAR_BASE)
        # Gap k stands before word k, the last one before the end of the text.
        ends, begins = np.append(0, last), self.starts
        lines = np.append(0, np.cumsum(kind & _NEWLINE != 0))
        cut = lines[begins] > lines[ends]
        before = np.append(np.uint8(0), kind[last - 1])
        gap = begins > ends
        cut |= gap & (before & _END != 0)
        cut |= before & _SINGLE_END != 0
        cut[:-1] |= gap[:-1] & (kind[first] & _CAPITAL != 0)
        self.cuts = np.unique(np.concatenate([[0], begins[cut], [size]]))

    def hashes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``i`` up to ``j``; white space does not matter."""
        return _between(self.sums, i, j, _BASE)

    def checks(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """32 more bits about the same words, from another hash: with the 64 of ``hashes``, they tell spans apart."""
        return (_between(self.other_sums, i, j, _CHAR_BASE) >> np.uint64(32)).astype(np.uint32)

    def seeds(self, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """For every window, the word at which its seed starts; and the hashes of all short runs."""
        if self.n < window:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.arange(self.n - seed + 1)
        short = self.hashes(at, at + seed) ^ _TAG
        choice = np.lib.stride_tricks.sliding_window_view(short, window - seed + 1).argmin(axis=1)
        return choice + np.arange(len(choice)), short


def sentences(text: str) -> np.ndarray:
    """Starts of the sentences of a text, and its end."""
    return _Words(text).cuts


def _reach(before: np.ndarray, words: int) -> np.ndarray:
    return np.searchsorted(before, before[:-1] + words, side="left")


def _back(before: np.ndarray, words: int) -> np.ndarray:
    return np.searchsorted(before, before[1:] - words, side="right") - 1


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _sentence_runs(found: _Words, least: int, words: int) -> Spans:
    cuts = found.cuts
    n = len(cuts) - 1
    before = np.searchsorted(found.starts[:-1], cuts)
    each = np.arange(n)
    # The first sentence with which a run from each is long enough, and the last one from which a run up to each is.
    stop, start = np.maximum(each + least, _reach(before, words)), np.minimum(each + 1 - least, _back(before, words))
    stop, start = np.minimum(stop, _reach(before, LONG)), np.maximum(start, _back(before, LONG))
    i, j = np.divmod(np.unique(np.concatenate([(each * (n + 1) + stop)[stop <= n], (start * (n + 1) + each + 1)[start >= 0]])), n + 1)
    return found.hashes(before[i], before[j]), cuts[i], cuts[j], found.checks(before[i], before[j])


def _windows(found: _Words, window: int, seed: int, repeated: list[int] | None = None, gone: list[dict] | None = None) -> Spans:
    """Every window, or those whose seed starts at one of the words ``repeated``; without those inside a range of ``gone``."""
    choice, _ = found.seeds(window, seed)
    i = np.arange(len(choice)) if repeated is None else np.flatnonzero(np.isin(choice, repeated))
    if gone:
        ranges = np.array([(r["start"], r["end"]) for r in gone])
        ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
        # The furthest end of the ranges that start at or before a window.
        at = np.searchsorted(ranges[:, 0], found.starts[i], side="right") - 1
        i = i[(at < 0) | (np.maximum.accumulate(ranges[:, 1])[at] < found.starts[i + window])]
    return found.hashes(i, i + window), found.starts[i], found.starts[i + window], found.checks(i, i + window)


def spans(text: str, least: int = SENTENCES, words: int = WORDS, window: int = WINDOW,
          seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (code points) of every span that is matched.

    These are the runs of sentences, the shortest from each sentence and the
    shortest up to each, and all windows of words.  A hash is made of the
    words, so white space does not matter.
    """
    found = _Words(text)
    both = zip(_sentence_runs(found, least, words), _windows(found, window, seed))
    h, start, end, _ = (np.concatenate(x) for x in both)
    order = np.lexsort((end, start))
    return h[order], start[order], end[order]


def _rows(batch: pa.RecordBatch, each: list[Spans]) -> pa.RecordBatch:
    of = np.repeat(np.arange(len(each)), [len(x[0]) for x in each])
    h, s, e, c = (np.concatenate([x[k] for x in each]) if each else np.empty(0, np.int64) for k in range(4))
    rows = pa.array(of, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(h.astype(np.uint64).view(np.int64)), pa.array(c.astype(np.uint32).view(np.int32)), batch.column("id").take(rows),
         batch.column("h").take(rows), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))],
        names=["span", "check", "id", "h", "start", "end"])


def _run_lists(least: int, words: int, window: int, seed: int):
    """The runs of sentences of each text, and its seeds: their word as ``start``, -1 as ``end``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, seeds = [], []
            for text in batch.column("text").to_pylist():
                found = _Words(text or "")
                choice, short = found.seeds(window, seed)
                at = choice[np.flatnonzero(np.diff(choice, prepend=-1))]
                runs.append(_sentence_runs(found, least, words))
                seeds.append((short[at], at, np.full(len(at), -1), np.zeros(len(at))))
            yield _rows(batch, runs)
            yield _rows(batch, seeds)

    return run


def _window_lists(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(batch, [_windows(_Words(t or ""), window, seed, at, gone)
                                for t, at, gone in zip(*(batch.column(c).to_pylist() for c in ("text", "seeds", "gone")))])

    return run


#: Places are numbers of code points, of which a text holds less than 2^31.
SPAN_SCHEMA = "span long, check int, id long, h long, start int, end int"


def _copies(rows: DataFrame) -> DataFrame:
    """``(copy_of, keep)`` for each text that several ids have: its SHA-256 and the smallest of the ids (null first)."""
    ids = F.struct("id")
    several = (rows.groupBy(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("copy_of")).agg(F.min(ids).alias("keep"), F.max(ids).alias("last"))
               .where(F.col("keep") != F.col("last")).select("copy_of", F.col("keep.id").alias("keep")))
    return staged(several, "copies")


def _with_copies(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: whether a row of a smaller id has the same text."""
    copies, _ = broadcast_if_small(copies, BROADCAST_PAIRS)
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return (rows.join(copies, key == F.col("copy_of"), "left")
            .withColumn("copy", F.col("copy_of").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))).drop("copy_of", "keep"))


def _merged(ranges: F.Column) -> F.Column:
    """Sorted ranges, those that meet put together."""
    def add(done: F.Column, r: F.Column) -> F.Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(r["start"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(r)))

    return F.aggregate(F.sort_array(ranges), F.array().cast("array<struct<start:int,end:int>>"), add)


#: Rows of :func:`_mark_later`: an occurrence that is not the first, and the first and last rows of a sorted part.
_LATER, _HEAD, _TAIL = range(3)
_MARKS = SPAN_SCHEMA + ", part int, kind int"


def _mark_later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted part, the occurrences of each span after its first place; and the part's first and last rows."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def marked(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, kind, np.int32))],
                                          names=[*rows.schema.names, "part", "kind"])

    first = last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.stack([batch.column(k).fill_null(np.iinfo(np.int64).min).to_numpy().astype(np.int64) if k == 2
                         else batch.column(k).to_numpy().astype(np.int64) for k in range(5)])
        if first is None:
            yield marked(batch.slice(0, 1), _HEAD)
            first = keys[:, 0]
        # The place at which each row's span was first seen, carried over from the batch before.
        both = np.concatenate([first[:, None], keys], axis=1)
        head = np.append(0, np.where((both[:2, 1:] != both[:2, :-1]).any(axis=0), np.arange(1, n + 1), 0))
        head = np.maximum.accumulate(head)[1:]
        later = (both[2:, 1:] != both[2:, head]).any(axis=0)
        if later.any():
            yield marked(batch.filter(pa.array(later)), _LATER)
        first, last = both[:, head[-1]], batch.slice(n - 1, 1)
    if last is not None:
        yield marked(last, _TAIL)


def later_occurrences(each: DataFrame, name: str) -> DataFrame:
    """``(id, h, start, end)`` of all occurrences of each span but those at its first place.

    One sort by ranges of (span, place): a span that very many texts hold lies
    in as many parts as it needs.  Only whether a part's first span goes on
    from the part before is settled afterwards, on two rows a part.
    """
    order = ["span", "check", "id", "h", "start"]
    marks = staged(each.repartitionByRange(shuffle_width(each.sparkSession), *order).sortWithinPartitions(*order)
                   .mapInArrow(_mark_later, _MARKS), f"later-{name}")
    before = Window.orderBy("part", "kind")
    edges = (marks.where(F.col("kind") != _LATER).withColumns({"s": F.lag("span").over(before), "c": F.lag("check").over(before)})
             .where((F.col("kind") == _HEAD) & (F.col("s") == F.col("span")) & (F.col("c") == F.col("check"))))
    place = ["id", "h", "start", "end"]
    out = marks.where(F.col("kind") == _LATER).select(*place).unionByName(edges.select(*place))
    out._staged_path = marks._staged_path
    return out


def repeated_spans(rows: DataFrame, least: int = SENTENCES, words: int = WORDS, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``(id, h, removed)`` from ``(id, h, text)`` without copies of texts: the ranges of spans that occurred before.

    The first occurrence is that of the smallest id, then text hash, then place.
    """
    both = staged(rows.mapInArrow(_run_lists(least, words, window, seed), SPAN_SCHEMA), "sentence-spans")
    seeds = both.where("end < 0").select("span", "id", "h", F.col("start").alias("word"))
    often = staged(seeds.groupBy("span").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("span"), "repeated-seeds")
    small, _ = broadcast_if_small(often, BROADCAST_PAIRS)
    suspects = staged(seeds.join(small, "span").groupBy("id", "h").agg(F.collect_set("word").alias("seeds")), "suspects")
    runs = later_occurrences(both.where("end >= 0"), "runs")
    drop_staged(both, often)
    gone = runs.groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))
    asked = staged(suspects.join(gone, same, "left").select(F.col("id").alias("si"), F.col("h").alias("sg"), "seeds", "gone"), "asked")
    few, _ = broadcast_if_small(asked, BROADCAST_TEXTS)
    some = rows.join(few, F.col("id").eqNullSafe(F.col("si")) & (F.col("h") == F.col("sg"))).select("id", "h", "text", "seeds", "gone")
    windows = staged(some.mapInArrow(_window_lists(window, seed), SPAN_SCHEMA), "word-windows")
    late = later_occurrences(windows, "windows")
    drop_staged(windows, suspects, asked)
    out = staged(runs.unionByName(late).groupBy("id", "h").agg(_merged(F.collect_set(F.struct("start", "end"))).alias("removed")), "removed-spans")
    drop_staged(runs, late)
    return out


def _cut_with(least: int, words: int, window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cut(batch, least, words, window, seed)

    return run


def _cut(batch: pa.RecordBatch, least: int, words: int, window: int, seed: int) -> pa.RecordBatch:
    """Texts without their removed ranges; a copy of an earlier text loses every span that it has."""
    out = []
    for doc_id, text, copy, removed in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "copy", "removed"))):
        if copy:
            _, start, end = spans(text or "", least, words, window, seed)
            ranges = zip(start.tolist(), end.tolist())
        else:
            ranges = ((r["start"], r["end"]) for r in removed or ())
        merged: list[list[int]] = []
        for a, b in ranges:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        if merged:
            edges = [0, *(x for m in merged for x in m), len(text)]
            text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append({"doc_id": doc_id, "text": text, "n_spans": len(merged), "n_removed": sum(b - a for a, b in merged),
                    "removed": ",".join(f"{a}:{b}" for a, b in merged)})
    return pa.RecordBatch.from_pylist(out, schema=pa.schema([
        ("doc_id", pa.int64()), ("text", pa.string()), ("n_spans", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.string())]))


def deduplicated(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, id_col: str = "doc_id",
                 text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``(doc_id, text, n_spans, n_removed, removed)``, one row per row of ``docs``.

    ``text`` is what is left; ``removed`` lists ``start:end`` in code points
    of the original text, ``n_removed`` counts them.  A text without repeats
    is returned as it is, a null text as null.  Rows that agree in id and text
    count as one text and are treated alike; texts with fewer sentences than a
    run and fewer words than a window are left alone.  Null ids come first.  An empty table gives an empty
    result.  Other columns are not read.
    """
    ready(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    known = _with_copies(rows, _copies(rows))
    gone = repeated_spans(known.where("not copy").drop("copy"), least, words, window, seed)
    few, _ = broadcast_if_small(gone.select(F.col("id").alias("i"), F.col("h").alias("g"), "removed"), BROADCAST_TEXTS)
    return known.join(few, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left").select(
        "id", "text", "copy", "removed").mapInArrow(_cut_with(least, words, window, seed),
                                                    "doc_id long, text string, n_spans long, n_removed long, removed string")
