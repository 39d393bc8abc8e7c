"""Best-fit packing by bin completion with branch and bound.

Only lengths matter to a packing, and there are at most as many lengths as
tokens in a sequence, so the search runs on the histogram of lengths: a
bounded table, however many documents there are.  Its outcome is a list of
fillings, each to be used so many times; Spark ranks the pieces within their
length and gives each rank its place in a filling.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import drop_staged, ranked, ready, staged
from quizlens.llm.tokens import WHOLE, Memory, encoder, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
#: Bounds of the search: decisions in all, and steps within the enumeration of one filling.
MAX_NODES = 20_000
MAX_STEPS = 400
#: Lengths left, added up over the decisions: a decision on a table of many lengths costs more than one on few.
MAX_LENGTHS = 2_000_000
#: Fillings tried at one decision in the first turn of the search; each turn tries one more.
BRANCHES = 3

Plan = list[tuple[tuple[int, ...], int]]  # (lengths, descending; number of sequences so filled)


# ---------------------------------------------------------------- search on the histogram

def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by the sum, and by pieces that cannot share (Martello and Toth's L2)."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for limit in sorted({s for s in counts if 2 * s <= capacity} | {0}):
        large = sum(n for s, n in counts.items() if s > capacity - limit)
        medium = [(s, n) for s, n in counts.items() if capacity - limit >= s and 2 * s > capacity]
        small = sum(s * n for s, n in counts.items() if limit <= s and 2 * s <= capacity)
        free = sum((capacity - s) * n for s, n in medium)
        best = max(best, large + sum(n for _, n in medium) + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing with many pieces at a time: all sequences with the same contents move together."""
    open_: dict[int, Counter] = defaultdict(Counter)  # space left -> contents -> sequences
    spaces: list[int] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(spaces, size)
            if at == len(spaces):
                each = capacity // size
                moved = [((size,) * each, left // each)] * (left >= each) + [((size,) * (left % each), 1)] * (left % each > 0)
                left = 0
                for contents, n in moved:
                    _add(open_, spaces, capacity - sum(contents), contents, n)
                continue
            space = spaces[at]
            contents, n = next(iter(open_[space].items()))
            used = min(n, left)
            left -= used
            open_[space][contents] -= used
            if used == n:
                del open_[space][contents]
                if not open_[space]:
                    del open_[space]
                    spaces.pop(at)
            _add(open_, spaces, space - size, (*contents, size), used)
    return [(contents, n) for group in open_.values() for contents, n in group.items()]


def _add(open_, spaces, space, contents, n):
    if space not in open_:
        insort(spaces, space)
    open_[space][contents] += n


def completions(sizes: list[int], counts: dict[int, int], space: int, most: int) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated ways to fill ``space``, least waste first, at most ``most``, and whether these are all.

    ``sizes`` are the lengths left, ascending.  A set is dominated if a piece
    that is left would still fit, or if pieces of another set can each stand
    for one or several of its pieces (:func:`dominates`).  Larger pieces are
    tried first; a branch is left where it cannot waste less than the sets
    kept, or as little with fewer pieces.
    """
    kept: list[tuple[int, int, tuple[int, ...]]] = []  # (waste, pieces, set), least first
    steps, whole = 0, True

    def extend(chosen: tuple[int, ...], left: int, top: int):
        nonlocal steps, whole
        steps += 1
        fits = False
        at = bisect_right(sizes, min(left, top)) - 1
        while at >= 0:
            size = sizes[at]
            at -= 1
            if counts[size] <= chosen.count(size):
                continue
            fits = True
            rest = left - size
            full = len(kept) == most
            if full and (0, len(chosen) + 1) >= kept[-1][:2]:
                whole = False
                break  # not even a filling without waste would be kept
            if not full or (rest if rest < sizes[0] else 0, len(chosen) + 1) < kept[-1][:2]:
                extend((*chosen, size), rest, size)
            else:
                whole = False
            if steps >= MAX_STEPS:
                whole = False
                return
        # More room may be left for a smaller piece than ``top`` allows to ask; then this set is not full.
        if not fits and not any(counts[s] > chosen.count(s) for s in sizes[:bisect_right(sizes, left)]):
            if not any(dominates(other, chosen) for _, _, other in kept):
                kept[:] = [k for k in kept if not dominates(chosen, k[2])]
                insort(kept, (left, len(chosen), chosen))
                whole &= len(kept) <= most
                del kept[most:]

    extend((), space, space)
    if not kept:  # out of steps before any set was full: the greedy one
        chosen, left, top = (), space, space
        while (at := bisect_right(sizes, min(left, top)) - 1) >= 0:
            if counts[sizes[at]] > chosen.count(sizes[at]):
                chosen, left = (*chosen, sizes[at]), left - sizes[at]
            else:
                top = sizes[at] - 1
        return [chosen], False
    return [c for _, _, c in kept], whole


def dominates(larger: tuple[int, ...], smaller: tuple[int, ...]) -> bool:
    """True if the pieces of ``smaller`` can be dealt to those of ``larger`` without one overflowing.

    Whatever is packed with ``smaller`` in place can then be packed with
    ``larger``, by changing the pieces over.  Both are descending; the pieces
    are dealt first-fit, so some cases are not seen, and none is taken wrongly.
    """
    if sum(smaller) > sum(larger):
        return False
    rooms = list(larger)
    for size in smaller:
        for k in range(len(rooms) - 1, -1, -1):
            if rooms[k] >= size:
                rooms[k] -= size
                break
        else:
            return False
    return True


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> Plan:
    """Fillings that use every piece, in as few sequences as the search finds.

    The best-fit plan is the first incumbent.  The search fills a sequence
    around the largest piece left and goes back over its decisions where the
    sequences used and a bound on the rest cannot beat the incumbent.  The
    first turn goes back over the last decisions first, which is what large
    tables need.  The turns after it are a limited discrepancy search: each
    tries plans that differ from the first choices (the least waste, taken as
    often as the pieces allow) in one decision more than the turn before, among
    one choice more, a filling taken once included; so early decisions are
    revised as readily as late ones.  The search ends at the lower bound, when
    a turn left nothing out, after ``max_nodes`` decisions of the first turn
    and as many of the others, or when those have met ``MAX_LENGTHS`` lengths.
    """
    incumbent = best_fit(counts, capacity)
    used_best = sum(n for _, n in incumbent)
    bound = lower_bound(counts, capacity)
    nodes = met = 0
    for turn in range(max_nodes):
        if used_best <= bound or met >= MAX_LENGTHS:
            break
        if turn == 0:
            plan, _, _, whole = _turn(counts, capacity, max_nodes, BRANCHES, False, used_best, bound, max_nodes, max_nodes * capacity)
        else:
            plan, visited, lengths, whole = _turn(counts, capacity, turn - 1, BRANCHES + turn - 1, True, used_best, bound,
                                                  max_nodes - nodes, MAX_LENGTHS - met)
            nodes, met = nodes + visited, met + lengths
        if plan is not None:
            incumbent, used_best = plan, sum(n for _, n in plan)
        if whole or nodes >= max_nodes:
            break
    return incumbent


def _turn(counts: dict[int, int], capacity: int, allowed: int, most: int, single: bool, used_best: int, bound: int,
          max_nodes: int, max_lengths: int) -> tuple[Plan | None, int, int, bool]:
    """One turn of the search: a plan of fewer than ``used_best`` sequences if found, decisions made, lengths met, and whether nothing was left out."""
    left = dict(counts)
    sizes = sorted(left)
    total = sum(s * n for s, n in left.items())
    used, nodes, met, whole = 0, 0, 0, True
    found: Plan | None = None
    path: Plan = []
    spent = 0  # discrepancies on the path
    costs: list[int] = []
    stack: list[Iterator] = []

    def choices():
        nonlocal whole
        largest = sizes[-1]
        left[largest] -= 1
        options, all_of_them = completions(sizes, left, capacity - largest, most)
        left[largest] += 1
        whole &= all_of_them
        fillings = [(largest, *c) for c in options]
        times = [min(left[s] // n for s, n in Counter(f).items()) for f in fillings]
        ranked_choices = [*zip(fillings, times)]
        if single:
            ranked_choices += [(f, 1) for f, n in ranked_choices if n > 1]
        else:
            whole &= max(times) == 1
        if len(ranked_choices) > 1 and spent >= allowed:
            whole = False
            ranked_choices = ranked_choices[:1]
        return iter([(f, n, int(k > 0)) for k, (f, n) in enumerate(ranked_choices)])

    def take(filling, times):
        nonlocal total, used
        for size, n in Counter(filling).items():
            left[size] -= n * times
            at = bisect_left(sizes, size)
            there = at < len(sizes) and sizes[at] == size
            if left[size] and not there:
                sizes.insert(at, size)
            elif not left[size] and there:
                sizes.pop(at)
        total -= sum(filling) * times
        used += times

    def back():
        nonlocal spent
        filling, times = path.pop()
        take(filling, -times)
        spent -= costs.pop()

    if sizes:
        stack.append(choices())
    while stack:
        choice = next(stack[-1], None)
        if choice is None:
            stack.pop()
            if path:
                back()
            continue
        if nodes >= max_nodes or met >= max_lengths:
            return found, nodes, met, False
        nodes, met = nodes + 1, met + len(sizes)
        filling, times, cost = choice
        take(filling, times)
        path.append((filling, times))
        costs.append(cost)
        spent += cost
        if not sizes and used < used_best:
            found, used_best = list(path), used
            if used_best <= bound:
                return found, nodes, met, True
        if not sizes or used + -(-total // capacity) >= used_best:
            back()
            continue
        stack.append(choices())
    return found, nodes, met, whole


def plan_table(plan: Plan) -> dict[str, np.ndarray]:
    """Ranks of each length to places: from a rank on, ``each`` pieces a sequence, at an offset in it."""
    rows, next_rank, sequence = [], Counter(), 0
    for filling, times in plan:
        offset = 0
        for size, n in sorted(Counter(filling).items(), reverse=True):
            rows.append((size, next_rank[size], n, sequence, offset))
            next_rank[size] += n * times
            offset += n * size
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "each", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T))


# ---------------------------------------------------------------- Spark

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, cut: str | None, end_id: int, capacity: int, memory: Memory):
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path, cut, memory).encode(batch.column("text"))):
                ids += end
                n = len(ids) // 4
                stop = (n - 1) % capacity + 1  # the first piece takes what is over
                start = piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]),
                                             schema=_PIECES, preserve_index=False)

    return pieces


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])


def pieces_of(docs: DataFrame, tokenizer: str | None = None, cut: str | None = "spaces", end_id: int = END_ID,
              capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
              memory: Memory = WHOLE) -> DataFrame:
    """The pieces of each document's ids (with the end id): one, or several of ``capacity`` where it is longer."""
    ready(docs)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _cutter(tokenizer or tokenizer_path(TOKENIZER), cut, end_id, capacity, memory), PIECE_SCHEMA)


def _placer(table: dict[str, np.ndarray]):
    keys = (table["length"] << 44) + table["rank"]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            at = np.searchsorted(keys, (rows["length"].to_numpy() << 44) + rows["rank"].to_numpy(), side="right") - 1
            turn, slot = np.divmod(rows["rank"].to_numpy() - table["rank"][at], table["each"][at])
            rows["sequence_id"] = table["sequence"][at] + turn
            rows["offset"] = table["offset"][at] + slot * rows["length"].to_numpy()
            yield rows.drop(columns="rank")

    return place


def packed(docs: DataFrame, tokenizer: str | None = None, cut: str | None = "spaces", end_id: int = END_ID,
           capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           memory: Memory = WHOLE) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece of every document.

    Null texts count as empty and give one piece, the end id.  Every row of
    ``docs`` is packed, rows that repeat an id or a text too; null ids are
    packed like any other.  An empty table gives an empty result.  Other
    columns are not read.
    """
    pieces = staged(pieces_of(docs, tokenizer, cut, end_id, capacity, id_col, text_col, memory), "pack-pieces")
    # At most `capacity` rows, however many documents there are.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = plan_table(bin_completion(counts, capacity))
    places = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", "pack-ranks")
    drop_staged(pieces)
    return places.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        _placer(table), PIECE_SCHEMA + ", sequence_id long, offset long")
