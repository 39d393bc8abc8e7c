"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes triggers the end of a piece, so piece ends
depend on nearby bytes only and an edit changes few pieces.  A piece becomes
one of 64 characters.  A fingerprint holds a block size (the mean distance of
piece ends, a power of two) and the signatures at that block size, at twice
and at four times that: ``block:signature:signature:signature``.  Fingerprints
are compared by edit distance at the smallest block size that they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import ready, shuffle_width

WINDOW = 7
SIGNATURE = 64
LEVELS = 3
LEAST_BITS = 0
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_ROLL = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``base``, modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        grown = np.full(max(n, 1 << 16) * 3 // 2, base, dtype=np.uint64)
        grown[0] = 1
        _powers[base] = np.cumprod(grown, dtype=np.uint64)
    return _powers[base]


def _triggers(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of it and the six before it (none before the start), low bits well mixed."""
    wide = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32) + np.uint32(1)])
    rolled = wide[:len(data)].copy()
    for k in range(1, WINDOW):
        rolled *= _ROLL
        rolled += wide[k:k + len(data)]
    rolled *= _MIX
    return rolled >> np.uint32(7)


def _signature(ends: np.ndarray, sums: np.ndarray) -> str:
    """One character a piece; the last of at most ``SIGNATURE`` pieces takes all that is left."""
    n = len(sums) - 1
    stops = ends[:SIGNATURE - 1] + 1
    if not len(stops) or stops[-1] < n:
        stops = np.append(stops, n)
    starts = np.concatenate([[0], stops[:-1]])
    # Position-free: the sum over a piece, moved back to the start of the text.
    values = (sums[stops] - sums[starts]) * _power(_INVERSE, len(sums))[starts]
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    return ALPHABET[(values >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text; of an empty one, the signatures are empty.

    The block size follows the length, and is halved once where that gives
    less than half a signature, so texts of which one is up to twice as long
    as the other share a block size.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return f"{1 << LEAST_BITS}:::"
    hashes = _triggers(data)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * _power(_BASE, len(data))[:len(data)], out=sums[1:])
    bits = max(LEAST_BITS, (len(data) // SIGNATURE).bit_length())
    ends = _ends(hashes, np.arange(len(data)), bits)
    if len(ends) < SIGNATURE // 2 and bits > LEAST_BITS:
        bits -= 1
        ends = _ends(hashes, np.arange(len(data)), bits)
    signatures = []
    for more in range(LEVELS):
        ends = _ends(hashes, ends, bits + more)
        signatures.append(_signature(ends, sums))
    return ":".join([str(1 << bits), *signatures])


def _ends(hashes: np.ndarray, among: np.ndarray, bits: int) -> np.ndarray:
    """Places where the low bits of the hash are all ones; those of a larger block size are a part of those of a smaller."""
    mask = np.uint32((1 << bits) - 1)
    return among[(hashes[among] & mask) == mask]


def likeness(a: str, b: str) -> Column:
    """0 to 1 from two columns of fingerprints: edit distance at the smallest block size they share, else 0."""
    (x, *xs), (y, *ys) = ([F.split(c, ":")[k] for k in range(LEVELS + 1)] for c in (a, b))

    def alike(p: Column, q: Column) -> Column:
        longest = F.greatest(F.length(p), F.length(q))
        return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(p, q) / longest)

    out = F.when(x == y, alike(xs[0], ys[0]))
    for apart in range(1, LEVELS):
        times = 1 << apart
        out = (out.when(x.cast("long") == y.cast("long") * times, alike(xs[0], ys[apart]))
               .when(x.cast("long") * times == y.cast("long"), alike(xs[apart], ys[0])))
    return out.otherwise(F.lit(0.0))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ranges, each range followed by the first row of the next: a text and the one after it."""
    last = None  # (range, id, text, fingerprint), waiting for its next
    for batch in batches:
        rows = []
        for part, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text"))):
            waits = last is not None and last[0] == part
            if ahead and not waits:
                continue  # a copy of the row that was just used
            own = fingerprint(text)
            if waits:
                _, before, old, old_print = last
                half = len(old) // 2
                edited = old[:len(old) - half] + text[:half]
                rows.append((before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), old_print,
                             fingerprint(edited), own))
            last = None if ahead else (part, doc_id, text, own)
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=_SCHEMA.names), schema=_SCHEMA, preserve_index=False)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64())] + [
    (n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")])


def _parted(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with ``part``, the range of its id and ``tie``; bounds are quantiles of the ids (one number a range).

    An id that is a bound several times holds that many ranges' worth of rows:
    they are cut by ``tie``, the hash of the text, into as many ranges.
    """
    bounds, cuts = np.unique(rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts), return_counts=True)
    bounds, last = bounds.astype("int64"), np.concatenate([[0], np.cumsum(cuts)])  # range after the last cut of a bound

    @F.pandas_udf("int")
    def part(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, ties in batches:
            known = ids.notna()
            values = ids.fillna(0).astype("int64").to_numpy()
            at = np.searchsorted(bounds, values, side="right")
            out = last[at]
            if len(bounds):
                before = np.maximum(at - 1, 0)
                share = (ties.to_numpy().astype("float64") / 2.0 ** 64 + 0.5) * cuts[before]
                own = last[before] + 1 + np.minimum(share.astype("int64"), cuts[before] - 1)
                out = np.where((at > 0) & (bounds[before] == values), own, out)
            yield pd.Series(np.where(known, out, 0))

    return rows.withColumn("part", part("doc_id", "tie"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    One row per row of ``docs``.  The edited text replaces the last
    floor(n_chars / 2) code points by the first as many, or all, of the next
    document in ascending order of id (after the last: the first; of a single
    row: its own).  Null texts count as empty; two empty texts are alike (1).
    Null ids come first; rows that repeat an id follow in the order of their
    texts' hash.  An empty table gives an empty result.  Other columns are
    not read.

    Texts are shuffled once, by ranges of ids; the first row of each range
    goes to the range before it too, so no row waits for another task.
    """
    spark = ready(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    width = shuffle_width(spark)
    rows = _parted(rows, 4 * width)
    # One row a range.
    firsts = sorted((r["part"], r["f"]["doc_id"], r["f"]["tie"]) for r in
                    rows.groupBy("part").agg(F.min(F.struct("doc_id", "tie")).alias("f")).collect())
    ahead = [(doc_id, tie, firsts[k - 1][0]) for k, (_, doc_id, tie) in enumerate(firsts)]
    table = spark.createDataFrame(ahead, "first long, first_tie long, before int")
    sent = rows.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("tie") == F.col("first_tie")), "left")
    both = sent.select("doc_id", "tie", "text", F.explode(F.expr(
        "if(before is null, array(struct(part as part, false as ahead)), "
        "array(struct(part as part, false as ahead), struct(before as part, true as ahead)))")).alias("to"))
    ordered = (both.select("to.part", "to.ahead", "doc_id", "tie", "text").repartition(width, "part")
               .sortWithinPartitions("part", "ahead", "doc_id", "tie", "text"))
    return ordered.mapInArrow(_edits, _OUT).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"))
