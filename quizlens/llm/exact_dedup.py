"""Exact dedup by a Golomb-coded fingerprint exchange.

1. One pass over the texts leaves a narrow table: id, SHA-256 of the
   normalised text and a 48-bit fingerprint (its first six bytes).
2. Each part (rows that were read together) sends its distinct fingerprints,
   sorted and Golomb-Rice coded, to their owners; an owner holds a range of
   the fingerprint space.  A text that fills a third of all rows is one
   fingerprint a part.
3. Owners send back a bitmap for each list: which entries another part has too.
4. Parts mark their suspect rows (found by an owner, or repeated in the part).
   Only suspects' texts are read again and grouped by their bytes, with
   partial aggregation before the shuffle.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm import golomb
from quizlens.llm.common import keep_rows, ready, shuffle_width, staged, text_hash
from quizlens.plans.sizing import broadcast_if_small

FINGERPRINT_BITS = 48
#: A part holds up to 2^20 rows that one task read in a row.
PART_BITS = 20
#: Largest table of (id, hash) pairs that is broadcast; beyond it the join is a shuffle join.
BROADCAST_ROWS = 50_000


def normalised(col: str):
    """A-Z lower-cased, nothing else; null as empty."""
    return F.translate(F.coalesce(F.col(col).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # bytes.lower() changes A-Z alone; bytes of non-ASCII characters stay.
        shas = [hashlib.sha256((t or b"").lower()) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), batch.column("h"),
             pa.array([int.from_bytes(s.digest()[: FINGERPRINT_BITS // 8]) for s in shas], pa.int64()),
             pa.array([s.hexdigest() for s in shas], pa.string())], names=["rid", "doc_id", "h", "fp", "sha"])


def _lists(fps: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray]]:
    """The slice of each owner of sorted distinct fingerprints."""
    bounds = np.searchsorted(fps, _low(np.arange(owners + 1), owners))
    for owner in range(owners):
        if bounds[owner] < bounds[owner + 1]:
            yield owner, fps[bounds[owner]:bounds[owner + 1]]


def _low(owner, owners: int):
    """Lowest fingerprint of an owner's range (of an array of owners: of each)."""
    return owner * ((1 << FINGERPRINT_BITS) // owners + 1)


def _send(owners: int):
    def send(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(rows["fp"].to_numpy())
        out = [(key[0], owner, len(own), *golomb.encode(own, _low(owner, owners))) for owner, own in _lists(fps, owners)]
        return pd.DataFrame(out, columns=["part", "owner", "n", "k", "quotients", "remainders"])
    return send


def _answer(owners: int):
    def answer(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        """One owner: a bitmap for each part's list, where any entry occurs in another list."""
        sent = [golomb.decode(r.n, r.k, r.quotients, r.remainders, _low(int(key[0]), owners)) for r in lists.itertuples()]
        fps, counts = np.unique(np.concatenate(sent), return_counts=True)
        shared = fps[counts > 1]
        marks = [np.isin(own, shared, assume_unique=True) for own in sent]
        return pd.DataFrame([(part, key[0], np.packbits(m).tobytes()) for part, m in zip(lists["part"], marks) if m.any()],
                            columns=["part", "owner", "bitmap"])
    return answer


def _mark(owners: int):
    def mark(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
        """One part: its rows whose fingerprint is marked by an owner or repeated in the part."""
        fps, counts = np.unique(rows["fp"].to_numpy(), return_counts=True)
        suspect = counts > 1
        found = dict(zip(bitmaps["owner"], bitmaps["bitmap"]))
        at = 0
        for owner, own in _lists(fps, owners):
            if owner in found:
                suspect[at:at + len(own)] |= np.unpackbits(np.frombuffer(found[owner], dtype=np.uint8), count=len(own)) == 1
            at += len(own)
        return rows.loc[np.isin(rows["fp"].to_numpy(), fps[suspect]), ["rid", "doc_id", "sha"]]
    return mark


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, sha, h)``, one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty.  Of equal texts the row with the largest id is kept; of rows that
    repeat that id too, one is kept (the last one read).  A null id is
    smaller than any other.  An empty table gives an empty result.  Texts of
    any length are hashed whole.  Other columns are not read.
    """
    spark = ready(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(texts.withColumns({"rid": F.monotonically_increasing_id(), "h": text_hash("text")})
                  .mapInArrow(_hashes, "rid long, doc_id long, h long, fp long, sha string"), "dedup-rows")
    parts = rows.withColumn("part", F.shiftrightunsigned("rid", PART_BITS))
    owners = shuffle_width(spark)
    lists = (parts.select("part", "fp").groupBy("part")
             .applyInPandas(_send(owners), "part long, owner int, n int, k int, quotients binary, remainders binary"))
    bitmaps = lists.groupBy("owner").applyInPandas(_answer(owners), "part long, owner int, bitmap binary")
    suspects = staged(parts.groupBy("part").cogroup(bitmaps.groupBy("part"))
                      .applyInPandas(_mark(owners), "rid long, doc_id long, sha string"), "dedup-suspects")
    classes = staged(_classes(texts, suspects), "dedup-classes")
    classes, _ = broadcast_if_small(classes, BROADCAST_ROWS)
    return (rows.join(classes, "sha", "left")
            .select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
                    F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                    F.coalesce(F.col("rid") == F.col("top.rid"), F.lit(True)).alias("kept"), "sha", "h"))


def _classes(texts: DataFrame, suspects: DataFrame) -> DataFrame:
    """``(sha, n, top)`` of texts that occur more than once: verified on their bytes."""
    ids, _ = broadcast_if_small(suspects.select(F.col("doc_id").alias("suspect")).distinct(), BROADCAST_ROWS)
    again = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("suspect")), "left_semi")
    verified = (again.select(normalised("text").alias("norm")).groupBy("norm").agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") > 1).select(F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "n"))
    # struct(doc_id, rid) orders by id first; the row number settles repeated ids.
    tops = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "rid")).alias("top"))
    return verified.join(tops, "sha")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`duplicate_groups` keeps."""
    groups = duplicate_groups(docs, id_col, text_col)
    return keep_rows(docs, groups.select(F.col("doc_id").alias("id"), "h", "kept"), id_col, text_col)
