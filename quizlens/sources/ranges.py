"""Large CSV files and JSON arrays read by many tasks.

A file is cut into byte ranges at any place.  Whether a range starts inside a
quoted cell, or inside a string and how deep, follows from what lies before
it; so a first pass reports what each range changes, a running sum over the
ranges (one row each) gives the state at each start, and a second pass cuts
every range into records.  A record belongs to the range that holds its start
and is read on to its end from there.  Spark parses the records with
``from_csv`` and ``from_json``.  A task holds one record and ``CHUNK_BYTES``
at a time, whatever the size of a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens.session import ship_package
from quizlens.sources.files import CSV_OPTIONS, arrow_fs

RANGE_BYTES = 64 * 1024 * 1024
CHUNK_BYTES = 4 * 1024 * 1024
#: Records (by number and by bytes) that a task hands to Spark at once.
BATCH_RECORDS = 4096
BATCH_BYTES = 16 * 1024 * 1024

_QUOTE, _BACKSLASH, _NEWLINE, _COMMA = b'"'[0], b"\\"[0], b"\n"[0], b","[0]
_BOM = b"\xef\xbb\xbf"


def byte_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, start, stop)`` of every range of the files under ``path``; empty files have none.

    Spark lists the files and their lengths; no content is read.
    """
    found = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    return (found.select("path", "length", F.explode(starts).alias("start"))
            .select("path", "start", F.least(F.col("start") + F.lit(range_bytes), "length").alias("stop")))


def _chunks(path: str, start: int, chunk_bytes: int, stop: int | None = None) -> Iterator[bytes]:
    """The bytes from ``start`` to ``stop`` (or the end of the file), some at a time."""
    filesystem, name = arrow_fs(path)
    with filesystem.open_input_file(name) as file:
        file.seek(start)
        while stop is None or start < stop:
            data = file.read(chunk_bytes if stop is None else min(chunk_bytes, stop - start))
            if not data:
                return
            start += len(data)
            yield data


def _escapes_before(path: str, start: int) -> int:
    """Number of backslashes right before ``start``."""
    filesystem, name = arrow_fs(path)
    count, step = 0, 256
    with filesystem.open_input_file(name) as file:
        while start > 0:
            low = max(0, start - step)
            file.seek(low)
            data = file.read(start - low)
            run = len(data) - len(data.rstrip(b"\\"))
            count += run
            if run < len(data):
                break
            start, step = low, 2 * step
    return count


def _quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Where quotes without a backslash of their own stand, and whether the byte after ``data`` is escaped."""
    slash = data == _BACKSLASH
    quotes = data == _QUOTE
    if not escaped and not slash.any():
        return quotes, False
    at = np.arange(len(data))
    other = np.maximum.accumulate(np.where(slash, -1, at))       # the last byte up to here that is no backslash
    run = at - other                                             # backslashes that end here
    run[other < 0] += int(escaped)
    before = np.concatenate(([int(escaped)], run[:-1]))
    return quotes & (before % 2 == 0), bool(run[-1] % 2)


def _brackets(data: np.ndarray) -> np.ndarray:
    """+1 at an opening, -1 at a closing bracket or brace."""
    opened, closed = (data == b"["[0]) | (data == b"{"[0]), (data == b"]"[0]) | (data == b"}"[0])
    return opened.astype(np.int64) - closed


def _changes(kind: str, chunk_bytes: int):
    """First pass: quotes of a range, and the change of depth if it starts outside and if it starts inside a string."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, start, stop in zip(pdf["path"], pdf["start"], pdf["stop"]):
                quotes = outside = inside = 0
                escaped = kind == "json" and _escapes_before(path, start) % 2 == 1
                for chunk in _chunks(path, start, chunk_bytes, stop):
                    data = np.frombuffer(chunk, np.uint8)
                    if kind == "csv":
                        quotes += int((data == _QUOTE).sum())
                        continue
                    marks, escaped = _quotes(data, escaped)
                    odd = (quotes + np.cumsum(marks)) % 2 == 1
                    step = _brackets(data)
                    inside += int(step[odd].sum())
                    outside += int(step[~odd].sum())
                    quotes += int(marks.sum())
                out.append((path, start, stop, quotes % 2, outside, inside))
            yield pd.DataFrame(out, columns=["path", "start", "stop", "quotes", "outside", "inside"])
    return run


def _states(ranges: DataFrame, kind: str, chunk_bytes: int) -> DataFrame:
    """``(path, start, stop, quoted, depth)``: the ranges with the state in which each starts."""
    seen = ranges.mapInPandas(_changes(kind, chunk_bytes),
                              "path string, start long, stop long, quotes long, outside long, inside long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quoted = seen.withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    change = quoted.withColumn("change", F.when(F.col("quoted") == 1, F.col("inside")).otherwise(F.col("outside")))
    return change.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0))).select("path", "start", "stop", "quoted", "depth")


def _csv_cuts(path: str, start: int, quoted: int, chunk_bytes: int):
    """``(chunk, place of its first byte, places of line ends outside quotes)`` from the byte before ``start`` on."""
    at = max(0, start - 1)          # a line end there does not change the state
    for chunk in _chunks(path, at, chunk_bytes):
        data = np.frombuffer(chunk, np.uint8)
        odd = (quoted + np.cumsum(data == _QUOTE)) % 2
        skip = at == start - 1 and chunk[:1] == b'"'            # that quote is counted in `quoted` already
        if skip:
            odd = (odd + 1) % 2
        yield chunk, at, np.flatnonzero((data == _NEWLINE) & (odd == 0))
        quoted = int(odd[-1])
        at += len(chunk)


def _json_cuts(path: str, start: int, quoted: int, depth: int, chunk_bytes: int):
    """As :func:`_csv_cuts`: the brackets of the outer array and the commas between its elements, from ``start`` on."""
    at, escaped = start, _escapes_before(path, start) % 2 == 1
    for chunk in _chunks(path, at, chunk_bytes):
        data = np.frombuffer(chunk, np.uint8)
        marks, escaped = _quotes(data, escaped)
        odd = (quoted + np.cumsum(marks)) % 2
        step = np.where(odd == 0, _brackets(data), 0)
        level = depth + np.cumsum(step)
        cut = ((step == 1) & (level == 1)) | ((step == -1) & (level == 0)) | ((data == _COMMA) & (odd == 0) & (level == 1))
        yield chunk, at, np.flatnonzero(cut)
        quoted, depth = int(odd[-1]), int(level[-1])
        at += len(chunk)


def _pieces(cuts, start: int, stop: int, opens: int | None):
    """``(place of its left cut, bytes)`` of each piece whose left cut is in ``[start, stop)``.

    ``opens``: the place of a cut that is not in the file, before its first byte.
    """
    left, held = opens, []
    for chunk, at, places in cuts:
        done = 0
        for place in places.tolist():
            if left is not None:
                held.append(chunk[done:place])
                yield left, b"".join(held)
            left, held, done = at + place, [], place + 1
            if left >= stop:
                return
        if left is not None:
            held.append(chunk[done:])
        elif at + len(chunk) >= stop:
            return                                              # no record starts in this range
    if left is not None:
        yield left, b"".join(held)


def _first_byte(path: str) -> bytes:
    """The first byte that is not white space."""
    for k, chunk in enumerate(_chunks(path, 0, 4096)):
        text = (chunk.removeprefix(_BOM) if k == 0 else chunk).lstrip()
        if text:
            return text[:1]
    return b""


def _csv_records(path, start, stop, quoted, depth, chunk_bytes):
    """A line end at place p starts a record at p + 1, so the ends in ``[start - 1, stop - 1)`` are this range's."""
    for left, data in _pieces(_csv_cuts(path, start, quoted, chunk_bytes), start - 1, stop - 1, -1 if start == 0 else None):
        data = data.removesuffix(b"\r")
        if left >= 0 and data:                                  # the record of the file's start is its header
            yield left + 1, data


def _json_records(path, start, stop, quoted, depth, chunk_bytes):
    if _first_byte(path) != b"[":                 # one object, or no JSON array: one record
        if start == 0:
            data = b"".join(_chunks(path, 0, chunk_bytes)).removeprefix(_BOM).strip()
            if data:
                yield 0, data
        return
    for left, data in _pieces(_json_cuts(path, start, quoted, depth, chunk_bytes), start, stop, None):
        data = data.strip()
        if data:                                                # blank: an empty array, or what follows its end
            yield left, data


def _records(kind: str, chunk_bytes: int):
    """Second pass: the records of each range."""
    cut = {"csv": _csv_records, "json": _json_records}[kind]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, start, stop, quoted, depth in zip(pdf["path"], pdf["start"], pdf["stop"], pdf["quoted"], pdf["depth"]):
                out, size = [], 0
                for place, data in cut(path, start, stop, int(quoted), int(depth), chunk_bytes):
                    out.append((path, place, data.decode("utf-8", "replace")))
                    size += len(data)
                    if len(out) >= BATCH_RECORDS or size >= BATCH_BYTES:
                        yield pd.DataFrame(out, columns=["path", "place", "record"])
                        out, size = [], 0
                yield pd.DataFrame(out, columns=["path", "place", "record"])
    return run


def records(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE_BYTES,
            chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(path, place, record)``: the text of every record of the CSV or JSON files under ``path``.

    ``place`` orders the records of a file.  CSV records are the lines after
    the header, quoted line ends included; JSON records are the elements of
    the outer array, or the one document that is no array.
    """
    ship_package(spark)
    ranges = byte_ranges(spark, path, range_bytes)
    chunk_bytes = min(chunk_bytes, range_bytes)
    # A task a range, or several small ranges a task: as many tasks as the cores and the session's shuffles have.
    seen = ranges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("size")).first()
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, (seen["size"] or 0) // RANGE_BYTES)
    tasks = max(1, min(seen["n"], width))
    states = _states(ranges.repartition(tasks), kind, chunk_bytes)
    return states.repartition(tasks).mapInPandas(_records(kind, chunk_bytes), "path string, place long, record string")


def read_csv_ranges(spark: SparkSession, path: str, schema: str | T.StructType, range_bytes: int = RANGE_BYTES,
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """S2 for large files: the rows of :func:`files.read_csv_table`, a file read by as many tasks as it has ranges.

    Quotes must be used as RFC 4180 says, only around cells and doubled
    within them (:func:`files.write_csv_table` does); records end with
    ``\\n`` or ``\\r\\n``.  Empty lines are no rows.
    """
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    return records(spark, path, "csv", range_bytes, chunk_bytes).select(F.from_csv("record", ddl, options).alias("row")).select("row.*")


def read_json_ranges(spark: SparkSession, path: str, schema: str | T.StructType, range_bytes: int = RANGE_BYTES,
                     chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """S3 for large files: the elements of each document's array, read by as many tasks as the file has ranges.

    An element that is no object, or breaks off, is a row of NULLs; the rows
    beside it are read.  A document that is one object is one row, read by
    one task.
    """
    return records(spark, path, "json", range_bytes, chunk_bytes).select(F.from_json("record", schema).alias("row")).select("row.*")
