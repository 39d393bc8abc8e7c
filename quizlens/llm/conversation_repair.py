"""Repair of conversations: faults of their turns, and the cheapest edits that give legal roles.

The parser is :mod:`quizlens.llm.role_grammar`.  Turns are sorted by ranges of
(conversation, turn), so a conversation that holds a third of all rows lies in
many tasks.  Each task parses its segment of a conversation, a segment that
may continue one from every stack that can stand before it; the segments of a
conversation are then joined.  A second sorted stream writes the repaired
turns into the hash, one at a time.  What a task holds of a conversation is
its audit, a few characters a turn, and never its texts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlens.llm import role_grammar
from quizlens.llm.common import WORD_SEPARATORS, ready, shuffle_width, staged

#: Adjacent role initials that are in order.
LEGAL = {"su", "ua", "au"}
NULL_TEXT = " "
ORDER = ["turn", "role", "key"]

_SEGMENT = "conv long, turn long, role string, key binary, payload string"
RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def _filled(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(NULL_TEXT))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Turns with seeded damage: by crc32 of ``conversation:turn`` modulo 20, 0 drops a turn, 1 empties it, 2 removes
    its ``.!?``, 3 repeats it, 4 makes it the user's.  Nulls count as one space there, and become one in role and text."""
    how = F.crc32(F.concat(_filled(conv_col), F.lit(":"), _filled(turn_col)).cast("binary")) % 20
    text = _filled(text_col)
    times = F.when(how == 0, 0).when(how == 3, 2).otherwise(1)
    return turns.where(how != 0).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.when(how == 4, "user").otherwise(_filled(role_col)).alias("role"),
        F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("__copy")).drop("__copy")


def _facts(seen: dict, row: tuple) -> None:
    """Counts of a segment, from its rows in order."""
    turn, initial, blank, truncated, first, copies = row
    good = 0 if blank or not first else 1
    seen["blank"] += copies if blank else 0
    seen["duplicate"] += 0 if blank else copies - good
    seen["truncated"] += 1 if good and truncated else 0
    seen["illegal"] += copies - 1 + (seen["last"] is not None and seen["last"] + initial not in LEGAL)
    seen["head"], seen["last"] = initial if seen["last"] is None else seen["head"], initial
    if turn is not None:
        seen["turns"] += turn != seen["high"]
        seen["low"], seen["high"] = turn if seen["low"] is None else seen["low"], turn


def _followed(a: dict, b: dict) -> dict:
    """Counts of two segments, one after the other."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last"] + b["head"] not in LEGAL)
    out["turns"] = a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"])
    out["low"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = a["high"] if b["high"] is None else b["high"]
    return out | {"head": a["head"], "last": b["last"]}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted partition: its first key, its counts, and its ways by entry."""
    schema = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("key", pa.binary()), ("payload", pa.string())])
    at, runs, seen, begun, out = None, [], {}, (), []

    def closed() -> tuple:
        ways = [{k: list(w) for k, w in run.ways().items()} for run in runs]
        return (at, *begun, json.dumps([seen, ways]))

    first_of_partition = True
    for batch in batches:
        for conv, turn, role, key, initial, blank, truncated, first, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if not runs or conv != at:
                if runs:
                    out.append(closed())
                # Only a partition's first conversation may have begun in the one before.
                runs = [role_grammar.Run(k) for k in (range(len(role_grammar.TOPS)) if first_of_partition else [0])]
                first_of_partition = False
                at, begun = conv, (turn, role, key)
                seen = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | dict.fromkeys(("head", "last", "low", "high"))
            _facts(seen, (turn, initial, blank, truncated, first, copies))
            good = 0 if blank or not first else 1
            for run in runs:
                if good:
                    run.read(initial, False, truncated)
                if copies > good:
                    run.read(initial, True, False, copies - good)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if runs:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(closed(), schema)], schema=schema)


class _Conversation:
    """Joins the segments of a conversation, then writes its repaired turns into a hash."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.facts: dict | None = None
        self.ways = {0: role_grammar.Way(0, "", "")}
        self.way: role_grammar.Way | None = None
        self.place = 0
        self.lines = 0
        self.hash = hashlib.sha256()

    def segment(self, payload: str) -> None:
        seen, ways = json.loads(payload)
        ways = [{int(k): role_grammar.Way(*w) for k, w in x.items()} for x in ways]
        self.facts = _followed(self.facts, seen) if self.facts else seen
        self.ways = role_grammar.joined(self.ways, ways)

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def _inserts(self) -> None:
        while self.way.audit[self.place:self.place + 1] == role_grammar.INSERT:
            self._line(role_grammar.ROLE_NAMES[self.way.roles[self.place]], "")
            self.place += 1

    def turn(self, role: str, text: str, copies: int) -> None:
        if self.way is None:
            self.way = role_grammar.accepted(self.ways)
        for _ in range(copies):
            self._inserts()
            edit, new_role = self.way.audit[self.place], self.way.roles[self.place]
            if edit != role_grammar.DELETE:
                self._line(role if edit == role_grammar.KEEP else role_grammar.ROLE_NAMES[new_role], text)
            self.place += 1

    def row(self) -> tuple:
        if self.way is None:
            return (self.conv, 0, 0, 0, 0, 0, 0, "", self.hash.hexdigest())
        self._inserts()
        f = self.facts
        gaps = 0 if f["low"] is None else f["high"] - f["low"] + 1 - f["turns"]
        return (self.conv, gaps, f["blank"], f["duplicate"], f["truncated"], f["illegal"], self.way.cost, self.way.audit, self.hash.hexdigest())


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's marker (kind 0), segments (1) and turns (2), in order, make its row."""
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now, out = None, []
    for batch in batches:
        for conv, kind, role, payload, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != now.conv:
                if now:
                    out.append(now.row())
                now = _Conversation(conv)
            if kind == 1:
                now.segment(payload)
            elif kind == 2:
                now.turn(role, payload, copies)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.row(), schema)], schema=schema)


def repaired(turns: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Counts of faults, the cheapest repair and the hash of what it gives, one row a conversation.

    Turns are taken by ``turn``, nulls first, ties by role and then by the
    SHA-256 of the text.  Null roles and texts count as one space, a null
    conversation is one like any other.  Equal turns are one row with a
    number.  ``conversations`` adds ids that may have no turns: zeros, an empty
    audit and the hash of an empty string.  Empty tables give empty results;
    other columns are not read.
    """
    spark = ready(turns)
    key = F.unhex(F.sha2("text", 256))
    trimmed = F.rtrim("text", F.lit(WORD_SEPARATORS))
    rows = staged(turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                               _filled(role_col).alias("role"), _filled(text_col).alias("text"))
                  .groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
                  .withColumns({"key": key, "blank": trimmed == "", "truncated": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")}), "turns")
    narrow = rows.drop("text")
    said = narrow.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("earliest"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    initial = F.substring("role", 1, 1)
    marked = narrow.join(said, same).select(
        "conv", *ORDER, F.when(initial.isin("s", "u", "a"), initial).otherwise("").alias("initial"), "blank", "truncated",
        F.col("turn").eqNullSafe(F.col("earliest.turn")).alias("first"), "copies")
    width = shuffle_width(spark)
    segments = (marked.repartitionByRange(width, "conv", *ORDER).sortWithinPartitions("conv", *ORDER)
                .mapInArrow(_segments, _SEGMENT))
    nothing = F.lit(None)
    ids = (conversations.select(F.col(conv_col).cast("long").alias("conv")) if conversations is not None else rows.select("conv")).distinct()
    parts = (ids.select("conv", F.lit(0).alias("kind"), nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"),
                        nothing.cast("binary").alias("key"), nothing.cast("string").alias("payload"), nothing.cast("long").alias("copies"))
             .unionByName(segments.select("conv", F.lit(1).alias("kind"), *ORDER, "payload", F.lit(1).cast("long").alias("copies")))
             .unionByName(rows.select("conv", F.lit(2).alias("kind"), *ORDER, F.col("text").alias("payload"), "copies")))
    return (parts.repartition(width, "conv").sortWithinPartitions("conv", "kind", *ORDER)
            .select("conv", "kind", "role", "payload", "copies").mapInArrow(_results, RESULT))
