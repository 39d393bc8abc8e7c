"""Rows that operators must not stumble over: nulls, empty and long texts, ties, copies, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ("size", "h", "id", "row", "kept", "fp", "rank", "src", "target", "copies", "copy", "score", "part", "span",
            "__slice", "rid", "tie", "length", "piece", "start", "doc", "gid", "term", "chunk", "cells", "held", "word", "n", "key", "gram")


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def rows():
    long_text = words(30_000, 5)
    text = words(60, 1) + ". " + words(40, 2).capitalize() + ". " + words(30, 3).capitalize() + "."
    out = [
        (0, None, None, None, None), (1, "", "en", "b", 0), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4),
        (4, text, "en", "a", len(text)), (5, text, "en", "a", len(text)), (6, text.upper(), "fr", "b", 1),
        (7, text + " more", "en", "a", 1), (8, long_text, "en", "c", len(long_text)), (9, long_text, "en", None, None),
        (10, "one", "en", "a", 3), (11, "one two", "en", "a", 7), (12, "Ünïcødé ſ K 日本 \U0001f600", "de", "é", 1),
        (13, 'password = "short" user: bob http://x.io/a', "en", "a", 1), (14, "x" * 5000, "en", "a", 5000),
        # The same row twice, one id with two texts, and a null id.
        (15, "the same row twice here", "en", "a", 1), (15, "the same row twice here", "en", "a", 1),
        (16, "one id", "en", "a", 1), (16, "two texts of it", "en", "a", 1), (None, "no id", "en", "a", 1),
    ]
    return out + [(100 + k, words(k % 17 + 3, k), "en", f"s{k % 4}", 1) for k in range(40)]


def table(spark, clashing=False, empty=False):
    df = spark.createDataFrame([] if empty else rows(), SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}) if clashing else df


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def conversation_rows():
    """Missing ids, turns, roles and texts, ties, repeated turns, unknown roles, a long conversation and a long text."""
    out = [(None, None, None, None), (None, 1, "user", "Who?"), (1, None, "user", "No turn."), (1, None, "user", "No turn."), (1, 3, None, "x"),
           (1, 3, "assistant", None), (1, 9, "", ""), (2, 0, "system", "Only."), (3, 5, "user", "Same."), (3, 5, "user", "Same."),
           (3, 7, "user", "Same."), (4, 1, "tool", "a" * 50_000), (4, 2, "system", "Late system."), (4, 3, "assistant", "End"),
           (5, 0, "user", " \n"), (6, -4, "u", "Initials.\u2003"), (6, 2, "a", "count!")]
    r = random.Random(8)
    for conv in range(10, 60):
        out += [(conv, t, r.choice(["system", "user", "user", "assistant", "assistant", "x"]), r.choice(["Yes.", "No", "Why?", "", words(5, t)]))
                for t in range(r.randint(1, 9))]
    return out + [(7, t, "user" if t % 2 else "assistant", words(3, t) + ".") for t in range(400)]


def folder(spark, path, **how):
    """``documents``, ``labels`` and ``conversations`` as an sf folder."""
    turns = spark.createDataFrame([] if how.get("empty") else conversation_rows(), CONVERSATIONS)
    if how.get("clashing"):
        turns = turns.withColumns({c: F.lit(f"own {c}") for c in ("conv", "kind", "key", "copies", "payload", "first", "blank", "truncated", "initial")})
    turns.write.parquet(f"{path}/conversations.parquet")
    table(spark, **how).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, k % 3 == 0) for k in range(200) if k != 12] + [(3, None, None), (4, 1, True)]
    spark.createDataFrame([] if how.get("empty") else [(a, b, None if c is None else int(c)) for a, b, c in labels],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path
