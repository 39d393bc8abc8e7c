"""Files cut into ranges at any byte give the rows that whole files give."""

import csv
import io
import json
import os
import random

import pytest

from quizlens.sources import files, ranges
from conftest import SF_SMALL
from quizlens.plans import fixtures as fx

CELLS = ["", "a", "b c", 'say "x"', "two\nlines", "\n", '"', '""', "é€😀", ",", "tab\t", "x\r\ny", " space ", "\\", '\\"', "a" * 40]


def in_ranges(path, kind, size, chunk):
    """The records by plain calls, range after range, with the states that a running sum gives."""
    import pandas as pd

    length = os.path.getsize(path)
    cuts = [(path, s, min(s + size, length)) for s in range(0, length, size)]
    seen = pd.concat(ranges._changes(kind, chunk)([pd.DataFrame(cuts, columns=["path", "start", "stop"])])) if cuts else None
    out, quoted, depth = [], 0, 0
    read = {"csv": ranges._csv_records, "json": ranges._json_records}[kind]
    for r in seen.itertuples() if cuts else []:
        out += read(path, r.start, r.stop, quoted, depth, chunk)
        depth += r.inside if quoted else r.outside
        quoted = (quoted + r.quotes) % 2
    places = [p for p, _ in out]
    assert places == sorted(set(places))
    return [d.decode() for _, d in out]


@pytest.mark.parametrize("seed", range(6))
def test_csv_records_are_the_same_for_all_cuts(tmp_path, seed):
    rng = random.Random(seed)
    rows = [[rng.choice(CELLS) for _ in range(3)] + ["end"] for _ in range(rng.randrange(0, 25))]
    for ending in ("\n", "\r\n"):
        text = io.StringIO()
        csv.writer(text, lineterminator=ending).writerows([["h1", 'h"2', "h\n3", "h4"], *rows])
        path = str(tmp_path / "t.csv")
        for last in (text.getvalue(), text.getvalue()[:-len(ending)]):
            with open(path, "wb") as f:
                f.write(last.encode())
            for size, chunk in ((1, 1), (3, 2), (7, 100), (64, 5), (10**6, 11)):
                got = in_ranges(path, "csv", size, chunk)
                assert [next(csv.reader(io.StringIO(r, newline=""))) for r in got] == rows


@pytest.mark.parametrize("seed", range(6))
def test_json_elements_are_the_same_for_all_cuts(tmp_path, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice([*CELLS, "{", "}]", "[,", "\\\\", '\\\\"', "]"])
    items = [rng.choice([{"id": word(), word(): [word(), {"x": [1, {}]}], "o": {}}, 7, None, word(), [[], [word()]], {}])
             for _ in range(rng.randrange(0, 20))]
    path = str(tmp_path / "t.json")
    for indent in (None, 1):
        with open(path, "w", encoding="utf-8") as f:
            f.write(" \n" + json.dumps(items, indent=indent, ensure_ascii=bool(seed % 2)) + "\n")
        for size, chunk in ((1, 1), (3, 2), (7, 100), (64, 5), (10**6, 11)):
            assert [json.loads(r) for r in in_ranges(path, "json", size, chunk)] == items


def test_json_documents_that_are_no_array_or_break_off(tmp_path):
    path = str(tmp_path / "t.json")
    for text, records in (('\n{"a": [1, 2]}\n', ['{"a": [1, 2]}']), ("[]", []), (" ", []), ('[{"a": 1}, {"a": "x', ['{"a": 1}', '{"a": "x']),
                          ('[{"a": 1}]\n[{"a": 2}]', ['{"a": 1}', '{"a": 2}'])):
        with open(path, "w") as f:
            f.write(text)
        for size in (1, 4, 100):
            assert in_ranges(path, "json", size, 3) == records


def test_one_file_is_read_by_many_tasks(spark, scratch):
    df = fx.load(spark, SF_SMALL, "mcqs").drop("mcq_id")
    files.write_csv_table(df.coalesce(1), scratch)
    whole = files.read_csv_table(spark, scratch, files.MCQS_SCHEMA)
    cut = ranges.read_csv_ranges(spark, scratch, files.MCQS_SCHEMA, 20_000, 3_000)
    assert cut.count() == whole.count() > 0 and cut.exceptAll(whole).isEmpty() and whole.exceptAll(cut).isEmpty()
    assert cut.rdd.getNumPartitions() >= 8
    order = [r["record"].split(",")[0] for r in ranges.records(spark, scratch, "csv", 20_000, 3_000).orderBy("path", "place").collect()]
    assert order == [r["id"] for r in whole.collect()]


def test_json_array_is_read_by_many_tasks(spark, scratch):
    df = fx.load(spark, SF_SMALL, "exam_items")
    files.write_json_records(df.coalesce(1), scratch)
    whole = files.read_json_records(spark, scratch, files.EXAM_SCHEMA)
    cut = ranges.read_json_ranges(spark, scratch, files.EXAM_SCHEMA, 20_000, 3_000)
    assert cut.count() == whole.count() > 0 and cut.exceptAll(whole).isEmpty() and whole.exceptAll(cut).isEmpty()
    assert cut.rdd.getNumPartitions() >= 8


def test_bad_elements_are_rows_of_nulls_and_empty_folders_have_none(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.json").write_text('[{"id": "1"}, 5, {"id": "2"')
    (tmp_path / "a" / "e.json").write_text("")
    rows = ranges.read_json_ranges(spark, str(tmp_path / "a"), "id string", 4).collect()
    assert sorted((r["id"] or "") for r in rows) == ["", "", "1"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "e.csv").write_text("")
    assert ranges.read_csv_ranges(spark, str(tmp_path / "b"), "id string").count() == 0
    (tmp_path / "b" / "h.csv").write_text("id,x\n")
    (tmp_path / "b" / "r.csv").write_text('﻿id,x\n"",\n\n1,"2""\n"\n3')
    rows = ranges.read_csv_ranges(spark, str(tmp_path / "b"), "id string, x string", 3).collect()
    want = files.read_csv_table(spark, str(tmp_path / "b"), "id string, x string").collect()
    assert sorted(map(str, rows)) == sorted(map(str, want))
