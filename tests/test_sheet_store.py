"""The stored sheet tree: what a refresh reads, what it leaves alone, and stopped refreshes."""

import os

import pytest
from pyspark.sql import functions as F

from quizlens.plans import jobs
from quizlens.sources import files, sheet_store


def _write(root, tree):
    for name, text in tree.items():
        full = os.path.join(root.removeprefix("file:"), name)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as out:
            out.write(text.encode())


def _rows(df):
    return sorted((r["folder"], r["id"], r["content_raw"]) for r in df.collect())


TREE = {"F1/a.txt": "one\r\ntwo\rthree\n", "F1/_b.txt": "hidden", "F1/.c.txt": "dot", "_F2/d.txt": "folder", "F1/deep/e.txt": "too deep",
        "f.txt": "too high", "F1/g.md": "other kind", "F 3/h+i é%20.txt": "name", "007/j.v2.txt": "", "F1/.txt": "no name", "F1/..txt": "dots", "F1/.k.txt.txt": "two"}


def test_first_refresh_reads_the_tree(spark, scratch):
    root, store = scratch + "/tree", scratch + "/store"
    _write(root, TREE)
    assert sheet_store.refresh_sheets(spark, root, store) == sheet_store.Refresh(9, 9, 0)
    assert _rows(sheet_store.read_sheet_store(spark, store)) == _rows(files.read_sheet_tree(spark, root))
    want = {(f, os.path.splitext(n)[0]) for f, _, n in (k.rpartition("/") for k in TREE if k.count("/") == 1) if n.endswith(".txt")}
    got = _rows(sheet_store.read_sheet_store(spark, store))
    assert {(f, i) for f, i, _ in got} == want and ("007", "j.v2", "") in got


def test_only_new_and_changed_files_are_read(spark, scratch):
    root, store = scratch + "/tree", scratch + "/store"
    _write(root, TREE)
    sheet_store.refresh_sheets(spark, root, store)
    # A change that leaves length and time alone shows whether a file was opened again.
    untouched = os.path.join(root.removeprefix("file:"), "_F2/d.txt")
    times = os.stat(untouched)
    _write(root, {"_F2/d.txt": "FOLDER"})
    os.utime(untouched, ns=(times.st_atime_ns, times.st_mtime_ns))
    assert sheet_store.refresh_sheets(spark, root, store) == sheet_store.Refresh(9, 0, 0)
    assert sheet_store.generations(spark, store) == [1]
    _write(root, {"F1/a.txt": "another text", "F9/new.txt": "new"})
    os.remove(os.path.join(root.removeprefix("file:"), "F1/_b.txt"))
    assert sheet_store.refresh_sheets(spark, root, store) == sheet_store.Refresh(9, 2, 1)
    got = {(f, i): t for f, i, t in _rows(sheet_store.read_sheet_store(spark, store))}
    assert got[("F1", "a")] == "another text" and got[("F9", "new")] == "new" and got[("_F2", "d")] == "folder"
    assert ("F1", "_b") not in got and len(got) == 9
    # A file that comes back is new; the whole of it is as a first refresh would read it.
    _write(root, {"F1/_b.txt": "hidden"})
    os.utime(untouched)
    assert sheet_store.refresh_sheets(spark, root, store) == sheet_store.Refresh(10, 2, 0)
    assert _rows(sheet_store.read_sheet_store(spark, store)) == _rows(files.read_sheet_tree(spark, root))


def test_a_stopped_refresh_is_replaced(spark, scratch, monkeypatch):
    root, store = scratch + "/tree", scratch + "/store"
    _write(root, TREE)
    sheet_store.refresh_sheets(spark, root, store)
    _write(root, {"F1/a.txt": "second"})
    # Texts of a generation without a log: the run ended between the two.
    half = spark.createDataFrame([("F1", "a.txt", 1, 1, "half"), ("X", "y.txt", 1, 1, "half")], files.TEXTS)
    half.write.partitionBy("folder").parquet(f"{store}/sheets/generation=2")
    assert ("X", "y", "half") not in _rows(sheet_store.read_sheet_store(spark, store))
    assert sheet_store.refresh_sheets(spark, root, store).read == 1
    assert _rows(sheet_store.read_sheet_store(spark, store)) == _rows(files.read_sheet_tree(spark, root))
    # Beyond the broadcast bound the replaced rows are left out by a shuffle join.
    monkeypatch.setattr(sheet_store, "broadcast_if_small", lambda df: (df, False))
    assert _rows(sheet_store.read_sheet_store(spark, store)) == _rows(files.read_sheet_tree(spark, root))


def test_files_removed_to_the_last_and_a_missing_tree(spark, scratch):
    root, store = scratch + "/tree", scratch + "/store"
    _write(root, {"A/x.txt": "x"})
    sheet_store.refresh_sheets(spark, root, store)
    os.remove(os.path.join(root.removeprefix("file:"), "A/x.txt"))
    assert sheet_store.refresh_sheets(spark, root, store) == sheet_store.Refresh(0, 0, 1)
    assert _rows(sheet_store.read_sheet_store(spark, store)) == []
    with pytest.raises(Exception):
        sheet_store.refresh_sheets(spark, scratch + "/nowhere", store)
    assert _rows(sheet_store.read_sheet_store(spark, scratch + "/no-store")) == []


def test_folders_prune_and_large_ones_are_dealt(spark, scratch, monkeypatch):
    root, store = scratch + "/tree", scratch + "/store"
    _write(root, {f"A/{k}.txt": "text" for k in range(40)} | {"B/x.txt": "b", "C/y.txt": "c"})
    monkeypatch.setattr(sheet_store, "TASK_FILES", 5)
    sheet_store.refresh_sheets(spark, root, store)
    assert len([n for n in os.listdir(store.removeprefix("file:") + "/sheets/generation=1/folder=A") if n.endswith(".parquet")]) > 2
    few = sheet_store.read_sheet_store(spark, store).where(F.col("folder").isin("B", "C"))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and _rows(few) == [("B", "x", "b"), ("C", "y", "c")]


def test_ingest_from_a_store(spark, scratch):
    root, store = scratch + "/tree", scratch + "/store"
    _write(root, {"A/x.txt": "{{knowledge objective\n|Rubric=Definition}}\nbody", "A/y.txt": "plain"})
    plain, stored = (jobs.ingest_sheets(spark, root, store=s) for s in (None, store))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, stored.collect()))
    assert sheet_store.generations(spark, store) == [1]
