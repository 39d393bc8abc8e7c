"""S1-S6 round trips on invented files."""

import os

from quizlens.sources import files


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_sheet_tree_layout(spark, scratch):
    root = _local(scratch)
    layout = {
        "IC-001/A-1.txt": "{{knowledge objective\n|Title=x\n}}\nbody é",
        "IC-001/A-2.txt": "second",
        "IC-001/notes.md": "not a sheet",
        "IC-002/B.v2.txt": "dotted name",
        "IC 3/x+y%20z #1.txt": "odd characters",
        "IC-002/deeper/C.txt": "too deep",
        "top.txt": "not in a folder",
    }
    for rel, text in layout.items():
        full = os.path.join(root, rel)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as fh:
            fh.write(text)
    got = sorted(tuple(r) for r in files.read_sheet_tree(spark, scratch).collect())
    assert got == [("IC 3", "x+y%20z #1", "odd characters"),
                   ("IC-001", "A-1", layout["IC-001/A-1.txt"]), ("IC-001", "A-2", "second"),
                   ("IC-002", "B.v2", "dotted name")]


def test_csv_round_trip(spark, scratch):
    rows = [("1", 'say "hi"\nnext line', "a,b", None), ("2", "", "x", "y")]
    df = spark.createDataFrame(rows, "id string, question string, option_a string, option_b string")
    files.write_csv_table(df, scratch)
    back = files.read_csv_table(spark, scratch, df.schema)
    got = sorted(tuple(r) for r in back.collect())
    # empty strings read back as NULL, as with any CSV reader that maps empty fields to missing
    assert got == [("1", 'say "hi"\nnext line', "a,b", None), ("2", None, "x", "y")]


def test_json_records_round_trip(spark, scratch):
    df = spark.createDataFrame([("E-1", "Q?", "A", "x", "y", "z", "w"), ("E-2", "multi\nline", "B", "", "y", None, "w")],
                               files.EXAM_SCHEMA)
    assert files.write_json_records(df.repartition(2), scratch) == 2
    back = files.read_json_records(spark, scratch, files.EXAM_SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_split_list_and_prompts(spark, scratch):
    files.write_text_file(spark, scratch + "/split.json", '["IC-001", "IC-004"]')
    assert sorted(r[0] for r in files.read_split_list(spark, scratch + "/split.json").collect()) == ["IC-001", "IC-004"]
    prompts = {"distractors_quality_prompt": "Rate.\nOne digit.", "difficulty_prompt": "é"}
    files.write_text_file(spark, scratch + "/prompts.json", files.prompts_json(prompts))
    assert files.read_prompts(spark, scratch + "/prompts.json") == prompts


def test_bad_split_list_and_prompts_raise(spark, scratch):
    """A cut-off or wrong document is an error, not an empty list."""
    import pytest

    for k, text in enumerate(('["IC-001", "IC-0', "", '{"a": 1}', "no json")):
        files.write_text_file(spark, f"{scratch}/list{k}.json", text)
        with pytest.raises(Exception):
            files.read_split_list(spark, f"{scratch}/list{k}.json").collect()
    for k, text in enumerate(('{"a": "b', "", "[1, 2]", "no json")):
        files.write_text_file(spark, f"{scratch}/prompts{k}.json", text)
        with pytest.raises(Exception):
            files.read_prompts(spark, f"{scratch}/prompts{k}.json")


def test_sheet_tree_reads_every_file(spark, scratch):
    """Names that Spark's listing passes over, line ends, and files at other depths."""
    filesystem, base = files.arrow_fs(scratch)
    tree = {"F1/a.txt": "one\r\ntwo\rthree\n", "F1/_b.txt": "hidden\r\n", "F1/.c.txt": "dot", "_F2/d.txt": "folder",
            "F1/deep/e.txt": "too deep", "f.txt": "too high", "F1/g.md": "other kind", "F 3/h+i é.txt": "name", "F 3/_j%20 k.txt": "both"}
    for name, text in tree.items():
        filesystem.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
        with filesystem.open_output_stream(f"{base}/{name}") as out:
            out.write(text.encode())
    got = {(r["folder"], r["id"]): r["content_raw"] for r in files.read_sheet_tree(spark, scratch).collect()}
    assert got == {("F1", "a"): "one\ntwo\nthree\n", ("F1", "_b"): "hidden\n", ("F1", ".c"): "dot", ("_F2", "d"): "folder",
                   ("F 3", "h+i é"): "name", ("F 3", "_j%20 k"): "both"}


def test_json_records_stream(spark, scratch):
    df = spark.range(25).selectExpr("cast(id as string) id", "repeat('x\"', 3) question", "'A' cop", "'a' opa", "'b' opb", "'c' opc", "cast(null as string) opd")
    assert files.write_json_records(df.repartition(3), scratch) == 25
    back = files.read_json_records(spark, scratch, files.EXAM_SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_json_writer_holds_few_long_records(spark, scratch):
    """The memory of a writing task follows a batch of some MB, not a fixed number of rows."""
    import threading

    import psutil

    def held():
        total = 0
        for p in psutil.Process().children(recursive=True):
            try:
                total += p.memory_info().rss if "python" in p.name() else 0
            except psutil.Error:
                pass
        return total

    rows = 400
    df = spark.range(0, rows, 1, 1).selectExpr("cast(id as string) id", "repeat('x', 1000000) question")
    before, peak, done = held(), [0], threading.Event()

    def watch():
        while not done.wait(0.02):
            peak[0] = max(peak[0], held())

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        assert files.write_json_records(df, scratch) == rows
    finally:
        done.set()
        watcher.join()
    assert peak[0] - before < 300e6     # all the rows are 400 MB, in Arrow and in pandas once more
    back = files.read_json_records(spark, scratch, "id string, question string")
    assert back.selectExpr("count(*)", "sum(length(question))").first() == (rows, rows * 1000000)


def test_a_cluster_needs_a_shared_folder():
    from quizlens.session import is_one_machine

    assert is_one_machine("local") and is_one_machine("local[4]") and is_one_machine("local[*]")
    assert not is_one_machine("local-cluster[3,2,1024]") and not is_one_machine("yarn") and not is_one_machine("spark://h:7077")
