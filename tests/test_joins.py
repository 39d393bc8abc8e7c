"""J1-J4 and the key coverage report on the FIXTURES.md left-join edge rows."""

from quizlens.operators import joins


def _tables(spark):
    mcqs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "zz")], "mcq_id int, id string")
    sheets = spark.createDataFrame([("a", "text a"), ("b", "text b1"), ("b", "text b2"), ("c", "text c")],
                                   "id string, content_gpt string")
    return mcqs, sheets


def test_attach_sheet_multiplies_and_keeps_unmatched(spark):
    mcqs, sheets = _tables(spark)
    rows = sorted((r["mcq_id"], r["content_gpt"]) for r in joins.attach_sheet(mcqs, sheets).collect())
    assert rows == [(1, "text a"), (2, "text a"), (3, "text b1"), (3, "text b2"), (4, None)]


def test_semi_joins(spark):
    mcqs, sheets = _tables(spark)
    assert sorted(r["id"] for r in joins.semi_join_sheets(sheets, mcqs).collect()) == ["a", "b", "b"]
    assert sorted(r["mcq_id"] for r in joins.semi_join_mcqs(mcqs, sheets).collect()) == [1, 2, 3]


def test_key_coverage(spark):
    mcqs, sheets = _tables(spark)
    got = {r["measure"]: r["value"] for r in joins.key_coverage(mcqs, sheets).collect()}
    assert got == {"mcq_rows": 4, "sheet_rows": 4, "mcq_ids": 3, "sheet_ids": 3,
                   "mcq_ids_without_sheet": 1, "sheet_ids_without_mcq": 1, "duplicated_sheet_ids": 1}


def test_split_and_complement_cover_everything(spark):
    sheets = spark.createDataFrame([("IC-001", "x"), ("IC-002", "y"), (None, "z")], "folder string, id string")
    folders = spark.createDataFrame([("IC-001",), ("IC-009",)], "folder string")
    test = {r["id"] for r in joins.test_split(sheets, folders).collect()}
    train = {r["id"] for r in joins.train_split(sheets, folders).collect()}
    assert test == {"x"} and train == {"y", "z"}
