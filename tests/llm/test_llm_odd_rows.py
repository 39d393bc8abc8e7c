"""Every query and pipeline stage over odd, empty and clashing tables."""

from collections import Counter

import pytest

import corpus_pipeline
import odd_rows
from quizlens.llm import catalog

#: Queries whose rows are not the documents: their ids, from the rows that they read.
OTHER_ROWS = {"op11_divergence": ("lang", {(r[2] or "") for r in odd_rows.rows()}),
              "op12_conversation_repair": ("conv_id", {r[0] for r in odd_rows.conversation_rows()})}
SAME_ROWS = sorted(set(catalog.QUERIES) - {"op10_packing", *OTHER_ROWS})


@pytest.fixture(scope="module")
def folders(spark):
    from quizlens.session import scratch_path

    made = {}
    for kind, how in {"odd": {}, "empty": {"empty": True}, "clashing": {"clashing": True}}.items():
        made[kind] = odd_rows.folder(spark, scratch_path(spark, f"odd-{kind}"), **how)
    return made


def canonical(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_odd_rows(spark, folders, name):
    query = catalog.QUERIES[name]
    got = query(spark, folders["odd"])
    ids = Counter(r[OTHER_ROWS.get(name, ("doc_id",))[0]] for r in got.collect())
    if name in OTHER_ROWS:
        assert ids and (ids.keys() <= OTHER_ROWS[name][1] if name == "op11_divergence" else ids.keys() == OTHER_ROWS[name][1])
    elif name in SAME_ROWS:
        assert ids == Counter(r[0] for r in odd_rows.rows())
    else:
        assert ids.keys() == {r[0] for r in odd_rows.rows()}
    # Columns of the same names as an operator's own change nothing.
    assert canonical(query(spark, folders["clashing"])) == canonical(query(spark, folders["odd"]))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_table(spark, folders, name):
    got = catalog.QUERIES[name](spark, folders["empty"])
    assert got.collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, folders, name, stage):
    for kind in ("clashing", "empty"):
        docs = spark.read.parquet(f"{folders[kind]}/documents.parquet")
        got = stage(spark, docs, folders[kind])
        n = got.count()
        assert (n == 0) == (kind == "empty")
        if name != "packing":
            assert got.columns == docs.columns
            # Rows come out as they were, none is new.
            assert got.exceptAll(docs).count() == 0 if name != "mixing" else got.distinct().exceptAll(docs.distinct()).count() == 0
