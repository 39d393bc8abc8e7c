"""P1/P2 edge rows: the metadata block parser and the rubric filter."""

from quizlens.operators import sheets as S

NBSP = "\xa0"


def _run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content_raw string")
    out = S.extract_sheet_metadata(df).orderBy("i").collect()
    return [(r["content_cleaned"], r["rubric"]) for r in out]


def test_metadata_edge_rows(spark):
    cases = [
        ("plain sheet, no block", ("plain sheet, no block", "")),
        ("intro {{knowledge objective\n|Title=T\n}}\nbody", ("**Title:** T;\n\nbody", "")),
        ("{{knowledge objective\n|Title=never closed", ("{{knowledge objective\n|Title=never closed", "")),
        ("{{knowledge objective\n|Title=\n|Description=d\n}}", ("**Description:** d;\n\n", "")),
        ("{{knowledge objective\n|Item_parent=a = b\n}}", ("**Item_parent:** a = b;\n\n", "")),
        ("{{knowledge objective\n|Title=first\n|Title=second\n|Item_parent=p\n}}",
         ("**Item_parent:** p;\n**Title:** second;\n\n", "")),
        ("{{knowledge objective\n|Rubric=Definition ,}\n}}", ("**Rubric:** Definition ;\n\n", "Definition ")),
        ("{{knowledge objective\n||Title=x|\n}}", ("**Title:** x|;\n\n", "")),
        ("{{knowledge objective\nno equals here\n|Item=i\n}}", ("**Item:** i;\n\n", "")),
        ("{{knowledge objective\n|Title=" + NBSP + "spaced" + NBSP + "\n}}", ("**Title:** spaced;\n\n", "")),
        ("{{knowledge objective\n|Title=t\n}}  \n\t ", ("**Title:** t;\n\n", "")),
        ("{{knowledge objective\n|Heading=h\n|Rubric=Multimedia content}}\nrest",
         ("**Rubric:** Multimedia content;\n\nrest", "Multimedia content")),
        ("{{knowledge objective\n|Identifiant=1\n}}\nonly body", ("only body", "")),
    ]
    got = _run(spark, [c for c, _ in cases])
    for (text, want), have in zip(cases, got):
        assert have == want, text


def test_null_content(spark):
    df = spark.createDataFrame([(None,)], "content_raw string")
    r = S.extract_sheet_metadata(df).first()
    assert (r["content_cleaned"], r["rubric"]) == (None, None)


def test_drop_multimedia(spark):
    df = spark.createDataFrame([("a", "Multimedia content"), ("b", "multimedia content"), ("c", ""),
                                ("d", None), ("e", "Definition")], "id string, rubric string")
    kept = sorted(r["id"] for r in S.drop_multimedia(df).collect())
    assert kept == ["b", "c", "d", "e"]
