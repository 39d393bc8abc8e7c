"""R1-R4 strict JSON and parsing; P4-P8 clean-up steps."""

import json

from quizlens.operators import responses as R

FULL = {"question": "Q", "option_a": "w", "option_b": "x", "option_c": "y", "option_d": "z",
        "correct_option": "b"}


def _mcq(**over):
    d = dict(FULL)
    d.update(over)
    return json.dumps(d)


def _validate(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    return [r["mcq"] for r in R.validate_mcq_json(df).orderBy("i").collect()]


def test_strict_mcq_json(spark):
    cases = [
        (_mcq(), True),
        (_mcq(option_a=1), False),                       # number is not a string
        (json.dumps({k: v for k, v in FULL.items() if k != "correct_option"}), False),
        (_mcq(extra=[1]), True),                         # extra keys ignored
        ("  plain text  ", False),
        ('Sure: {"answer": "B"} done', False),
        (_mcq(option_a=None), False),                    # null is not a string
        (_mcq() + " trailing", False),                   # text after the object
        (_mcq() + ' ,"#end#"', False),                   # a second value
        ("[" + _mcq() + "]", False),                     # top-level array
        (None, False),
        ("  " + _mcq() + "\n", True),                    # surrounding whitespace is fine
    ]
    got = _validate(spark, [c for c, _ in cases])
    assert [g is not None for g in got] == [ok for _, ok in cases]
    assert got[0].asDict() == FULL


def test_duplicate_keys_last_wins(spark):
    got = _validate(spark, ['{"question":"a","question":"b","option_a":"w","option_b":"x",'
                            '"option_c":"y","option_d":"z","correct_option":"c"}'])
    assert got[0]["question"] == "b"


def test_parse_response(spark):
    cases = [
        ('Sure: {"answer": "B"} done', "B"),
        ('{"answer": null}', None),
        ('{"answer": 3}', "3"),
        ('x {"other": 1} y', '{"other": 1}'),
        ("  no json here \n", "no json here"),
        ('{"a": 1} }', '{"a": 1} }'),                     # greedy match fails to parse -> stripped text
        ('{"answer": "A"}, {"answer": "B"}', '{"answer": "A"}, {"answer": "B"}'),
        (None, None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, response string")
    got = [r["parsed"] for r in R.parse_response(df).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_answer_cleanup(spark):
    vals = ["", "3", "0", "1", " c) x", "b", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, a string")
    up = R.normalise_answer(df, "a", "m")
    remapped = R.remap_values(up, "m")
    first = R.normalise_answer(remapped, "m", "f", first_letter=True)
    rows = first.orderBy("i").collect()
    assert [r["m"] for r in rows] == ["A", "D", "A", "B", " C) X", "B", None]
    assert [r["f"] for r in rows] == ["A", "D", "A", "B", "C", "B", None]


def test_fill_flatten_find(spark):
    df = spark.createDataFrame([(1, _mcq()), (2, "bad")], "id int, response string")
    v = R.validate_mcq_json(df)
    assert [r["id"] for r in R.find_invalid(v).collect()] == [2]
    flat = {r["id"]: r.asDict() for r in R.flatten_mcq(R.fill_invalid_mcq(v)).collect()}
    assert flat[2] == {"id": 2, **{k: "" for k in R.MCQ_FIELDS}}
    assert flat[1]["correct_option"] == "b"


def test_response_report(spark):
    df = spark.createDataFrame([(0.1, _mcq()), (0.1, "x"), (0.7, "y")], "t double, response string")
    rep = {r["t"]: (r["n_rows"], r["n_valid"], r["n_invalid"])
           for r in R.response_report(R.validate_mcq_json(df), "mcq", ["t"]).collect()}
    assert rep == {0.1: (2, 1, 1), 0.7: (1, 0, 1)}
