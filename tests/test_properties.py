"""Property tests of T4 and P1 against their plain-Python statements."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import pyref
from quizlens.operators import scores, sheets

WORDS = st.sampled_from(["alpha", "beta", "gamma", "Delta", "the", "and", "cannot", "wanna", "m²", "½",
                         "café", "naïve", "x_y", "über"])
SEPS = st.sampled_from([" ", "  ", ", ", ". ", "\n", "\xa0", "-", "'", "?! "])
TEXT = st.lists(st.tuples(WORDS, SEPS), max_size=14).map(lambda ps: "".join(w + s for w, s in ps))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(TEXT, TEXT), min_size=20, max_size=40))
def test_originality_paired_property(spark, pairs):
    m = spark.createDataFrame([(i, f"s{i}", q) for i, (q, _) in enumerate(pairs)],
                              "mcq_id long, id string, question string")
    s = spark.createDataFrame([(f"s{i}", t) for i, (_, t) in enumerate(pairs)]
                              + [(f"t{i}", q) for i, (q, _) in enumerate(pairs)], "id string, content_gpt string")
    self_pairs = spark.createDataFrame([(1000 + i, f"t{i}", q) for i, (q, _) in enumerate(pairs)],
                                       "mcq_id long, id string, question string")
    got = {r["mcq_id"]: r["originality"] for r in scores.originality_paired(m.unionByName(self_pairs), s).collect()}
    for i, (q, t) in enumerate(pairs):
        assert got[i] == pyref.originality(q, t), (q, t)
        assert 0.0 <= got[i] <= 1.0
        assert got[1000 + i] == 0.0          # T4(x, x) = 0


LINE_KEYS = st.sampled_from(["|Title", "||Title|", "|Item_parent", "|Description", "|Item", "|Rubric",
                             "|Heading", "Title", " |Item"])
VALUES = st.sampled_from(["x", " spaced ", "a = b", "v ,}", "", "\xa0nb\xa0", "Multimedia content", "}"])
LINE = st.one_of(st.tuples(LINE_KEYS, VALUES).map(lambda kv: f"{kv[0]}={kv[1]}"),
                 st.sampled_from(["no equals", "", "  "]))
BLOCK = st.builds(
    lambda pre, lines, close, body: pre + "{{knowledge objective\n" + "\n".join(lines) + close + body,
    st.sampled_from(["", "lead ", "text\n"]), st.lists(LINE, max_size=6),
    st.sampled_from(["}}", "\n}}", "", "}"]), st.sampled_from(["", "\nbody", "\n  body text \n", "}} more"]))
SHEET = st.one_of(BLOCK, st.sampled_from(["plain", "", "{{ other }}"]))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(SHEET, min_size=30, max_size=60))
def test_metadata_property(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content_raw string")
    rows = sheets.extract_sheet_metadata(df).orderBy("i").collect()
    for t, r in zip(texts, rows):
        assert (r["content_cleaned"], r["rubric"]) == pyref.metadata(t), t
