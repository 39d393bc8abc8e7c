"""G11 with an answer store, halving of failed batches, the shipped scoring command, and noun lemmas by rule."""

import csv
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from quizlens.operators import answer_store, lemmas, models
from quizlens.plans import jobs, stubs
from quizlens.sources import files
from test_models import RecordingCompleter, _calls, _local_dir


def ask(spark, rows, log, store, system="S", schema="i long, p string", **how):
    out = models.llm_map(spark.createDataFrame(rows, schema), "p", "answer", RecordingCompleter(log), system=system, store=store, **how)
    return {r["i"]: r["answer"] for r in out.collect()}


@pytest.mark.parametrize("temperature", [0.0, 0.5])
def test_tables_and_prompts_share_a_store(spark, scratch, temperature):
    log, store = _local_dir(scratch + "-log"), scratch
    one = ask(spark, [(1, "p1"), (2, "p2")], log, store, "A", temperature=temperature)
    two = ask(spark, [(3, "p1"), (4, "p4"), (5, None)], log, store, "B", temperature=temperature)
    assert one == {1: f"A|p1|{temperature}", 2: f"A|p2|{temperature}"}
    assert two == {3: f"B|p1|{temperature}", 4: f"B|p4|{temperature}", 5: None}
    assert sorted(_calls(log)) == ["p1", "p1", "p2", "p4"]
    # Asked again: no call, the same answers.
    assert ask(spark, [(1, "p1"), (2, "p2")], log, store, "A", temperature=temperature) == one
    assert len(_calls(log)) == 4
    # Another setting is another request.
    ask(spark, [(1, "p1")], log, store, "A", temperature=temperature, options={"top_p": 1})
    assert len(_calls(log)) == 5


def test_actions_do_not_call_again(spark, scratch):
    log = _local_dir(scratch + "-log")
    df = spark.createDataFrame([(i, f"p{i % 3}") for i in range(9)], "i int, p string")
    out = models.llm_map(df, "p", "answer", RecordingCompleter(log), temperature=0.5, store=scratch)
    assert out.count() == 9 and len(out.collect()) == 9
    assert len(_calls(log)) == 9        # one sample a row, whatever the number of actions


def test_stopped_run_calls_only_the_rest(spark, scratch, monkeypatch):
    log, rows = _local_dir(scratch + "-log"), [(i, f"p{i}") for i in range(64)]
    real, commits = models.call_tasks, []

    def stops(df, partitions=None):
        commits.append(1)
        if len(commits) == 5:
            raise RuntimeError("the run is stopped")
        return real(df, partitions)

    monkeypatch.setattr(models, "call_tasks", stops)
    with pytest.raises(RuntimeError):
        ask(spark, rows, log, scratch, temperature=0.0)
    done = answer_store.read_answers(spark, scratch).count()
    assert 0 < done < 64 and len(_calls(log)) == done
    monkeypatch.setattr(models, "call_tasks", real)
    got = ask(spark, rows, log, scratch, temperature=0.0)
    assert got == {i: f"S|p{i}|0.0" for i in range(64)}
    assert sorted(_calls(log)) == sorted(f"p{i}" for i in range(64))


def test_failed_calls_stay_null_until_retried(spark, scratch):
    log, rows = _local_dir(scratch + "-log"), [(1, "p1"), (2, "boom")]
    assert ask(spark, rows, log, scratch, temperature=0.0) == {1: "S|p1|0.0", 2: None}
    before = _calls(log)
    assert ask(spark, rows, log, scratch, temperature=0.0)[2] is None and sorted(_calls(log)) == sorted(before)
    assert ask(spark, rows, log, scratch, temperature=0.0, retry_failed=True) == {1: "S|p1|0.0", 2: None}
    assert sorted(_calls(log)) == sorted([*before, "boom"])


def test_samples_are_numbered_within_a_request(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(7, "hot")] * 5, "i int, k string")
    rows = answer_store.with_samples(df, "k", "n").collect()
    assert sorted(r["n"] for r in rows if r["k"] == "hot") == list(range(205))
    again = answer_store.with_samples(df.repartition(7), "k", "n").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_runs_take_a_store(spark, scratch):
    sheets = spark.createDataFrame([(f"s{i}", f"Sheet number {i}.") for i in range(4)], "id string, content_gpt string")
    for fn, how in ((models.generate_questions, {}), (models.clean_sheets, {"content_col": "content_gpt", "out_col": "clean"})):
        log, store = _local_dir(f"{scratch}-{fn.__name__}-log"), f"{scratch}-{fn.__name__}"
        first = sorted(map(str, fn(sheets, RecordingCompleter(log), store=store, **how).collect()))
        calls = len(_calls(log))
        assert sorted(map(str, fn(sheets, RecordingCompleter(log), store=store, **how).collect())) == first
        assert len(_calls(log)) == calls > 0
    items = spark.createDataFrame([(f"E{k}", "Q?", "A", "a", "b", "c", "d") for k in range(3)], files.EXAM_SCHEMA)
    log = _local_dir(scratch + "-exam-log")
    for _ in range(2):
        got = models.answer_exam(items, RecordingCompleter(log), store=scratch + "-exam").collect()
    assert len(got) == 9 and len({(r["id"], r["run"]) for r in got}) == 9
    # Two runs at 0.5 are two samples of equal requests, and the three items ask the same.
    assert answer_store.read_answers(spark, scratch + "-exam").count() == 9


# ---------------------------------------------------------------- halving

def test_one_bad_prompt_costs_few_calls():
    calls = []

    def call(some):
        calls.append(len(some))
        if "bad" in some:
            raise RuntimeError
        return [x.upper() for x in some]

    items = [f"x{k}" for k in range(256)]
    items[77] = "bad"
    assert models.bisected(call, items) == [None if x == "bad" else x.upper() for x in items]
    assert len(calls) == 1 + 2 * 8
    assert models.bisected(call, []) == [] and models.bisected(lambda some: [], ["a", "b"]) == [None, None]


class FailingEmbedder(stubs.LetterEmbedder):
    def __call__(self):
        embed = super().__call__()

        def careful(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("model failure")
            return embed(texts)
        return careful


def test_bad_text_gives_a_null_vector(spark):
    df = spark.createDataFrame([(i, "boom" if i == 5 else f"text {'e' * i}") for i in range(20)], "i int, t string")
    rows = {r["i"]: r["embedding"] for r in models.embed_texts(df, "t", FailingEmbedder()).collect()}
    assert [i for i, v in rows.items() if v is None] == [5] and len(rows) == 20


# ---------------------------------------------------------------- the command

OFF = {f"compute_{x}": False for x in ("originality", "readability", "negation", "is_question", "relevance", "ambiguity")}


def written(path):
    """Rows of a folder of CSV files, read in the order of their names."""
    import csv

    out = []
    for f in sorted(glob.glob(os.path.join(path.removeprefix("file:"), "part-*"))):
        with open(f, newline="", encoding="utf-8") as fh:
            out += list(csv.DictReader(fh))
    return out


@pytest.mark.parametrize("own_sheet", [False, True])
def test_shipped_run_needs_no_sheet(spark, scratch, own_sheet):
    names = ["note", "id", "question", "option_a", "option_b", "option_c", "option_d", "correct_option", "mcq_id"] + ["content_gpt"] * own_sheet
    rows = [[f"n{k}", f"s{k % 5}", f"Question \"{k}\",\nof two lines?", "a", "b", "c", "d", "abcd"[k % 4], str(900 - k)] + ["Text."] * own_sheet
            for k in range(200)]
    files.write_csv_table(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).coalesce(1), scratch + "/in")
    jobs.score_csv_job(spark, scratch + "/in", None, scratch + "/out", merge=False, completer=stubs.StubJudge(),
                       distractors_quality_system_prompt="Rate.", **OFF)
    got = written(scratch + "/out")
    # Every column of the file, a `mcq_id` of its own too, and the order of the input.
    assert list(got[0]) == [*names, "distractors_quality"]
    assert [r["note"] for r in got] == [r[0] for r in rows] and got[3]["question"] == rows[3][2]


def test_scored_files_keep_the_order_of_the_input(spark, scratch):
    n = 3000
    mcqs = spark.createDataFrame([(f"s{k * 7919 % 97}", f"Question {k}?", "a", "b", "c", "d", "a") for k in range(n)], files.MCQS_SCHEMA)
    sheets = spark.createDataFrame([("f", f"s{k}", f"Sheet {k}.") for k in range(97)], files.SHEETS_SCHEMA)
    files.write_csv_table(mcqs.coalesce(1), scratch + "/mcqs")
    files.write_csv_table(sheets, scratch + "/sheets")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        jobs.score_csv_job(spark, scratch + "/mcqs", scratch + "/sheets", scratch + "/out", compute_relevance=False, compute_ambiguity=False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(glob.glob(scratch.removeprefix("file:") + "/out/part-*")) > 1
    assert [r["question"] for r in written(scratch + "/out")] == [f"Question {k}?" for k in range(n)]


def test_compressed_csv_files_give_the_same_table(spark, scratch):
    """gzip files in and out: the rows and their order are those of plain files."""
    import gzip

    mcqs = spark.createDataFrame([(f"s{k * 31 % 13}", f"Question {k},\n\"two\" lines?", "a", None, "c", " d ", "a") for k in range(300)], files.MCQS_SCHEMA)
    sheets = spark.createDataFrame([("f", f"s{k}", f"Sheet {k}.") for k in range(11)], files.SHEETS_SCHEMA)
    for kind in (None, "gzip"):
        files.write_csv_table(mcqs.coalesce(1), f"{scratch}/mcqs-{kind}", compression=kind)
        files.write_csv_table(sheets, f"{scratch}/sheets-{kind}", compression=kind)
        jobs.score_csv_job(spark, f"{scratch}/mcqs-{kind}", f"{scratch}/sheets-{kind}", f"{scratch}/out-{kind}", compression=kind,
                           compute_relevance=False, compute_ambiguity=False)
    packed = sorted(glob.glob(scratch.removeprefix("file:") + "/out-gzip/part-*"))
    assert packed and all(f.endswith(".csv.gz") for f in packed)
    got = []
    for f in packed:
        with gzip.open(f, "rt", newline="", encoding="utf-8") as fh:
            got += list(csv.DictReader(fh))
    assert got == written(f"{scratch}/out-None") and len(got) == 300


def test_no_sheet_column_without_merge(spark):
    m = spark.createDataFrame([(1, "s1", "Why?", "a", "b", "c", "d", "a")],
                              "mcq_id long, id string, question string, option_a string, option_b string, option_c string, option_d string, correct_option string")
    out = jobs.score_questions(m, merge=False, compute_originality=False, compute_relevance=False, embedder=stubs.LetterEmbedder())
    assert out.select("ambiguity", "is_question").first() is not None
    with pytest.raises(Exception, match="content_gpt"):
        jobs.score_questions(m, merge=False, compute_relevance=False, compute_ambiguity=False).collect()


# ---------------------------------------------------------------- lemmas

def plain_lemma(form, lexicon, exceptions, rounds):
    def best(found):
        found = [w for w in found if w in lexicon]
        return min(found, key=lambda w: (len(w), w != form, w)) if found else None

    if form in exceptions:
        return best([form, *exceptions[form]]) or form
    left, found = [form], [form]
    for _ in range(rounds):
        left = [w[:len(w) - len(end)] + put for w in left for end, put in lemmas.NOUN_ENDINGS if w.endswith(end)]
        if lemma := best(found + left):
            return lemma
        found = []
    return form


def test_noun_lemmas_by_rule(spark):
    r = random.Random(3)
    stems = ["bus", "box", "quiz", "church", "dish", "man", "fly", "leaf", "glass", "s", "", "cat", "wo", "ox", "x"]
    ends = ["", "s", "es", "ses", "ves", "xes", "zes", "ches", "shes", "men", "ies", "ss", "sss"]
    forms = sorted({r.choice(stems) + r.choice(ends) + r.choice(["", "", "s"]) for _ in range(400)})
    lexicon = {"bus", "box", "quiz", "church", "dish", "man", "woman", "fly", "leaf", "glass", "cat", "ox", "x", "women", "boxe", "goose"}
    exceptions = {"oxes": ["ox"], "cats": ["goose", "leaf"], "xs": ["nowhere"]}
    tables = (spark.createDataFrame([(f,) for f in [*forms, None, *forms[:5]]], "form string"),
              spark.createDataFrame([(w,) for w in [*sorted(lexicon), None, "cat"]], "lemma string"),
              spark.createDataFrame([(f, w) for f, ws in exceptions.items() for w in ws] + [(None, "x"), ("y", None)], "form string, lemma string"))
    out = lemmas.noun_lemmas(*tables)
    want = {f: w for f in forms if (w := plain_lemma(f, lexicon, exceptions, lemmas.ROUNDS)) != f}
    assert {r["form"]: r["lemma"] for r in out.collect()} == want and len(want) > 40
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert lemmas.noun_lemmas(*(t.limit(0) for t in tables)).collect() == []


def test_noun_lemmas_feed_the_scores(spark):
    from quizlens.operators import scores

    m = spark.createDataFrame([(1, "s", "boxes churches flies")], "mcq_id long, id string, question string")
    s = spark.createDataFrame([("s", "box church fly")], "id string, content_gpt string")
    words = m.select(F.explode(F.split("question", " ")).alias("form"))
    lexicon = s.select(F.explode(F.split("content_gpt", " ")).alias("lemma"))
    table = lemmas.noun_lemmas(words, lexicon, spark.createDataFrame([], "form string, lemma string"))
    assert scores.originality_paired(m, s).first()["originality"] == 1.0
    assert scores.originality_paired(m, s, lemmas=table).first()["originality"] == 0.0
