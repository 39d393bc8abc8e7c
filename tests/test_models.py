"""G11 model map: failure isolation, de-duplication, G12 skipping, T10."""

import glob
import os


from quizlens.functions import prompts as P
from quizlens.operators import models
from quizlens.plans import stubs


class RecordingCompleter:
    """Echoes prompts, records every call to a file, fails on 'boom'."""

    def __init__(self, log_dir):
        self.log_dir = log_dir

    def __call__(self):
        log_dir = self.log_dir

        def complete(system, prompts, temperature, max_tokens, **options):
            with open(os.path.join(log_dir, f"{os.getpid()}.log"), "a") as fh:
                for p in prompts:
                    fh.write(p.replace("\n", " ") + "\n")
            out = []
            for p in prompts:
                if "boom" in p:
                    raise RuntimeError("model failure")
                out.append(f"{system}|{p}|{temperature}")
            return out
        return complete


def _local_dir(scratch):
    path = scratch[len("file:"):] if scratch.startswith("file:") else scratch
    os.makedirs(path, exist_ok=True)
    return path


def _calls(log_dir):
    lines = []
    for f in glob.glob(os.path.join(log_dir, "*.log")):
        lines += open(f).read().splitlines()
    return lines


def test_failure_gives_one_null(spark, scratch):
    log = _local_dir(scratch)
    df = spark.createDataFrame([(i, "boom" if i == 3 else f"p{i}") for i in range(10)], "i int, p string")
    out = models.llm_map(df, "p", "answer", RecordingCompleter(log), system="S", temperature=0.5)
    rows = {r["i"]: r["answer"] for r in out.collect()}
    assert len(rows) == 10
    assert [i for i, a in rows.items() if a is None] == [3]
    assert rows[0] == "S|p0|0.5"


def test_dedupe_calls_each_prompt_once(spark, scratch):
    log = _local_dir(scratch)
    df = spark.createDataFrame([(i, f"p{i % 3}") for i in range(12)] + [(99, None)], "i int, p string")
    out = models.llm_map(df, "p", "answer", RecordingCompleter(log), system=None, temperature=0.0)
    rows = {r["i"]: r["answer"] for r in out.collect()}
    assert len(rows) == 13 and rows[99] is None and rows[4] == "None|p1|0.0"
    assert sorted(_calls(log)) == ["p0", "p1", "p2"]


def test_criterion_skipped_without_prompt(spark):
    df = spark.createDataFrame([(1, "q")], "mcq_id int, question string")
    out = models.disclosure(df, None, stubs.StubJudge(), "disclosure")
    assert out.columns == df.columns


def test_judge_prompt_layout(spark):
    df = spark.createDataFrame([("Q?", "a1", "b1", None, "d1", "B", "ctx")],
                               "question string, option_a string, option_b string, option_c string, "
                               "option_d string, correct_option string, content_gpt string")
    full = df.select(P.judge_prompt(context_col="content_gpt")).first()[0]
    assert full == ("Context:\n-----\nctx\n-----\n-----\nQuestion:\nQ?\nOptions:\na) a1\nb) b1\nc) \nd) d1\n"
                    "Correct option: B\n-----\n")
    bare = df.select(P.judge_prompt(include_options=False)).first()[0]
    assert bare == "-----\nQuestion:\nQ?\nCorrect option: B\n-----\n"


def test_embed_texts_once_per_text(spark):
    df = spark.createDataFrame([(i, ["x y", "y z", None][i % 3]) for i in range(9)], "i int, t string")
    out = models.embed_texts(df, "t", stubs.LetterEmbedder()).collect()
    assert len(out) == 9
    by_text = {}
    for r in out:
        by_text.setdefault(r["t"], set()).add(tuple(r["embedding"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert set(by_text[None]) == {tuple([0.0] * len(stubs.LetterEmbedder.LETTERS))}


def test_generation_wide_pivot(spark):
    sheets = spark.createDataFrame([("s1", "Alpha beta."), ("s2", None)], "id string, content_gpt string")
    wide = models.generate_questions(sheets, stubs.StubGenerator(), wide=True)
    assert set(wide.columns) >= {"generated_questions_0.1", "generated_questions_0.5", "generated_questions_0.7"}
    assert wide.count() == 2


def test_llm_map_many_matches_single_maps(spark):
    from quizlens.plans import jobs

    m = spark.createDataFrame([(i, f"s{i % 3}", f"Question {'x' * i}?", "a", "b", None, "d", "abcd"[i % 4])
                               for i in range(12)],
                              "mcq_id long, id string, question string, option_a string, option_b string, "
                              "option_c string, option_d string, correct_option string")
    s = spark.createDataFrame([(f"s{i}", f"Sheet {i}.") for i in range(3)], "id string, content_gpt string")
    judge = stubs.StubJudge(fail_every=7)
    full = jobs.score_questions(m, s, compute_relevance=False, compute_ambiguity=False, completer=judge,
                                answerability_system_prompt="A", disclosure_system_prompt="D",
                                difficulty_system_prompt=None, distractors_quality_system_prompt="Q")
    got = {r["mcq_id"]: (r["gpt_answer"], r["disclosure"], r["distractors_quality"]) for r in full.collect()}
    assert "difficulty" not in full.columns
    base = m.join(s, "id", "left")
    a = {r["mcq_id"]: r["gpt_answer"] for r in models.answerability(base, "A", judge).collect()}
    d = {r["mcq_id"]: r["disclosure"] for r in models.disclosure(base, "D", judge).collect()}
    q = {r["mcq_id"]: r["distractors_quality"] for r in models.distractors_quality(base, "Q", judge).collect()}
    assert got == {k: (a[k], d[k], q[k]) for k in a}
    assert any(v is None for trio in got.values() for v in trio)


class OptionsEcho:
    """Answers with the request options it received, as JSON."""

    def __call__(self):
        import json

        def complete(system, prompts, temperature, max_tokens, **options):
            return [json.dumps({"max_tokens": max_tokens, **options}) for _ in prompts]
        return complete


def test_generation_and_exam_send_request_options(spark):
    import json

    sheets = spark.createDataFrame([("s1", "Alpha beta.")], "id string, content_gpt string")
    gen = json.loads(models.generate_questions(sheets, OptionsEcho()).first()["response"])
    schema = json.loads(gen["json_schema"])
    assert schema["required"] == ["question", "option_a", "option_b", "option_c", "option_d", "correct_option"]
    assert gen["num_ctx"] == 8192 and gen["top_p"] == 1
    items = spark.createDataFrame([("E1", "Q?", "A", "a", "b", "c", "d")],
                                  "id string, question string, cop string, opa string, opb string, opc string, opd string")
    ex = json.loads(models.answer_exam(items, OptionsEcho()).first()["response"])
    assert json.loads(ex["json_schema"])["required"] == ["answer_option"]
    assert ex["max_tokens"] == 4 and ex["num_ctx"] == 8196
