"""Model-backed columns: the completion map (G11), embeddings (T10) and the
criteria and generation runs built on them (G4-G10, G12).

The model is never part of this package: callers pass a *factory* that
builds a completer (or embedder) once per Python worker.  Spark's part is to
build prompts, drop repeats when that is allowed, spread the calls over
partitions, isolate failures (a failing prompt gives NULL, never a lost row)
and parse what comes back.

Completer protocol::

    complete(system: str | None, prompts: list[str], temperature: float,
             max_tokens: int | None, **options) -> list[str | None]

``options`` (only passed when a run sets them) carries request settings
such as ``json_schema`` (the record the answer must follow), ``num_ctx`` and
``top_p``.

Embedder protocol::

    embed(texts: list[str]) -> list[list[float]]   # unit-length vectors

Tokenizer protocol, for embedders that take a limited number of tokens::

    tokenize(texts: list[str]) -> list[list[tuple[int, int]]]   # (start, end) of each token in its text
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlens.functions import prompts as P
from quizlens.operators import answer_store
from quizlens.operators import responses as R
from quizlens.plans.sizing import cut_lineage
from quizlens.session import ship_package

CompleterFactory = Callable[[], Callable]
EmbedderFactory = Callable[[], Callable]
TokenizerFactory = Callable[[], Callable]

# Judge call settings and the generation / exam runs.
JUDGE_TEMPERATURE = 0.5
JUDGE_MAX_TOKENS = 1
CLEANING_TEMPERATURE = 0.2
GENERATION_TEMPERATURES = (0.1, 0.5, 0.7)
# Output label -> temperature actually used; the "0.1" run was sent at 0.5.
EXAM_RUNS = {"0.1": 0.5, "0.5": 0.5, "0.7": 0.7}
EXAM_MAX_TOKENS = 4
# Request settings of the local generation and exam runs.
GENERATION_OPTIONS = {"num_ctx": 8192, "top_p": 1}
EXAM_OPTIONS = {"num_ctx": 8196, "top_p": 1}


# The tokens that the embedding model takes, and those of them that frame the text.
EMBED_TOKENS = 512
EMBED_SPECIAL_TOKENS = 2
# Tokens of a batch, padding included, and the share of them that may be padding.
EMBED_BATCH_TOKENS = 16_384
EMBED_PADDING = 0.1

# The record title that both runs send with their request.
RECORD_TITLE = "MCQQuestion"


def record_schema(fields, title: str = RECORD_TITLE) -> str:
    """JSON Schema text of a record whose ``fields`` are all required strings.

    Each field carries a title: its name in words, capitalised.
    """
    import json

    properties = {f: {"title": f.replace("_", " ").title(), "type": "string"} for f in fields}
    return json.dumps({"properties": properties, "required": list(fields), "title": title, "type": "object"})

_WORKER_CACHE: dict[str, Callable] = {}


def _build_once(factory: Callable[[], Callable]) -> Callable:
    """One model client per Python worker process and factory.

    Tasks receive a fresh copy of the factory, so the cache is keyed by the
    factory's pickled form rather than by object identity.
    """
    import hashlib

    from pyspark import cloudpickle

    key = hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()
    fn = _WORKER_CACHE.get(key)
    if fn is None:
        fn = factory()
        _WORKER_CACHE[key] = fn
    return fn


def bisected(call: Callable[[list], list], items: list) -> list:
    """``call(items)``; where it fails, the items are halved until the bad ones are alone, and those give None.

    One bad item of n costs about 2 log2(n) calls more, instead of n.
    """
    if not items:
        return []
    try:
        out = list(call(items))
        if len(out) == len(items):
            return out
    except Exception:  # noqa: BLE001 - a failure of the model, whatever it is, is isolated
        pass
    if len(items) == 1:
        return [None]
    half = len(items) // 2
    return bisected(call, items[:half]) + bisected(call, items[half:])


def _safe_complete(complete, system, prompts, temperature, max_tokens, options=None):
    """The answers, None for each prompt on which the completer fails."""
    answers = bisected(lambda some: complete(system, some, temperature, max_tokens, **(options or {})), prompts)
    return [None if a is None else str(a) for a in answers]


def _call_udf(factory, max_tokens, batch_rows, options=None):
    """A pandas UDF ``(prompt, system, temperature) -> answer``; only these columns enter Python."""
    @F.pandas_udf("string")
    def call(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        complete = _build_once(factory)
        for prompt, system, temperature in batches:
            rows = pd.DataFrame({"p": prompt, "s": system, "t": temperature}).reset_index(drop=True)
            out = pd.Series([None] * len(rows), dtype=object)
            for (s, t), g in rows[rows["p"].notna()].groupby(["s", "t"], dropna=False, sort=False):
                s, t = None if pd.isna(s) else s, float(t) if pd.notna(t) else None
                for start in range(0, len(g), batch_rows):
                    chunk = g.iloc[start:start + batch_rows]
                    out.loc[chunk.index] = _safe_complete(complete, s, chunk["p"].tolist(), t, max_tokens, options)
            yield out

    # A repeated call may answer differently: Spark must not copy or move it.
    return call.asNondeterministic()


def call_tasks(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` spread for model calls.

    By default over as many tasks as the session shuffles into
    (``spark.sql.shuffle.partitions``, which follows the size of the data),
    and over all cores at least: a lost task repeats its share of calls only.
    """
    return df.repartition(call_task_count(df, partitions))


def call_task_count(df: DataFrame, partitions: int | None = None) -> int:
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return partitions or max(width, spark.sparkContext.defaultParallelism)


def llm_map(df: DataFrame, prompt: str | Column, out_col: str, completer: CompleterFactory,
            system: str | Column | None = None, temperature: float | str | Column = JUDGE_TEMPERATURE,
            max_tokens: int | None = JUDGE_MAX_TOKENS, dedupe: bool | None = None,
            partitions: int | None = None, batch_rows: int = 64,
            options: dict | None = None, store: str | None = None, retry_failed: bool = False) -> DataFrame:
    """One model call per row (or per distinct request), text back, errors NULL.

    ``dedupe`` (default: only when every temperature is 0) sends each distinct
    ``(system, prompt, temperature)`` once and joins the answers back on that
    request; otherwise every row is its own call.  Only the request crosses
    into Python.  ``partitions`` sets the number of call tasks (see
    :func:`call_tasks`).

    ``store`` names a folder that keeps the answers by request (see
    :mod:`quizlens.operators.answer_store`): the calls are made now, and only
    those that the folder lacks; rows of one request that are calls of their
    own take its samples in order.  With ``retry_failed`` calls that failed
    before are made again.
    """
    ship_package(df.sparkSession)
    p_col = F.col(prompt) if isinstance(prompt, str) else prompt
    s_col = F.lit(system) if system is None or isinstance(system, str) else system
    if isinstance(temperature, (int, float)):
        t_col = F.lit(float(temperature))
        zero_temp = float(temperature) == 0.0
    else:
        t_col = (F.col(temperature) if isinstance(temperature, str) else temperature)
        zero_temp = False
    if dedupe is None:
        dedupe = zero_temp
    call = _call_udf(completer, max_tokens, batch_rows, options)
    request = {"_prompt": p_col.cast("string"), "_system": s_col.cast("string"), "_temperature": t_col.cast("double")}  # in the order of `call`
    if store is not None:
        key = answer_store.request_key(*(F.col(c) for c in ("_system", "_prompt", "_temperature")), max_tokens, options)
        req = df.withColumns(request).withColumn("_rkey", key)
        if dedupe:
            req = req.withColumn("_sample", F.lit(0))
        else:
            req = answer_store.with_samples(cut_lineage(req), "_rkey", "_sample")
        req = cut_lineage(req.withColumn("_akey", F.sha2(F.concat_ws(":", "_rkey", "_sample"), 256)).drop("_rkey", "_sample"))
        asked = req.where(F.col("_prompt").isNotNull()).select(F.col("_akey").alias("key"), *request)
        answers = answer_store.answered(
            asked, lambda some: call_tasks(some, partitions).select("key", call(*request).alias("response")), store, retry_failed)
        return (req.join(answers.withColumnsRenamed({"key": "_akey", "response": "_response"}), "_akey", "left").drop("_akey", *request)
                .withColumnRenamed("_response", out_col))
    if dedupe:
        # One call per distinct request, keyed by the SHA-256 of the request:
        # the answers travel back without the prompt text, and the join key is
        # short however long the prompts are.
        req = df.withColumns(request).withColumn("_rkey", F.sha2(F.to_json(F.struct(*request)), 256))
        calls = (req.where(F.col("_prompt").isNotNull())
                 .select("_rkey", "_system", "_prompt", "_temperature").dropDuplicates(["_rkey"]))
        answered = call_tasks(calls, partitions).select("_rkey", call("_prompt", "_system", "_temperature").alias("_response"))
        return req.join(answered, "_rkey", "left").drop("_rkey", *request).withColumnRenamed("_response", out_col)
    req = call_tasks(df, partitions).withColumns(request)
    return req.withColumn(out_col, call("_prompt", "_system", "_temperature")).drop(*request)


def llm_map_many(df: DataFrame, requests: list[tuple[Column, str, str | None, float, int | None]],
                 completer: CompleterFactory | None, partitions: int | None = None,
                 batch_rows: int = 64, store: str | None = None) -> DataFrame:
    """Several model columns in one pass: ``requests`` are
    ``(prompt, out_col, system, temperature, max_tokens)``.  The rows are
    spread once; only the prompts cross into Python.  With a ``store`` each
    request is asked against it (see :func:`llm_map`)."""
    if not requests:
        return df
    if store is not None:
        for prompt, out_col, system, temperature, max_tokens in requests:
            df = llm_map(df, prompt, out_col, completer, system, temperature, max_tokens, False, partitions, batch_rows, store=store)
        return df
    ship_package(df.sparkSession)
    prompts = {f"_prompt{i}": r[0].cast("string") for i, r in enumerate(requests)}
    req = call_tasks(df, partitions).withColumns(prompts)
    for i, (_, out_col, system, temperature, max_tokens) in enumerate(requests):
        call = _call_udf(completer, max_tokens, batch_rows)
        req = req.withColumn(out_col, call(f"_prompt{i}", F.lit(system).cast("string"), F.lit(temperature).cast("double")))
    return req.drop(*prompts)


def _embed_batches(factory, batch_rows):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = _build_once(factory)
        for pdf in batches:
            vecs = []
            texts = pdf["_text"].tolist()
            for start in range(0, len(texts), batch_rows):
                found = bisected(embed, texts[start:start + batch_rows])
                vecs.extend([None if v is None else list(map(float, v)) for v in found])
            yield pd.DataFrame({"_tkey": pdf["_tkey"].tolist(), "_vector": vecs})
    return run


def embed_texts(df: DataFrame, text_col: str, embedder: EmbedderFactory,
                out_col: str = "embedding", partitions: int | None = None,
                batch_rows: int = 256) -> DataFrame:
    """A vector per text, each distinct text embedded once, joined back.

    Texts are keyed by their SHA-256, so the vectors travel back without the
    text and the join key stays short.  NULL text embeds as the empty string
    (as an empty distractor does).  A text on which the embedder fails gets a
    NULL vector, and the others of its batch their own.
    """
    vectors = key_vectors(df, text_col, embedder, "_vector", partitions, batch_rows)
    keyed = df.withColumn("_tkey", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    return keyed.join(vectors, "_tkey", "left").withColumnRenamed("_vector", out_col).drop("_tkey")


def key_vectors(df: DataFrame, text_col: str, embedder: EmbedderFactory, out_col: str = "embedding",
                partitions: int | None = None, batch_rows: int = 256) -> DataFrame:
    """``(_tkey, vector)`` for the distinct texts of a column by their SHA-256, as in :func:`embed_texts`; no text is in it."""
    ship_package(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.select(F.sha2(text, 256).alias("_tkey"), text.alias("_text"))
    return distinct_in_call_tasks(texts, partitions).mapInPandas(_embed_batches(embedder, batch_rows), "_tkey string, _vector array<float>").withColumnRenamed("_vector", out_col)


#: Keys that a task remembers while it leaves out texts that it has sent already.
SENT_KEYS = 1 << 18


def _unsent(batches):
    """The rows of a task whose ``_tkey`` it has not sent before, as far as it remembers: most repeats stay where they are."""
    import pyarrow as pa

    sent: set[str] = set()
    for batch in batches:
        new = []
        for key in batch.column("_tkey").to_pylist():
            new.append(key not in sent)
            if new[-1]:
                if len(sent) >= SENT_KEYS:
                    sent.clear()
                sent.add(key)
        yield batch.filter(pa.array(new, pa.bool_()))


def distinct_in_call_tasks(texts: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each ``_tkey`` of ``(_tkey, _text)``, dealt by the key into as many tasks as :func:`call_tasks`.

    The texts are shuffled once: the tasks that make them distinct also make
    the calls.
    """
    n = call_task_count(texts, partitions)
    return texts.mapInArrow(_unsent, texts.schema).repartition(n, "_tkey").dropDuplicates(["_tkey"])


def cut_texts(texts: list[str], tokenizer, max_tokens: int) -> tuple[list[str], list[int]]:
    """Each text up to the end of its ``max_tokens``-th token, and its number of tokens after the cut."""
    out, sizes = [], []
    for text, spans in zip(texts, tokenizer(texts), strict=True):
        out.append(text if len(spans) <= max_tokens else text[:spans[max_tokens - 1][1]])
        sizes.append(min(len(spans), max_tokens))
    return out, sizes


def _cut_batches(factory, max_tokens, batch_rows):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _build_once(factory)
        for pdf in batches:
            kept = []
            texts = list(zip(pdf["_tkey"], pdf["_text"]))
            for start in range(0, len(texts), batch_rows):
                some = texts[start:start + batch_rows]
                found = bisected(lambda part: list(zip(*cut_texts(part, tokenizer, max_tokens))), [t for _, t in some])
                kept += [(k, None, 0) if f is None else (k, *f) for (k, _), f in zip(some, found)]
            yield pd.DataFrame(kept, columns=["_tkey", "_cut", "_tokens"])
    return run


def padded_batches(sizes: list[int], batch_tokens: int, max_padding: float) -> list[tuple[int, int]]:
    """``(start, stop)`` of batches of rising sizes: a batch is as wide as its longest text.

    A batch holds at most ``batch_tokens`` tokens with its padding (a longer
    text is a batch of its own), and of them at most the share ``max_padding``
    is padding.
    """
    out, start, total = [], 0, 0
    for k, size in enumerate(sizes):
        width, rows = max(size, 1), k - start + 1
        if rows > 1 and (width * rows > batch_tokens or width * rows - (total + max(size, 1)) > max_padding * width * rows):
            out.append((start, k))
            start, total = k, 0
        total += max(size, 1)
    return out + [(start, len(sizes))] if sizes else out


def _embed_bucketed(factory, batch_tokens, max_padding):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = _build_once(factory)
        for pdf in batches:
            texts, vecs = pdf["_cut"].tolist(), []
            for start, stop in padded_batches(pdf["_tokens"].tolist(), batch_tokens, max_padding):
                vecs += [None if v is None else list(map(float, v)) for v in bisected(embed, texts[start:stop])]
            yield pd.DataFrame({"_tkey": pdf["_tkey"].tolist(), "_vector": vecs})
    return run


def embed_texts_bucketed(df: DataFrame, text_col: str, embedder: EmbedderFactory, tokenizer: TokenizerFactory,
                         out_col: str = "embedding", max_tokens: int = EMBED_TOKENS - EMBED_SPECIAL_TOKENS,
                         batch_tokens: int = EMBED_BATCH_TOKENS, max_padding: float = EMBED_PADDING,
                         partitions: int | None = None, batch_rows: int = 256) -> DataFrame:
    """T10 for models that pad: texts are cut to ``max_tokens`` and meet texts of their own length in a batch.

    Each distinct text is cut by the injected tokenizer, and texts that are
    equal once they are cut are embedded once.  They are dealt to tasks by
    ranges of (tokens, SHA-256) and sorted within them, so a length that many
    texts share is many tasks; :func:`padded_batches` bounds memory and
    padding.  NULL counts as the empty text.  A text on which the tokenizer
    or the embedder fails has a NULL vector.
    """
    spark = df.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.withColumn("_tkey", F.sha2(text, 256))
    texts = keyed.select("_tkey", text.alias("_text")).dropDuplicates(["_tkey"])
    cut = call_tasks(texts, partitions).mapInPandas(_cut_batches(tokenizer, max_tokens, batch_rows), "_tkey string, _cut string, _tokens int")
    # Stored: read for the embedder and for the way back, and sampled for the ranges.
    cut = cut_lineage(cut.withColumn("_ckey", F.sha2("_cut", 256)))
    width = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    asked = (cut.where(F.col("_cut").isNotNull()).dropDuplicates(["_ckey"]).select(F.col("_ckey").alias("_tkey"), "_cut", "_tokens")
             .repartitionByRange(width, "_tokens", "_tkey").sortWithinPartitions("_tokens", "_tkey"))
    vectors = asked.mapInPandas(_embed_bucketed(embedder, batch_tokens, max_padding), "_tkey string, _vector array<float>")
    found = cut.select("_tkey", "_ckey").join(vectors.withColumnRenamed("_tkey", "_ckey"), "_ckey").drop("_ckey")
    return keyed.join(found, "_tkey", "left").withColumnRenamed("_vector", out_col).drop("_tkey")


def vector_table(texts: DataFrame, text_col: str, embedder: EmbedderFactory,
                 out_col: str = "embedding", partitions: int | None = None) -> DataFrame:
    """``(text, vector)`` for the distinct texts of a column: computed once, joined many times."""
    distinct = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col)).distinct()
    return embed_texts(distinct, text_col, embedder, out_col, partitions)


# ----------------------------------------------------------- judge criteria

def _judge(df: DataFrame, system_prompt: str | None, out_col: str, completer: CompleterFactory,
           temperature: float, max_tokens: int, **prompt_kwargs) -> DataFrame:
    """A criterion runs only when its system prompt is given."""
    if system_prompt is None:
        return df
    return llm_map(df, P.judge_prompt(**prompt_kwargs), out_col, completer, system=system_prompt,
                   temperature=temperature, max_tokens=max_tokens)


def _names(cols: dict) -> dict:
    keys = ("question_col", "option_a_col", "option_b_col", "option_c_col", "option_d_col",
            "correct_option_col")
    return {k: cols[k] for k in keys if k in cols}


def answerability(df, system_prompt, completer, out_col="gpt_answer", context_col="content_gpt",
                  include_correct_option=True, temperature=JUDGE_TEMPERATURE,
                  max_tokens=JUDGE_MAX_TOKENS, **cols):
    """Judge with the sheet as context; the correct option is included by
    default, as in the original criterion (so the answer leaks to the judge)."""
    return _judge(df, system_prompt, out_col, completer, temperature, max_tokens,
                  include_options=True, include_correct_option=include_correct_option,
                  context_col=context_col, **_names(cols))


def disclosure(df, system_prompt, completer, out_col="disclosure", temperature=JUDGE_TEMPERATURE,
               max_tokens=JUDGE_MAX_TOKENS, **cols):
    """Judge without options; the correct letter is still included."""
    return _judge(df, system_prompt, out_col, completer, temperature, max_tokens,
                  include_options=False, include_correct_option=True, **_names(cols))


def difficulty(df, system_prompt, completer, out_col="difficulty", temperature=JUDGE_TEMPERATURE,
               max_tokens=JUDGE_MAX_TOKENS, **cols):
    """Judge with options and answer (custom column names honoured)."""
    return _judge(df, system_prompt, out_col, completer, temperature, max_tokens,
                  include_options=True, include_correct_option=True, **_names(cols))


def distractors_quality(df, system_prompt, completer, out_col="distractors_quality",
                        temperature=JUDGE_TEMPERATURE, max_tokens=JUDGE_MAX_TOKENS, **cols):
    """Judge with options and answer."""
    return _judge(df, system_prompt, out_col, completer, temperature, max_tokens,
                  include_options=True, include_correct_option=True, **_names(cols))


# ----------------------------------------------------------- generation runs

def clean_sheets(sheets: DataFrame, completer: CompleterFactory, content_col: str = "content_cleaned",
                 out_col: str = "content_gpt", system_prompt: str = P.CLEANING_SYSTEM_PROMPT,
                 temperature: float = CLEANING_TEMPERATURE, store: str | None = None, retry_failed: bool = False) -> DataFrame:
    """Model-cleaned sheet text; a failed call leaves NULL (the row stays).  ``store``: see :func:`llm_map`."""
    return llm_map(sheets, P.cleaning_prompt(content_col), out_col, completer, system=system_prompt,
                   temperature=temperature, max_tokens=None, store=store, retry_failed=retry_failed)


def generate_questions(sheets: DataFrame, completer: CompleterFactory, content_col: str = "content_gpt",
                       temperatures=GENERATION_TEMPERATURES, out_col: str = "response",
                       wide: bool = False, store: str | None = None, retry_failed: bool = False) -> DataFrame:
    """One generation per sheet and temperature.

    Long form ``(..., temperature, response)`` by default; ``wide=True``
    pivots to one ``generated_questions_<t>`` column per temperature.
    ``store`` keeps the raw answers (see :func:`llm_map`).
    """
    runs = sheets.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    long = llm_map(runs, P.generation_prompt(content_col), out_col, completer,
                   temperature="temperature", max_tokens=None, store=store, retry_failed=retry_failed,
                   options={**GENERATION_OPTIONS,
                            "json_schema": record_schema(R.MCQ_FIELDS)})
    if not wide:
        return long
    keys = [c for c in sheets.columns if c != content_col]   # never group by the sheet text
    return (long.groupBy(*keys).pivot("temperature", [float(t) for t in temperatures])
            .agg(F.first(out_col))
            .withColumnsRenamed({str(float(t)): f"generated_questions_{t}" for t in temperatures}))


def answer_exam(items: DataFrame, completer: CompleterFactory, runs: dict[str, float] = EXAM_RUNS,
                out_col: str = "response", question_col: str = "question",
                opa: str = "opa", opb: str = "opb", opc: str = "opc", opd: str = "opd", store: str | None = None,
                retry_failed: bool = False) -> DataFrame:
    """The exam prompt answered once per run; long form with ``run`` and
    ``temperature`` columns.  Two runs at one temperature are samples of their
    own.  ``store`` keeps the raw answers (see :func:`llm_map`)."""
    pairs = F.array(*[F.struct(F.lit(label).alias("run"), F.lit(float(t)).alias("temperature"))
                      for label, t in runs.items()])
    exploded = items.withColumn("_run", F.explode(pairs)).select("*", "_run.run", "_run.temperature").drop("_run")
    return llm_map(exploded, P.exam_prompt(question_col, opa, opb, opc, opd), out_col, completer,
                   temperature="temperature", max_tokens=EXAM_MAX_TOKENS, store=store, retry_failed=retry_failed,
                   options={**EXAM_OPTIONS,
                            "json_schema": record_schema((R.ANSWER_FIELD,))})


def model_answers(df: DataFrame, response_col: str = "response", out_col: str = "model_answer",
                  first_letter: bool = False) -> DataFrame:
    """R2 + P8 + P7: validated answer letter, upper-cased and remapped."""
    v = R.validate_answer_json(df, response_col, "_answer")
    v = v.withColumn("_answer_option", F.col("_answer")[R.ANSWER_FIELD])
    v = R.remap_values(R.normalise_answer(v, "_answer_option", out_col), out_col)
    if first_letter:
        v = R.normalise_answer(v, out_col, out_col, first_letter=True)
    return v.drop("_answer", "_answer_option")
