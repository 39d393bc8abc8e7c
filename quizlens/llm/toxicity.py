"""Toxicity by compression distance to two zstandard dictionaries.

Each class has a dictionary: a part in common (passages of ordinary text, so
that what every text has costs the same with both) and the words that are
characteristic of the class.  A text is cut into windows at white space; a
window's evidence is the length it compresses to with the ordinary dictionary
less that with the toxic one.  Thresholds on the evidence of all windows of a
text are calibrated into a probability on labelled texts that the
dictionaries were not made from.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import hash32, ready

WINDOW = 96
LEVEL = 3
COMMON_BYTES = 32_768
CLASS_BYTES = 1_536
THRESHOLD = 0.3
#: The fit's sample: most labelled documents of each class for the dictionaries, most for the
#: calibration, and the longest text that is used to fit.  Scores are given to every whole text.
TOXIC_SAMPLE, ORDINARY_SAMPLE, CALIBRATION_SAMPLE, LONGEST_SAMPLE = 2_000, 4_000, 6_000, 100_000
#: Characters of the sample for each document it may have; the sample ends where they are used up.
MEAN_SAMPLE = 5_000
#: A characteristic word: contexts in its class at least, log odds at least, and those in standard errors.
MIN_CONTEXTS, MIN_LOG_ODDS, MIN_ERRORS, MIN_LENGTH = 5, 2.5, 3.0, 4
SEED = 9

_WINDOWS = re.compile(rb"\S.{0,%d}\S(?!\S)|\S+" % (WINDOW - 2), re.S)
_WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False,
                                    write_dict_id=False)


@dataclass
class Model:
    """Two dictionaries and the calibration of their evidence; without dictionaries, a constant score."""

    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    base: float = 0.0

    def features(self, text: bytes) -> list[float]:
        """Thresholds and sums of the evidence of a whole text's windows."""
        toxic, ordinary = _compressor(self.toxic).compress, _compressor(self.ordinary).compress
        v = np.array([len(ordinary(w)) - len(toxic(w)) for w in _WINDOWS.findall(text)] or [0])
        top = np.sort(np.partition(v, -3)[-3:])[::-1] if len(v) > 3 else np.sort(v)[::-1]
        return [top[0], top.mean(), v.mean(), (v >= 3).mean(), (v >= 4).mean(), np.maximum(v - 3, 0).mean(),
                math.log(len(v)), math.log1p((v >= 4).sum())]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.toxic:
            return np.full(len(texts), self.base)
        x = np.array([self.features((t or "").encode("utf-8", "surrogatepass").lower()) for t in texts],
                     dtype=float).reshape(len(texts), -1)
        return _logistic((x - self.mean) / self.scale, self.weights)


def _logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton's method; the ridge keeps it finite where the classes part."""
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = _logistic(x, w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words by hash, and their number of distinct (word before, word, word after).

    Contexts and not texts are counted: copies of a text add nothing.
    """
    words, around = [], []
    for text in texts:
        found = _WORDS.findall(text)
        if not found:
            continue
        h = np.fromiter(map(hash, found), dtype=np.int64, count=len(found)).view(np.uint64)
        pad = np.concatenate([[np.uint64(0)], h, [np.uint64(0)]])
        words.append(h)
        around.append(h * np.uint64(0x9E3779B97F4A7C15) ^ pad[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) ^ pad[2:] * np.uint64(0x165667B19E3779F9))
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    _, first = np.unique(np.concatenate(around), return_index=True)
    return np.unique(np.concatenate(words)[first], return_counts=True)


def characteristic_words(texts: list[bytes], others: list[bytes]) -> list[bytes]:
    """Words that one class has far more contexts of than the other, the surest first."""
    (h, n), (g, m) = _contexts(texts), _contexts(others)
    if not len(h):
        return []
    at = np.searchsorted(g, h)
    there = np.append(g, 0)[at] == h
    other = np.where(there, np.append(m, 0)[at], 0)
    odds = np.log((n + 0.5) / (n.sum() + 1) * (m.sum() + 1) / (other + 0.5))
    errors = odds / np.sqrt(1 / (n + 0.5) + 1 / (other + 0.5))
    good = (n >= MIN_CONTEXTS) & (odds >= MIN_LOG_ODDS) & (errors >= MIN_ERRORS)
    chosen = dict(zip(h[good].view(np.int64).tolist(), errors[good].tolist()))
    # The words themselves are looked up again: few are wanted.
    found = {w: chosen[hash(w)] for t in texts for w in set(_WORDS.findall(t)) if hash(w) in chosen}
    return sorted((w for w in found if len(w) >= MIN_LENGTH), key=lambda w: (-found[w], w))


def train(sample: pd.DataFrame) -> Model:
    """A model from rows of (text, toxic, part), part ``dictionary`` or ``calibration``."""
    sample = sample.assign(text=[t.encode("utf-8", "surrogatepass").lower() for t in sample["text"]])
    made = sample[sample["part"] == "dictionary"]
    toxic, ordinary = list(made.loc[made["toxic"] == 1, "text"]), list(made.loc[made["toxic"] == 0, "text"])
    rest = sample[sample["part"] == "calibration"]
    if len(rest) < 20 or not 0 < rest["toxic"].sum() < len(rest):
        rest = sample  # too few labels to hold any back
    base = float(rest["toxic"].mean()) if len(rest) else 0.0
    if not toxic or not ordinary:
        return Model(base=base)
    rng = np.random.default_rng(SEED)
    passages = [p for t in ordinary for p in rng.permutation(np.array(_WINDOWS.findall(t), dtype=object))[:4]]
    shared = b" ".join(passages)
    own = {}
    for kind, words in (("toxic", characteristic_words(toxic, ordinary)), ("ordinary", characteristic_words(ordinary, toxic))):
        own[kind] = b" ".join(reversed(words))[-CLASS_BYTES:]  # the surest last, which is nearest to the window
    longest = max(map(len, own.values()))
    filler = shared[COMMON_BYTES:COMMON_BYTES + longest]
    content = {k: shared[:COMMON_BYTES] + b" " + (filler + b" " + v)[-longest:] if longest else shared[:COMMON_BYTES] for k, v in own.items()}
    model = Model(content["toxic"], content["ordinary"], base=base)
    x = np.array([model.features(t) for t in rest["text"]], dtype=float)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _calibrate((x - model.mean) / model.scale, rest["toxic"].to_numpy(dtype=float))
    return model


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; labels of remainder 2 are never learned from."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4).cast("int")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on a bounded sample of labelled documents, chosen by a hash of the id.

    Remainders 0 and 1 of :func:`fold` make the dictionaries, remainder 3
    calibrates.  Repeated labels of an id count once (toxic if any says so),
    null labels not at all.  Of the texts of a repeated id the one with the
    least hash is read.  Without labels of both classes the score is the share
    of toxic labels, or 0.
    """
    known = (labels.where(F.col("toxic").isNotNull()).select(F.col(id_col).cast("long").alias("id"), "toxic")
             .groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .withColumns({"fold": fold("id"), "order": hash32(SEED, F.col("id").cast("string"))}))

    def some(rows: DataFrame, kind: int, n: int) -> DataFrame:
        return rows.orderBy("order", "id").limit(n).select("id", "toxic", "order", F.lit(kind).alias("kind"), F.lit(n).alias("most"))

    made = known.where("fold in (0, 1)")
    # At most TOXIC_SAMPLE + ORDINARY_SAMPLE + CALIBRATION_SAMPLE ids.
    ids = (some(made.where("toxic = 1"), 1, TOXIC_SAMPLE).union(some(made.where("toxic = 0"), 0, ORDINARY_SAMPLE))
           .union(some(known.where("fold = 3"), 2, CALIBRATION_SAMPLE)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    # One text an id, then as many as the characters allow: both are settled before any text is collected.
    one = (rows.where(F.length("text") <= LONGEST_SAMPLE).join(F.broadcast(ids), "id").groupBy("id", "toxic", "order", "kind", "most")
           .agg(F.min(F.struct("h", F.length("text").alias("chars"))).alias("text")))
    held = F.sum("text.chars").over(Window.partitionBy("kind").orderBy("order", "id"))
    chosen = one.withColumn("held", held).where(F.col("held") <= F.col("most") * MEAN_SAMPLE).select("id", "toxic", "kind", F.col("text.h").alias("h"))
    sample = rows.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["id", "h"]).drop("h").toPandas()
    sample["part"] = np.where(sample.pop("kind") == 2, "calibration", "dictionary")
    # A fixed order, whatever order the rows came in.
    return train(sample.sort_values(["part", "id", "text"]))


def score_column(model: Model, text_col: str = "text") -> Column:
    """Probability that a text is toxic, from its characters alone; null and empty texts get a score too."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()))

    return score(F.col(text_col).cast("string"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    Every whole text is scored; null counts as empty.  Equal texts score
    alike.  A null id is not held out.  Empty tables: see :func:`fit`; empty
    ``docs`` give an empty result.  Other columns are not read.
    """
    ready(docs)
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == 2).alias("held_out"),
                       score_column(model, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    ready(docs)
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), score_column(model, text_col).alias("score"))
    return rows.where(F.col("score") < threshold).select("row.*")
