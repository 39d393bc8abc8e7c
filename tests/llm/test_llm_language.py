"""Language identification and source divergence against plain statements of the same rules."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import odd_rows
from conftest import SF_SMALL
from quizlens.llm import catalog, divergence, language_id, oracle_sql
from quizlens.llm.language_id import LONGEST_WORD, ORDERS, PENALTY, Model


def plain_words(text):
    return [run[k:k + LONGEST_WORD] for run in re.findall(r"[^\W\d_]+", text.lower()) for k in range(0, len(run), LONGEST_WORD)]


def plain_grams(word, order):
    padded = f" {word} "
    return [g for k in range(len(padded) - order + 1) if (g := padded[k:k + order]) != " "]


class Plain:
    """The model by dictionaries; ``most`` keeps whole levels of the highest counts."""

    def __init__(self, rows, words_kept=10**9, grams_kept=10**9):
        words, grams = defaultdict(Counter), defaultdict(Counter)
        for text, lang in rows:
            for w in plain_words(text):
                words[lang][w] += 1
                for o in ORDERS:
                    grams[lang, o].update(plain_grams(w, o))
        self.langs = sorted(words, key=lambda x: (-words[x].total(), x))
        self.words, self.grams = words, grams
        self.known = set().union(*(self.most(words[x], words_kept) for x in self.langs))
        self.known_grams = {o: set().union(*(self.most(grams[x, o], grams_kept) for x in self.langs)) for o in ORDERS}

    @staticmethod
    def most(counts, most):
        levels = Counter(math.floor(8 * math.log2(n)) for n in counts.values())
        total, cut = 0, math.inf
        for level in sorted(levels, reverse=True):
            total += levels[level]
            if total > most:
                break
            cut = level
        return {x for x, n in counts.items() if math.floor(8 * math.log2(n)) >= cut}

    @staticmethod
    def cost(counts, x):
        return min(PENALTY, -math.log10(counts[x] / counts.total())) if counts[x] else PENALTY

    def word(self, w):
        if w in self.known:
            return [self.cost(self.words[x], w) for x in self.langs]
        for o in ORDERS:
            some = plain_grams(w, o)
            if any(g in self.known_grams[o] for g in some):
                return [sum(self.cost(self.grams[x, o], g) if g in self.known_grams[o] else PENALTY for g in some) / len(some)
                        for x in self.langs]
        return [PENALTY] * len(self.langs)

    def text(self, text):
        if not any(map(str.isalpha, text)):
            return "und", 0.0
        sums = [sum(x) for x in zip(*(self.word(w) for w in plain_words(text)))] or [0.0] * len(self.langs)
        best = min(range(len(sums)), key=sums.__getitem__)
        return self.langs[best], 1 / sum(10 ** -min(s - sums[best], 300) for s in sums)


def held(doc_id):
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 4 == 2


@pytest.mark.parametrize("kept", [(10**6, 10**6), (60, 30)])
def test_model_by_brute_force(spark, kept):
    docs = odd_rows.table(spark).unionByName(spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).select(*odd_rows.table(spark).columns))
    docs = docs.persist()
    rows = docs.collect()
    plain = Plain([(r["text"], r["lang"]) for r in rows if not held(r["doc_id"]) and r["text"] is not None and r["lang"] is not None], *kept)
    model = language_id.fit(docs, words_kept=kept[0], grams_kept=kept[1])
    assert model.langs == plain.langs
    some = ["", "one two", "thing zzqx", "über straße", "日本", "qqq", "a1b2", *(r["text"] or "" for r in rows)]
    names, scores = model.predict(pa.array(some))
    for text, name, score in zip(some, names, scores.tolist()):
        want, share = plain.text(text)
        assert score == pytest.approx(share, abs=1e-9)
        assert name == want or share == pytest.approx(0.5, abs=1e-6)
    docs.unpersist()


def test_words_and_grams():
    texts = ["", " Ab, cd-EF3g ", "x" * 90, "Éa ñ_1"]
    got = [[w for w in x if w] for x in language_id.words(pa.array(texts)).to_pylist()]
    assert got == [plain_words(t) for t in texts]
    words = ["ab", "a", "abcdefgh"]
    for order in ORDERS:
        keys, owner = language_id.grams(words, order)
        assert Counter(owner.tolist()) == Counter({k: len(plain_grams(w, order)) for k, w in enumerate(words) if plain_grams(w, order)})
        assert len(set(keys.tolist())) == len({g for w in words for g in plain_grams(w, order)})


def test_most_frequent_keeps_whole_levels(spark):
    counts = spark.createDataFrame([("a", str(k), k) for k in range(1, 101)] + [("b", str(k), 1) for k in range(50)], "lang string, word string, n long")
    kept = defaultdict(set)
    for r in language_id.most_frequent(counts, ["lang"], 20).collect():
        kept[r["lang"]].add(r["n"])
    assert 10 < len(kept["a"]) <= 20 and min(kept["a"]) > max(set(range(1, 101)) - kept["a"]) and "b" not in kept


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = catalog.QUERIES["op13_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out and lang is not null")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 200 and right / n > 0.99


def test_held_out_languages_are_not_learned(spark):
    ids = [k for k in range(400) if held(k)]
    docs = spark.createDataFrame([(i, "alpha beta", "x") for i in ids] + [(k, "gamma delta", "y") for k in range(400) if not held(k)],
                                 "doc_id long, text string, lang string")
    assert language_id.fit(docs).langs == ["y"]
    assert {r["lang_pred"] for r in language_id.predicted(docs, language_id.fit(docs)).collect()} == {"y"}


def test_no_training_rows():
    assert Model().predict(pa.array(["some text", ""]))[0] == ["und", "und"]


# ---------------------------------------------------------------- divergence

def plain_divergence(rows):
    docs = [((r["lang"] or ""), (r["source"] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))) for r in rows]
    frequency, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        frequency[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in frequency[lang].items() if n >= 3]
        sources = sorted({d[1] for d in docs if d[0] == lang})
        whole = {s: sum(counts[lang, s][t] for t in kept) + len(kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // whole[s] for t in kept} for s in sources}
        total = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (total[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])}
    return out


def variants():
    """Terms in few documents behind many chunks, in the same one and in different ones."""
    rows = [("rare, rare. (rare) a1rare", "en", "a"), ("Rare! other", "en", "a"), ("RARE? other:", "en", "b"), ("twice-twice twice", "en", "a"),
            ("twice; x", "en", "b"), ("x.x,x x", "en", None), ("Ünï x é", "en", "b"), (None, "en", "empty"), ("lone", None, "a"), ("lone", None, "a"),
            ("lone, three", None, "b"), ("", "none", "a"), ("", "none", "b"), ("1 2 3 ...", "none", "c"), ("K ſ x", "en", "c")]
    return rows + [(f"word{k}, the the{k}. {'w' * (k % 7)}", "en", f"s{k % 9}") for k in range(120)]


@pytest.mark.parametrize("block", [4, 512])
def test_divergence_by_brute_force(spark, block):
    docs = spark.createDataFrame(variants(), "text string, lang string, source string").repartition(5)
    got = [tuple(r) for r in divergence.audit(docs, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(docs.collect())


def test_divergence_in_small_steps(monkeypatch):
    """What a worker adds up at a time changes nothing."""
    rows = [(k, k % 3, t or "") for k, (t, _, _) in enumerate(variants())]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["doc", "gid", "text"])

    def total(limit):
        monkeypatch.setattr(divergence, "STEP_BYTES", limit)
        found = defaultdict(lambda: [0, 0, 10**9, -1])
        for b in divergence._count_chunks(iter([batch])):
            for chunk, gid, n, docs, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                f = found[chunk, gid]
                f[:] = f[0] + n, f[1] + docs, min(f[2], lo), max(f[3], hi)
        return found

    want = defaultdict(lambda: [0, 0, 10**9, -1])
    for doc, gid, text in rows:
        for chunk, n in Counter(text.split()).items():
            f = want[chunk, gid]
            f[:] = f[0] + n, f[1] + 1, min(f[2], doc), max(f[3], doc)
    want = {k: v for k, v in want.items()}
    # str.split() also cuts at white space beyond ASCII, which one text here holds.
    alike = lambda x: {k: v for k, v in x.items() if k[0].isascii()}
    assert alike(total(10**9)).keys() - alike(want).keys() <= {("x", 0), ("x", 1), ("x", 2)}
    assert dict(total(10**9)) == dict(total(50)) == dict(total(1))


def test_shares_do_not_overflow(spark):
    import numpy as np

    n, whole = [0, 5, 10**12, 9 * 10**14], [1, 7, 10**13, 9 * 10**15]
    want = [1 + 10**9 * (a + 1) // b for a, b in zip(n, whole)]
    assert divergence._per_billion(np.array(n), np.array(whole)).tolist() == want
    rows = spark.createDataFrame(list(zip(n, whole)), "n long, whole long")
    assert [r[0] for r in rows.select(divergence._share(F.col("n"), F.col("whole"))).collect()] == want


def test_divergence_sql_on_odd_rows(spark):
    con = duckdb.connect()
    con.register("documents", odd_rows.table(spark).toArrow())
    assert sorted(con.sql(oracle_sql.DIVERGENCE).select("lang, source, part, item, value, rank").fetchall()) == sorted(
        map(tuple, divergence.audit(odd_rows.table(spark)).collect()))
