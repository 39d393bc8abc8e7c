"""The pipeline against its stages by brute force, over the small tables."""

from collections import Counter, defaultdict

import corpus_pipeline
from conftest import SF_SMALL
from quizlens.llm import mixing, simhash, toxicity
from quizlens.llm.tokens import Encoder, tokenizer_path


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_run(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = docs.collect()
    # 1. The model is the operator's; what it rejects goes.
    model = toxicity.fit(docs, labels)
    rows = [r for r, s in zip(rows, model.score([r["text"] for r in rows])) if s < toxicity.THRESHOLD]
    # 2. Of equal texts, the largest id.
    lower = {b: b + 32 for b in range(65, 91)}
    best = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        best[r["text"].translate(lower)] = r
    rows = list(best.values())
    # 3. Of linked fingerprints, the smallest id.
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in rows}
    left, kept = sorted(prints), set()
    while left:
        group, todo = set(), [left[0]]
        while todo:
            i = todo.pop()
            group.add(i)
            todo += [j for j in left if j not in group and j not in todo and (prints[i] ^ prints[j]).bit_count() <= 3]
        kept.add(min(group))
        left = [i for i in left if i not in group]
    rows = [r for r in rows if r["doc_id"] in kept]
    # 4. As many copies as the plan says.
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(spark.createDataFrame(rows, docs.schema)).collect()}
    encoder = Encoder(tokenizer_path("byte_bpe_50k.json"), None)
    tokens = {r["doc_id"]: len(next(encoder.encode([r["text"]]))) // 4 + 1 for r in rows}
    # 5. All their tokens are packed, once for each copy.
    got, sequences = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF_SMALL).collect():
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == Counter({i: n * tokens[i] for i, n in plan.items() if n})
    for places in sequences.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
