"""Divergence of the sources of each language by their terms, by chunk factorization.

Texts are cut at white space, and the chunks of each document are counted where
the document is read.  Counts are added up by (chunk, group of language and
source); each globally distinct chunk is then cut into terms once, and its
terms take over its counts.  How many documents hold a term is exact: a chunk
in three documents settles its terms, and a rarer chunk carries its one or two
documents, so those of several chunks (``word,`` and ``word.``) are told apart.

Kept terms then lie in one row each with their counts by source.  Sums over all
terms for all pairs of sources are built up in each task as one matrix a
language, in blocks of sources, so no pair is ever a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import ready, shuffle_width, staged
from quizlens.plans.sizing import broadcast_if_small

MIN_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Bytes of text whose chunks are added up at a time, rows of terms, and cells of the matrices of pairs.
STEP_BYTES, STEP_ROWS, CELLS = 16_000_000, 400_000, 2_000_000
#: Sources of a language that one matrix has rows for.
BLOCK = 512

_CHUNKS = "chunk string, gid long, n long, docs long, lo long, hi long"
_TERMS = "lang string, term string, gid long, n long, many boolean, docs array<bigint>"
#: Runs of ASCII letters and of anything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences, documents, and the least and greatest document of every (chunk, group) of some documents."""
    for table in _steps(batches, lambda b: pc.sum(pc.binary_length(b.column(2))).as_py() or 0, STEP_BYTES):
        doc, gid, texts = (table.column(k).combine_chunks() for k in range(3))
        lists = pc.ascii_split_whitespace(texts)
        ends = lists.offsets.to_numpy()
        numbered = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        names, codes = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
        del lists
        width = max(1, len(names))
        pairs, n = np.unique(np.repeat(np.arange(len(texts)), np.diff(ends)) * width + codes, return_counts=True)
        row, code = np.divmod(pairs, width)
        groups, of = np.unique(gid.to_numpy(), return_inverse=True)
        docs = doc.to_numpy()[row]
        # By (group, chunk); documents ascend within, as rows are numbered in order.
        order = np.lexsort((docs, code, of[row]))
        both = (of[row] * width + code)[order]
        heads = np.flatnonzero(np.diff(both, prepend=-1))
        tails = np.append(heads[1:], len(both)) - 1
        if not len(heads):
            continue
        out = pa.RecordBatch.from_arrays(
            [names.take(pa.array(both[heads] % width)), pa.array(groups[both[heads] // width]), pa.array(np.add.reduceat(n[order], heads)),
             pa.array(tails - heads + 1), pa.array(docs[order][heads]), pa.array(docs[order][tails])],
            names=["chunk", "gid", "n", "docs", "lo", "hi"])
        yield from pa.Table.from_batches([out.filter(pc.not_equal(out.column(0), ""))]).to_batches(max_chunksize=100_000)


def _steps(batches: Iterator[pa.RecordBatch], weight, limit: int) -> Iterator[pa.Table]:
    """Batches put together, or cut, to about ``limit``; one row may be more."""
    held, total = [], 0
    for whole in batches:
        parts = [whole]
        while parts:
            batch = parts.pop()
            size = weight(batch)
            if size > limit and batch.num_rows > 1:
                half = batch.num_rows // 2
                parts += [batch.slice(half), batch.slice(0, half)]
                continue
            if held and total + size > limit:
                yield pa.Table.from_batches(held)
                held, total = [], 0
            held.append(batch)
            total += size
    if held:
        yield pa.Table.from_batches(held)


def _merge_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up rows (lang, term, gid, n, docs, lo, hi), one a chunk, to one a (term, group) of some rows."""
    for table in _steps(batches, lambda b: b.num_rows, STEP_ROWS):
        langs = table.column(0).combine_chunks().dictionary_encode()
        terms = table.column(1).combine_chunks().dictionary_encode()
        gid, n, docs, lo, hi = (table.column(k).combine_chunks().to_numpy() for k in range(2, 7))
        groups, of = np.unique(gid, return_inverse=True)
        lang_of = np.zeros(len(groups), np.int64)
        lang_of[of] = langs.indices.to_numpy()
        both = terms.indices.to_numpy().astype(np.int64) * len(groups) + of
        found, which = np.unique(both, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, which, n)
        many = np.zeros(len(found), bool)
        many[which[docs >= MIN_DOCUMENTS]] = True
        # Documents of the rest: distinct (term and group, document).
        rare = (docs < MIN_DOCUMENTS) & ~many[which]
        owner, doc = np.concatenate([which[rare], which[rare]]), np.concatenate([lo[rare], hi[rare]])
        order = np.lexsort((doc, owner))
        owner, doc = owner[order], doc[order]
        new = np.append(True, (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])) if len(owner) else np.zeros(0, bool)
        owner, doc = owner[new], doc[new]
        number = np.bincount(owner, minlength=len(found))
        many |= number >= MIN_DOCUMENTS
        kept = ~many[owner]
        owner, doc = owner[kept], doc[kept]
        ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(found))))
        term, group = np.divmod(found, len(groups))
        out = pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(lang_of[group])), terms.dictionary.take(pa.array(term)), pa.array(groups[group]), pa.array(total),
             pa.array(many), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(doc))],
            names=["lang", "term", "gid", "n", "many", "docs"])
        yield from pa.Table.from_batches([out]).to_batches(max_chunksize=100_000)


def _per_billion(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (n + 1) / whole), three digits at a time, so that nothing overflows."""
    rest, out = n + 1, np.zeros_like(n + whole)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def _pair_sums(places: dict[str, tuple[list[int], list[int]]], size: int):
    """Sums of f over kept terms, by language, source and other source; ``places``: gids and N + V of a language's sources.

    A matrix has rows for ``size`` sources, a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        block = None
        for batch in batches:
            for lang, part in _by_value(batch, 0):
                gids, wholes = places[lang]
                number, wholes = np.array(gids), np.array(wholes, np.int64)
                for part_block, rows in _by_value(part, 1):
                    if block != part_block or lang not in sums:  # sorted by language and block
                        yield from _matrices(sums, block, size, places)
                        sums, block = {lang: np.zeros((min(size, len(gids) - part_block * size), len(gids)), np.int64)}, part_block
                    lists, first = rows.column(2), block * size
                    ends = lists.offsets.to_numpy()
                    cells = lists.values.slice(ends[0], ends[-1] - ends[0])
                    ends = ends - ends[0]
                    at, n = np.searchsorted(number, cells.field(0).to_numpy()), cells.field(1).to_numpy()
                    height = sums[lang].shape[0]
                    some = max(1, CELLS // (len(gids) * height))
                    for k in range(0, len(lists), some):
                        a, b = ends[k], ends[min(k + some, len(lists))]
                        count = np.zeros((min(some, len(lists) - k), len(gids)), np.int64)
                        count[np.repeat(np.arange(len(count)), np.diff(ends[k:k + len(count) + 1])), at[a:b]] = n[a:b]
                        p = _per_billion(count, wholes)
                        d = p[:, first:first + height, None] - p[:, None, :]
                        sums[lang] += (d * d // p[:, None, :]).sum(axis=0)
        yield from _matrices(sums, block, size, places)

    return run


def _by_value(batch: pa.RecordBatch, column: int) -> Iterator[tuple]:
    """Runs of equal values of a sorted column."""
    codes = batch.column(column).dictionary_encode()
    which = codes.indices.to_numpy()
    heads = np.flatnonzero(np.diff(which, prepend=-1)).tolist()
    for a, b in zip(heads, heads[1:] + [len(which)]):
        yield codes.dictionary[which[a]].as_py(), batch.slice(a, b - a)


def _matrices(sums: dict[str, np.ndarray], block: int | None, size: int, places: dict) -> Iterator[pa.RecordBatch]:
    for lang, matrix in sums.items():
        gids = np.array(places[lang][0])
        a, b = np.nonzero(np.ones(matrix.shape, bool))
        yield pa.RecordBatch.from_arrays([pa.array(gids[block * size + a]), pa.array(gids[b]), pa.array(matrix.ravel())],
                                         names=["gid", "other", "value"])


def term_counts(docs: DataFrame, groups: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``(lang, term, total, cells)`` of every term that a language keeps; ``cells`` holds (gid, n) of each source with it."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("text"))
    small, _ = broadcast_if_small(groups)
    counted = (rows.where("text is not null").join(small, ["lang", "source"]).select("doc", "gid", "text").mapInArrow(_count_chunks, _CHUNKS))
    # All rows of a chunk meet in one task: at most one a group and step, whatever the chunk.
    chunks = (counted.repartition(width, "chunk").groupBy("chunk", "gid")
              .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
              .groupBy("chunk").agg(F.collect_list(F.struct("gid", "n", "docs", "lo", "hi")).alias("cells")))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = F.regexp_extract_all(F.translate("chunk", upper, upper.lower()), F.lit(TERM), F.lit(0))
    names = groups.select("gid", "lang")
    names, _ = broadcast_if_small(names)
    # A term that a chunk holds twice takes over the chunk's counts twice, and its documents are the same ones.
    cells = (chunks.select(F.explode(terms).alias("term"), "cells").select("term", F.explode("cells").alias("c")).select("term", "c.*")
             .join(names, "gid").select("lang", "term", "gid", "n", "docs", "lo", "hi"))
    few = F.size(F.array_distinct(F.flatten(F.collect_list("docs"))))
    many = F.max("many")
    merged = (cells.mapInArrow(_merge_terms, _TERMS).repartition(width, "lang", "term").groupBy("lang", "term", "gid")
              .agg(F.sum("n").alias("n"), F.when(many, F.lit(MIN_DOCUMENTS)).otherwise(few).alias("docs")))
    return (merged.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("gid", "n")).alias("cells"))
            .where(F.col("docs") >= MIN_DOCUMENTS).drop("docs"))


def _share(n: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / whole), exactly."""
    wide = (n + F.lit(1)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, whole.cast("decimal(19,0)")) + F.lit(1)


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", top: int = TOP_TERMS,
          block: int = BLOCK) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for every source of a language its divergence from each other one,
    and its most typical terms.

    A language keeps the terms of at least three of its documents (rows).  A
    source gives each of them p = 1 + floor(10^9 (n + 1) / (N + V)), from n
    occurrences of N in the source and V kept terms; so does the language.  Part
    ``pair`` sums f = floor((p - q)^2 / q) over all kept terms, q being the
    other source's; part ``term`` has f against the language's q for the terms
    with p > q, the first ``top`` ranks.  Ranks go by value, then by item.

    Nulls of text, language and source count as empty; a source without terms
    has its pairs all the same.  Empty tables give an empty result; other
    columns are not read.
    """
    spark = ready(docs)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    groups = staged(docs.select(*text).distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    kept = staged(term_counts(docs, groups, text_col, lang_col, source_col), "kept-terms")
    per_group = kept.select(F.explode("cells").alias("c")).groupBy("c.gid").agg(F.sum("c.n").alias("n"))
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    zero = F.lit(0).cast("long")
    sizes = staged(groups.join(per_group, "gid", "left").join(per_lang, "lang", "left").select(
        "lang", "source", "gid", (F.coalesce("n", zero) + F.coalesce("v", zero)).alias("whole"),
        (F.coalesce("n_lang", zero) + F.coalesce("v", zero)).alias("whole_lang"), F.col("v").isNotNull().alias("has")), "sizes")

    # One entry a (language, source): as many as the rows and columns of the result's pairs.
    places: dict[str, tuple[list[int], list[int]]] = {}
    for r in sizes.where("has").orderBy("lang", "gid").select("lang", "gid", "whole").toLocalIterator():
        gids, wholes = places.setdefault(r["lang"], ([], []))
        gids.append(r["gid"])
        wholes.append(r["whole"])
    blocks = {lang: -(-len(gids) // block) for lang, (gids, _) in places.items()}
    most = F.lit(max(blocks.values(), default=1))
    several = {lang: n for lang, n in blocks.items() if n > 1}
    last = F.coalesce(F.create_map(*[F.lit(x) for pair in several.items() for x in pair])[F.col("lang")], F.lit(1)) if several else F.least(most, F.lit(1))
    pairs = (kept.select("lang", F.explode(F.sequence(F.lit(0), last - 1)).alias("block"), "cells").sortWithinPartitions("lang", "block")
             .mapInArrow(_pair_sums(places, block), "gid long, other long, value long").groupBy("gid", "other").agg(F.sum("value").alias("value")))
    left, right = sizes.alias("a"), sizes.alias("b")
    both = (left.join(right, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.gid") != F.col("b.gid")))
            .select("a.lang", "a.source", F.col("b.source").alias("item"), F.col("a.gid").alias("gid"), F.col("b.gid").alias("other"))
            .join(pairs, ["gid", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))

    small, _ = broadcast_if_small(sizes.select("gid", "source", "whole", "whole_lang"))
    p, q = _share(F.col("n"), F.col("whole")), _share(F.col("total"), F.col("whole_lang"))
    terms = (kept.select("lang", F.col("term").alias("item"), "total", F.explode("cells").alias("c")).select("lang", "item", "total", "c.gid", "c.n")
             .join(small, "gid").select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), "item", _value(F.col("p"), F.col("q")).alias("value")))
    out = both.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
