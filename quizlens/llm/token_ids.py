"""Token ids of a corpus as directly addressable codes.

Documents are range-partitioned and sorted by id; each task encodes its
documents and writes them as codes of bounded size (see
:mod:`quizlens.llm.dac`), one binary value a row of an uncompressed Parquet
folder, so Spark's commit protocol covers lost executors and any file system
that Spark writes will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizlens.llm import dac
from quizlens.llm.common import ready, shuffle_width
from quizlens.llm.tokens import encoder, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: A code is closed once it holds this many ids; a document is never split.
CODE_IDS = 1 << 18
FILE_SCHEMA = "part int, seq int, first long, n_ids long, n_docs int, low long, high long, code binary"
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                    ("n_docs", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("code", pa.binary())])


def _writer(path: str, cut: str | None, end_id: int):
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, ids, held = [], [], 0

        def code():
            known = [d for d in doc_ids if d is not None]
            row = [part, seq, first, held, len(ids), min(known, default=None), max(known, default=None),
                   dac.encode(doc_ids, ids, first)]
            return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, row))], schema=_ARROW)

        for batch in batches:
            for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), encoder(path, cut).encode(batch.column("text"))):
                doc_ids.append(doc_id)
                ids.append(encoded + end)
                held += len(encoded) // 4 + 1
                if held >= CODE_IDS:
                    yield code()
                    first, seq = first + held, seq + 1
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield code()

    return write


def write_token_ids(docs: DataFrame, path: str, tokenizer: str | None = None, cut: str | None = "words",
                    end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, in ascending order of document id, to the folder ``path``.

    Null texts count as empty and get the end id alone.  Null ids come first;
    rows that repeat an id are all written, by their texts' hash and bytes.
    An empty table gives an empty folder.  Other columns are not read.
    """
    spark = ready(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = (rows.repartitionByRange(shuffle_width(spark), "doc_id", tie)
               .sortWithinPartitions("doc_id", tie, "text"))
    (ordered.mapInArrow(_writer(tokenizer or tokenizer_path(TOKENIZER), cut, end_id), FILE_SCHEMA)
     .write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path))


def _codes(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a folder with ``base``, the place of each part's first id.

    One row a part is summed up in one place.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return files.join(F.broadcast(bases), "part")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, code in zip(batch.column("base").to_pylist(), batch.column("code")):
            reader = dac.Reader(code.as_buffer())
            # The whole code at once is cheaper here than document after document.
            whole, stops = memoryview(reader.slice(0, reader.n_ids).tobytes()), (4 * reader.starts.astype(np.int64)).tolist()
            ids = [whole[a:b] for a, b in zip(stops, stops[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array([reader.doc_id(k) for k in range(reader.n_docs)], pa.int64()),
                pa.array(reader.starts[:-1].astype("<i8") + (base + reader.first), pa.int64()),
                pa.array([len(b) // 4 for b in ids], pa.int64()),
                pa.array([zlib.crc32(b) for b in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document of a folder, from its codes."""
    return _codes(spark, path).select("base", "code").mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_at(spark: SparkSession, path: str, places: DataFrame, place_col: str = "place") -> DataFrame:
    """``(place, id)``: the token id at each given place of the whole corpus.

    Codes and places meet by the code's range of places (each place lies in
    one code; a code spans few blocks of places), and only the codes asked
    for are opened.  Places outside of the corpus give no row.
    """
    ready(places)
    block = CODE_IDS
    codes = _codes(spark, path).withColumn("from", F.col("base") + F.col("first")).withColumn(
        "block", F.explode(F.expr(f"sequence(`from` div {block}, (`from` + n_ids - 1) div {block})")))
    asked = places.select(F.col(place_col).cast("long").alias("place"))
    asked = asked.withColumn("block", F.expr(f"place div {block}"))
    met = codes.select("block", "from", "n_ids", "code").join(asked, "block").where(
        (F.col("place") >= F.col("from")) & (F.col("place") < F.col("from") + F.col("n_ids")))

    def look_up(batches):
        for batch in batches:
            out = [dac.Reader(c.as_buffer()).at(p - f) for f, p, c in zip(
                batch.column("from").to_pylist(), batch.column("place").to_pylist(), batch.column("code"))]
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(out, pa.int64())], names=["place", "id"])

    return met.select("place", "from", "code").mapInArrow(look_up, "place long, id long")
