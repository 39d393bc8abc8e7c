"""Sources and sinks (S1-S6): sheet trees, CSV, JSON record files, split
lists and prompt dictionaries.

Readers take explicit schemas (no inference).  Parquet is the format between
jobs; CSV/JSON exist for the files the toolkit exchanges with people.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens.session import ship_package

SHEETS_RAW_SCHEMA = "folder string, id string, content_raw string"
SHEETS_SCHEMA = "folder string, id string, content_gpt string"
MCQS_SCHEMA = ("id string, question string, option_a string, option_b string, option_c string, "
               "option_d string, correct_option string")
EXAM_SCHEMA = "id string, question string, cop string, opa string, opb string, opc string, opd string"

# CSV dialect shared by reader and writer: header row, RFC-4180 quoting
# (quotes doubled), text cells may span lines, white space around them is kept.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# Written once and read once or twice: the fast level already halves texts.
GZIP_OPTIONS = {"zlib.compress.level": "BEST_SPEED"}


def arrow_fs(uri: str):
    """(pyarrow filesystem, path) for a local path, ``file:`` URI or remote URI; names are as they are, not encoded."""
    from urllib.parse import quote

    from pyarrow import fs as pafs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    scheme, rest = uri.split("://", 1)
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return pafs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@?=&,+~')}")


LISTING = "folder string, name string, length long, modified long"
TEXTS = LISTING + ", content_raw string"
#: Texts a task holds before it passes them on, in bytes.
BATCH_BYTES = 8 * 1024 * 1024


def list_sheets(spark: SparkSession, root: str) -> DataFrame:
    """``(folder, name, length, modified)`` of every ``<root>/<folder>/<name>`` that ends in ``.txt``, listed by the executors.

    One task lists the root, then each folder is listed by one task.  Names
    that start with ``_`` or ``.`` and empty files count like others.
    ``modified`` is in nanoseconds, as exact as the filesystem keeps it.  A
    root that is not there is an error.
    """
    ship_package(spark)

    def infos(inside: str, kind: str):
        from pyarrow import fs as pafs

        filesystem, base = arrow_fs(root)
        return [i for i in filesystem.get_file_info(pafs.FileSelector(base + inside)) if i.type == getattr(pafs.FileType, kind)]

    def folders(batches):
        import pandas as pd

        for pdf in batches:
            for _ in pdf["id"]:
                yield pd.DataFrame({"folder": [i.base_name for i in infos("", "Directory")]}, dtype=object)

    def sheets(batches):
        import pandas as pd

        for pdf in batches:
            for folder in pdf["folder"]:
                rows = [(folder, i.base_name, i.size, i.mtime_ns or 0) for i in infos(f"/{folder}", "File") if i.base_name.endswith(".txt")]
                yield pd.DataFrame(rows, columns=["folder", "name", "length", "modified"])

    top = spark.range(0, 1, 1, 1).mapInPandas(folders, "folder string")
    return top.repartition(spark.sparkContext.defaultParallelism, "folder").mapInPandas(sheets, LISTING)


def read_listed(listed: DataFrame, root: str) -> DataFrame:
    """``listed`` (:func:`list_sheets`) with the text of each file, read where its row is; files gone meanwhile are left out."""

    def read(batches):
        import pandas as pd

        filesystem, base = arrow_fs(root)
        columns = ["folder", "name", "length", "modified"]
        for pdf in batches:
            rows, held = [], 0
            for row in pdf[columns].itertuples(index=False, name=None):
                try:
                    with filesystem.open_input_stream(f"{base}/{row[0]}/{row[1]}") as stream:
                        content = stream.read()
                except FileNotFoundError:
                    continue
                rows.append((*row, content.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")))
                held += len(content)
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=[*columns, "content_raw"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=[*columns, "content_raw"])

    return listed.mapInPandas(read, TEXTS)


def sheet_id(name_col: str = "name") -> Column:
    """The name of a sheet without its last extension; a name of nothing else is kept."""
    return F.regexp_replace(name_col, r"(?s)^(.*[^.].*)\.txt$", "$1")


def read_sheet_tree(spark: SparkSession, root: str) -> DataFrame:
    """One row per ``<root>/<folder>/<name>.txt`` file: folder, id, content_raw.

    Only ``.txt`` files directly inside first-level folders count; the id is
    the file name without its last extension; content is read whole (UTF-8),
    with ``\\r\\n`` and ``\\r`` as line ends turned into ``\\n``.  Empty files
    and names that start with ``_`` or ``.`` are read too, which Spark's own
    file sources pass over.  Executors list the folders and read the files,
    dealt by a hash of their names; a task holds a few files at a time.
    """
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = list_sheets(spark, root).repartition(width, "folder", "name")
    return read_listed(dealt, root).select("folder", sheet_id().alias("id"), "content_raw")


def read_csv_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A header CSV whose text cells may hold quotes and newlines."""
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def read_csv_header(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_csv_table`, with the columns of the file's own header, all strings."""
    return spark.read.options(**CSV_OPTIONS).csv(path)


def write_csv_table(df: DataFrame, path: str, mode: str = "overwrite", order_by: tuple[str, ...] = (),
                    compression: str | None = None) -> None:
    """Header CSV, no index column; NULLs and empty strings are both empty
    fields, which read back as NULL.

    With ``order_by`` (columns that are not written) the rows are dealt by
    ranges and sorted within them: the files, in the order of their names,
    hold the table in order, and no task sorts more than its range.
    ``compression`` names a codec (``gzip``) for the files; every reader here
    takes them by their extension.
    """
    if order_by:
        df = df.orderBy(*order_by).drop(*order_by)
    df.write.mode(mode).options(**CSV_OPTIONS, **GZIP_OPTIONS).csv(path, compression=compression)


def read_json_records(spark: SparkSession, path: str, schema: str | T.StructType,
                      multi_line: bool = True) -> DataFrame:
    """S3: JSON documents holding an array of record objects (or one object)."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def write_json_records(df: DataFrame, path: str) -> int:
    """Write each partition as one JSON document ``[ {...}, ... ]`` under ``path``.

    The inverse of :func:`read_json_records`; files are written by the tasks
    themselves (any filesystem pyarrow can open), nothing passes through the
    driver but one count per partition.
    """
    ship_package(df.sparkSession)
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("_json"))

    def write(partition, records):
        n, out = 0, None
        # One file per partition, named by the partition: a retried or
        # speculative attempt rewrites the same file, never adds one.  Rows
        # are streamed into it; an RDD hands them over in batches of some MB,
        # where Arrow would hold a fixed number of rows, however long.
        for row in records:
            if out is None:
                filesystem, base = arrow_fs(path)
                filesystem.create_dir(base, recursive=True)
                out = filesystem.open_output_stream(f"{base}/part-{partition:05d}.json")
            out.write((("[\n" if n == 0 else ",\n") + row["_json"]).encode("utf-8"))
            n += 1
        if out is not None:
            out.write(b"\n]\n")
            out.close()
        yield n

    return rows.rdd.mapPartitionsWithIndex(write).sum()


def _small_document(spark: SparkSession, path: str, kind: type):
    """A JSON document of a handful of entries, read on the driver; an error unless it is a whole ``kind``."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: one JSON document is needed, found {len(rows) or 'an empty file'}")
    value = json.loads(rows[0]["value"])
    if not isinstance(value, kind):
        raise ValueError(f"{path}: a JSON {kind.__name__} is needed")
    return value


def read_split_list(spark: SparkSession, path: str, col: str = "folder") -> DataFrame:
    """The names of a JSON array document, one row each; anything else is an error."""
    names = _small_document(spark, path, list)
    if not all(n is None or isinstance(n, str) for n in names):
        raise ValueError(f"{path}: the names must be strings")
    return spark.createDataFrame([(n,) for n in names], f"{col} string")


def read_prompts(spark: SparkSession, path: str) -> dict[str, str]:
    """A JSON object ``name -> system prompt`` as a driver-side dict; anything else is an error.

    A prompt dictionary is a handful of entries; it is read once and passed
    to the jobs as literals.
    """
    return _small_document(spark, path, dict)


def write_text_tree(df: DataFrame, root: str, folder_col: str = "folder", id_col: str = "id",
                    content_col: str = "content_raw") -> int:
    """Write one UTF-8 file ``<root>/<folder>/<id>.txt`` per row (the layout S1 reads).

    Each task writes its own rows straight to the target filesystem.
    """
    ship_package(df.sparkSession)
    rows = df.select(folder_col, id_col, content_col)

    def write(batches):
        import pandas as pd

        filesystem, base = arrow_fs(root)
        n = 0
        made = set()
        for pdf in batches:
            for folder, ident, content in zip(pdf[folder_col], pdf[id_col], pdf[content_col]):
                d = f"{base}/{folder}"
                if d not in made:
                    filesystem.create_dir(d, recursive=True)
                    made.add(d)
                with filesystem.open_output_stream(f"{d}/{ident}.txt") as out:
                    out.write(("" if content is None else content).encode("utf-8"))
                n += 1
        yield pd.DataFrame({"n": [n]})

    counts = rows.mapInPandas(write, "n long")
    return int(counts.agg(F.sum("n")).first()[0] or 0)


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small document (a split list, a prompt dictionary) to ``path``."""
    filesystem, p = arrow_fs(path)
    parent = p.rsplit("/", 1)[0]
    filesystem.create_dir(parent, recursive=True)
    with filesystem.open_output_stream(p) as out:
        out.write(text.encode("utf-8"))


def prompts_json(prompts: dict[str, str]) -> str:
    return json.dumps(prompts, ensure_ascii=False)


def write_sheets_table(df: DataFrame, path: str, folder_col: str = "folder", mode: str = "overwrite") -> None:
    """Sheets as Parquet partitioned by folder (the format between jobs).

    Rows are rebalanced by folder first: a folder is written by one task, or
    by a few where it is large, not by every task.  A folder split over this
    table prunes whole folders at scan time by its literal ``IN`` list.
    """
    df.hint("rebalance", folder_col).write.mode(mode).partitionBy(folder_col).parquet(path)


def read_sheets_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
