"""Derived fixture tables over the provided parquet (see FIXTURES.md).

Each fixture is one SELECT that Spark SQL and DuckDB both run unchanged, so
the operator under test gets identical input on both engines.  All of them
read whole tables and whole texts; modulo arithmetic only *varies* the
generated content, it never filters rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from quizlens.plans.sizing import spread

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

SHEETS_RAW = """
SELECT concat('IC-', lpad(cast(doc_id % 20 AS string), 3, '0')) AS folder,
       concat('S-', lpad(cast(doc_id AS string), 6, '0')) AS id,
       CASE WHEN doc_id % 50 = 0 THEN text ELSE concat(
         CASE WHEN doc_id % 41 = 0 THEN 'lead ' ELSE '' END,
         '{{knowledge objective', chr(10), '|Identifiant=', cast(doc_id AS string), chr(10),
         '|Item_parent=', source, chr(10),
         CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('|Title=Doc ', cast(doc_id AS string), ' (= copy)', chr(10)) END,
         CASE WHEN doc_id % 13 = 0 THEN concat('|Title=Second', chr(10)) ELSE '' END,
         '|Description=', CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(lang, ' ,,') END, chr(10),
         '|Rubric=', CASE WHEN lang = 'fr' THEN 'Multimedia content' WHEN lang = 'de' THEN 'Management' ELSE 'Definition' END, chr(10),
         '|Order=', cast(doc_id % 30 AS string), '}}', chr(10), text) END AS content_raw
FROM documents
"""

# Some sheet ids occur twice: with an equal text, with another text, with none.
SHEETS = """
SELECT concat('IC-', lpad(cast(doc_id % 20 AS string), 3, '0')) AS folder,
       concat('S-', lpad(cast(doc_id AS string), 6, '0')) AS id,
       CASE WHEN doc_id % 31 = 0 THEN NULL ELSE text END AS content_gpt
FROM documents
UNION ALL
SELECT concat('IC-', lpad(cast(doc_id % 20 AS string), 3, '0')) AS folder,
       concat('S-', lpad(cast(doc_id AS string), 6, '0')) AS id,
       CASE WHEN doc_id % 3 = 0 OR doc_id % 31 = 0 THEN NULL
            WHEN doc_id % 3 = 1 THEN concat('Another version. ', replace(text, ' the ', ' a ')) ELSE text END AS content_gpt
FROM documents WHERE doc_id % 23 = 5
"""

# One question per document, built from the whole document text; every 4th
# points at the next sheet, every 97th at no sheet at all.
MCQS = """
SELECT CASE WHEN doc_id % 97 = 0 THEN concat('X-', cast(doc_id AS string))
            WHEN doc_id % 4 = 0 THEN concat('S-', lpad(cast(doc_id + 1 AS string), 6, '0'))
            ELSE concat('S-', lpad(cast(doc_id AS string), 6, '0')) END AS id,
       doc_id AS mcq_id,
       concat(CASE WHEN doc_id % 7 = 0 THEN 'Not ' WHEN doc_id % 7 = 1 THEN 'What ' ELSE '' END,
              replace(text, chr(10), ' '),
              CASE WHEN doc_id % 3 = 0 THEN ' ?' WHEN doc_id % 3 = 1 THEN '.' ELSE '' END) AS question,
       split_part(text, ' ', -1) AS option_a, md5(text) AS option_b,
       concat(split_part(text, ' ', -2), ' and ', cast(length(text) AS string), ' characters') AS option_c,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE replace(replace(text, chr(10), ' '), 'e', '') END AS option_d,
       substring('abcdABCDe', cast(doc_id % 9 AS int) + 1, 1) AS correct_option
FROM documents
"""

# A whole text as the inside of a JSON string.
_JSON_TEXT = "text"
for _char, _escaped in (("chr(92)", "concat(chr(92), chr(92))"), ("'\"'", "concat(chr(92), '\"')"),
                        ("chr(10)", "concat(chr(92), 'n')"), ("chr(13)", "concat(chr(92), 'r')"),
                        ("chr(9)", "concat(chr(92), 't')")):
    _JSON_TEXT = f"replace({_JSON_TEXT}, {_char}, {_escaped})"

# Model outputs around each document's whole text: valid records (also with
# quotes, backslashes, extra and repeated keys), records that break the rules
# (types, missing and null fields, trailing text), plain text, and answers of
# every JSON type.
MODEL_OUTPUTS = f"""
SELECT doc_id AS id, CASE cast(doc_id % 12 AS int)
  WHEN 0 THEN concat('{{"question":"', body, '","option_a":"w","option_b":"x","option_c":"y","option_d":"z","correct_option":"b"}}')
  WHEN 1 THEN concat('{{"question":"', body, '","option_a":1,"option_b":"x","option_c":"y","option_d":"z","correct_option":"b"}}')
  WHEN 2 THEN concat('{{"question":"', body, '","option_a":"w","option_b":"x","option_c":"y","option_d":"z"}}')
  WHEN 3 THEN concat('{{"extra":["', body, '"],"question":"","option_a":"","option_b":"","option_c":"","option_d":"","correct_option":""}}')
  WHEN 4 THEN concat('  ', text, chr(10), '  ')
  WHEN 5 THEN concat('Sure: {{"answer": "', body, '"}} done')
  WHEN 6 THEN concat('{{"question":"', body, '","option_a":null,"option_b":"x","option_c":"y","option_d":"z","correct_option":"b"}}')
  WHEN 7 THEN concat('{{"answer":null,"note":"', body, '"}}')
  WHEN 8 THEN concat('{{"question":"q","option_a":"w","option_b":"x","option_c":"y","option_d":"z","correct_option":"b"}} ', text)
  WHEN 9 THEN concat('{{"question":"', body, '","option_a":"say ', chr(92), '"w', chr(92), '" ', chr(92), chr(92),
                     '","option_b":"x","option_b":"x","option_c":"y","option_d":"', body, '","correct_option":"b"}}')
  WHEN 10 THEN concat('{{"answer": 12,"note":"', body, '"}}')
  ELSE concat('{{"answer": [1,2],"note":"', body, '"}}') END AS response
FROM (SELECT doc_id, text, {_JSON_TEXT} AS body FROM documents)
"""

# Answer-model outputs: one per document and temperature run, covering the
# answer clean-up rules (empty, digits, spaced letters, invalid JSON).
def _answer_run(temperature: str, shift: int) -> str:
    return f"""
SELECT doc_id AS id, CAST({temperature} AS double) AS temperature, concat('{{"note":"', body, '","answer_option":',
  CASE cast((doc_id + {shift}) % 8 AS int)
  WHEN 0 THEN '""'
  WHEN 1 THEN '"3"'
  WHEN 2 THEN '"0"'
  WHEN 3 THEN '"1"'
  WHEN 4 THEN '" c) x"'
  WHEN 5 THEN '"b"'
  WHEN 6 THEN concat('"', body, '"')
  ELSE '2' END, '}}') AS response
FROM (SELECT doc_id, {_JSON_TEXT} AS body FROM documents)"""


ANSWER_OUTPUTS = "\nUNION ALL".join(_answer_run(t, k) for k, t in enumerate(("0.1", "0.5", "0.7"))) + "\n"

EXAM_ITEMS = """
SELECT concat('E-', cast(doc_id AS string)) AS id,
       replace(text, chr(10), ' ') AS question,
       substring('ABCD', cast(doc_id % 4 AS int) + 1, 1) AS cop,
       split_part(text, ' ', -3) AS opa, md5(text) AS opb,
       concat(cast(length(text) AS string), ' characters') AS opc, replace(replace(text, chr(10), ' '), 'a', '') AS opd
FROM documents
"""

# The test side of the folder split, as its JSON document holds it.
TEST_FOLDERS = ("IC-001", "IC-004", "IC-007", "IC-010", "IC-013", "IC-016", "IC-019")
TEST_FOLDERS_JSON = '["' + '", "'.join(TEST_FOLDERS) + '"]'

FIXTURES = {
    "sheets_raw": SHEETS_RAW,
    "sheets": SHEETS,
    "mcqs": MCQS,
    "model_outputs": MODEL_OUTPUTS,
    "answer_outputs": ANSWER_OUTPUTS,
    "exam_items": EXAM_ITEMS,
}


def register_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    """Expose the provided parquet tables as temp views for fixture SQL."""
    for name in names:
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").createOrReplaceTempView(name)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture table as a DataFrame over the documents parquet.

    The scan is spread over the cluster first when it has fewer splits than
    cores (a single-row-group file), so the text work runs in parallel.
    """
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    view = "_documents_" + hashlib.sha1(path.encode()).hexdigest()[:12]
    spread(spark.read.parquet(path)).createOrReplaceTempView(view)
    return spark.sql(FIXTURES[name].replace("FROM documents", f"FROM {view}"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cte(*names: str) -> str:
    """``WITH`` clause holding the named fixtures, for oracle SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in names)
