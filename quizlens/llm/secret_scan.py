"""Secret scan with multipart credential linking.

Patterns that are telling by themselves (an assignment to a secret's name, an
access key id, a long hex string) are reported as they are.  Weak parts (a
user or client name, a short or unnamed secret, an address) are reported only
where complementary parts stand close by in the same scope: an identifier or
an endpoint beside a secret, a secret beside one of those.  The interval join
of parts within a scope needs no pairs: a part meets a role if the last end of
that role's parts before it, or the first start of those after it, is at most
``reach`` characters away, which running windows over starts and ends give.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlens.llm.common import ready, staged

# The three base patterns and the least length of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
#: Runs are maximal, so the least length (18, 16) can be part of the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Weak parts: what a credential is made of, not telling alone.
IDENTIFIER = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.I | re.A)
IDENTIFIER_NAMES = ("user", "login", "account", "client", "access")
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+(?::\d{1,5})?(?:/[^\s\"'<>]*)?|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?(?![\d.])", re.A)
UNNAMED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
SCOPE_END = re.compile(r"\n[ \t\r]*\n")

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
REACH = 300
_SPAN = "array<struct<start: long, kind: int, end: long>>"
_PART = "array<struct<start: long, kind: int, end: long, scope: int, role: string, weak: boolean>>"
SCHEMA = (f"rid long, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base {_SPAN}, parts {_PART}")


def _varied(value: str) -> bool:
    """Letters and digits, as in keys of any alphabet (base32, hex with dashes); the complement close by does the rest."""
    return any(c.isalpha() for c in value) and any(c.isdigit() for c in value)


def find(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans (start, kind, end) of a whole text, and its parts (start, kind, end, role, weak)."""
    low = text.lower()
    assigned = list(ASSIGN.finditer(text)) if any(n in low for n in ASSIGN_NAMES) else []
    strong = [m for m in assigned if len(m[2]) >= ASSIGN_LEAST]
    access, hexes = list(ACCESS.finditer(text)), list(HEX.finditer(text))
    base = sorted((m.start(), kind, m.end()) for kind, found in enumerate((strong, access, hexes)) for m in found)
    parts = [(m.start(), 0, m.end(), "secret", False) for m in strong]
    parts += [(m.start(), 1, m.end(), "identifier", False) for m in access]
    # A run of digits alone is a number more often than a secret.
    parts += [(m.start(), 2, m.end(), "secret", False) for m in hexes if not m[0].isdigit()]
    parts += [(m.start(), 4, m.end(), "secret", True) for m in assigned if 6 <= len(m[2]) < ASSIGN_LEAST]
    if any(n in low for n in IDENTIFIER_NAMES):
        parts += [(m.start(), 3, m.end(), "identifier", True) for m in IDENTIFIER.finditer(text)]
    parts += [(m.start(), 5, m.end(), "endpoint", True) for m in ENDPOINT.finditer(text)]
    if any(p[3] != "secret" for p in parts):  # else no unnamed secret has a complement
        taken = sorted((s, e) for s, _, e, _, _ in parts)
        for m in UNNAMED.finditer(text):
            at = bisect_right(taken, (m.start(), len(text)))
            free = (not at or taken[at - 1][1] <= m.start()) and (at == len(taken) or taken[at][0] >= m.end())
            if free and _varied(m[0]):
                parts.append((m.start(), 4, m.end(), "secret", True))
    return base, parts


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                        ("n_hex", pa.int64()), ("base_sha256", pa.string()),
                        ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
                        ("parts", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()),
                                                      ("scope", pa.int32()), ("role", pa.string()), ("weak", pa.bool_())])))])
    for batch in batches:
        rows = []
        for rid, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "text"))):
            text = text or ""
            base, parts = find(text)
            ends = [m.end() for m in SCOPE_END.finditer(text)] if parts else []
            joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
            rows.append({"rid": rid, "doc_id": doc_id, "n_assign": sum(k == 0 for _, k, _ in base),
                         "n_access": sum(k == 1 for _, k, _ in base), "n_hex": sum(k == 2 for _, k, _ in base),
                         "base_sha256": hashlib.sha256(joined.encode()).hexdigest(),
                         "base": [dict(zip(("start", "kind", "end"), b)) for b in base],
                         "parts": [{"start": s, "kind": k, "end": e, "scope": bisect_right(ends, s), "role": r, "weak": w}
                                   for s, k, e, r, w in parts]})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def parts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its base spans and the parts for linking (``SCHEMA``)."""
    ready(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    return staged(rows.mapInArrow(_scan, SCHEMA), "secret-parts")


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Parts with a complement in reach: ``(rid, doc_id, start, kind, end, role, weak, with_secret, with_identifier, with_endpoint)``.

    Within a scope of a text (blank lines part scopes) a part meets those that
    overlap it or leave a gap of at most ``reach`` code points, counted from
    the end of the one to the start of the other.
    """
    each = parts.where(F.size("parts") > 1).select("rid", "doc_id", F.inline("parts"))
    scope = Window.partitionBy("rid", "scope")
    # Both run from their side on: a frame that is open to the end would be summed up anew for every row.
    before = scope.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = scope.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    roles = ("secret", "identifier", "endpoint")
    of = {r: F.col("role") == r for r in roles}
    near = (each.withColumns({f"__end_{r}": F.max(F.when(of[r], F.col("end"))).over(before) for r in roles})
            .withColumns({f"__start_{r}": F.min(F.when(of[r], F.col("start"))).over(after) for r in roles}))
    seen = near.withColumns({f"with_{r}": F.coalesce(F.col("start") - F.col(f"__end_{r}") <= reach, F.lit(False))
                             | F.coalesce(F.col(f"__start_{r}") - F.col("end") <= reach, F.lit(False)) for r in roles})
    complete = F.when(F.col("role") == "secret", F.col("with_identifier") | F.col("with_endpoint")).otherwise(F.col("with_secret"))
    return seen.where(complete).drop("scope", *(f"__{side}_{r}" for side in ("end", "start") for r in roles))


def scan(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked)``, one row per row of ``docs``.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) of the
    base spans and of the weak parts that are linked, by start and then kind.
    Null and empty texts have no spans: zero counts, the hash of an empty
    string and an empty list.  Rows that repeat an id are scanned each.  An
    empty table gives an empty result.  Other columns are not read.
    """
    rows = parts_of(docs, id_col, text_col)
    weak = (linked(rows, reach).where("weak").groupBy("rid")
            .agg(F.collect_set(F.struct("start", "kind", "end")).alias("weak")))
    names = F.array(*[F.lit(k) for k in KINDS])
    both = rows.drop("parts").join(weak, "rid", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("weak", F.array().cast(_SPAN))))
    text = F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"]))
    return both.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(text, ",").alias("spans"),
                       F.coalesce(F.size("weak"), F.lit(0)).cast("long").alias("n_linked"))
