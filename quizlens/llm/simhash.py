"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius; two
fingerprints that are close enough emit a variant in common.  An odd radius
has no exact half: for radius 2h + 1 the 64 bits are cut into groups, and for
each group in turn its bits are masked before variants within h flips of the
others are emitted.  Of 2h + 1 differing bits some group holds one at least;
with it masked at most 2h differ, so both fingerprints reach the variant in
the middle.  (Without masks, variants within h + 1 flips would be needed:
2,081 for each fingerprint at radius 3, where four masks make it 196.)

Colliding fingerprints are verified by their bits.  A task holds the distinct
fingerprints of one variant at a time and links them by a spanning forest, so
a bucket of m fingerprints gives fewer than m links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import keep_rows, ready, shuffle_width, staged, text_hash
from quizlens.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
MASK_GROUPS = 4
#: Shingles whose bits are counted at a time.
STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = zip(*[words[k:] for k in range(shingle)]) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(r), seed) for r in runs], dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(hashes[k:k + STEP], axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(hashes), STEP))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, h, fp)``: text hash and signed 64-bit fingerprint of each row."""
    ready(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "h", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       text_hash(text_col).alias("h")).mapInArrow(run, "doc_id long, h long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(radius: int, groups: int) -> list[tuple[int, int]]:
    """(bits kept, bits flipped) of every variant."""
    width = -(-64 // groups)
    masks = [0] if radius % 2 == 0 else [((1 << width) - 1) << at & ((1 << 64) - 1) for at in range(0, 64, width)]
    out = []
    for k, mask in enumerate(masks):
        free = [1 << b for b in range(64) if not mask >> b & 1]
        # The tag keeps variants of different masks apart.
        tag = xxhash.xxh64_intdigest(b"mask %d" % k) if mask else 0
        out += [(~mask & ((1 << 64) - 1), sum(flips) ^ tag)
                for n in range(radius // 2 + 1) for flips in combinations(free, n)]
    return [(_signed(keep), _signed(flip)) for keep, flip in out]


def _forest(fps: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links (pairs) that connect what is connected within one bucket's distinct fingerprints."""
    links, rest = [], fps
    while len(rest) > 1:
        near, rest = [rest[:1]], rest[1:]
        while near and len(rest):
            at = near.pop()
            for one in at:
                close = np.bitwise_count(rest ^ one) <= radius
                if close.any():
                    found, rest = rest[close], rest[~close]
                    links.append(np.stack([np.full(len(found), one), found]))
                    near.append(found)
                    if not len(rest):
                        break
    return links


def _linker(radius: int):
    def link(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
        """Links in sorted whole buckets; buckets of two are taken at one time."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        twos = starts[sizes == 2]
        pairs = np.stack([fps[twos], fps[twos + 1]])
        out = [pairs[:, np.bitwise_count(pairs[0] ^ pairs[1]) <= radius]]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            out += _forest(fps[at:at + n], radius)
        return np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = fps = np.empty(0, dtype=np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy().view(np.uint64)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            whole = np.searchsorted(keys == keys[-1], True) if len(keys) else 0  # the last bucket may go on
            if whole:
                yield _links(link(keys[:whole], fps[:whole]))
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield _links(link(keys, fps))

    return run


def _links(pairs: np.ndarray) -> pa.RecordBatch:
    signed = np.ascontiguousarray(pairs).astype(np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[0]), pa.array(signed[1])], names=["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, groups: int = MASK_GROUPS) -> DataFrame:
    """``(a, b)``: links within ``radius`` bits that connect the distinct fingerprints ``fps`` as all such links would."""
    variants = F.array(*[F.struct(F.lit(keep).alias("keep"), F.lit(flip).alias("flip")) for keep, flip in _masks(radius, groups)])
    emitted = fps.select("fp", F.explode(variants).alias("v")).select(
        F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip")).alias("key"), "fp")
    width = shuffle_width(fps.sparkSession)
    return emitted.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_linker(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED,
                    groups: int = MASK_GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, fp, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest id that is reached over links of at most
    ``radius`` differing bits.  Null and empty texts, and texts without words,
    have fingerprint 0 and link like any other.  Rows that repeat an id or a
    text share a fingerprint.  Null ids are never the smallest; a component of
    null ids alone has a null component id.  An empty table gives an empty
    result.  Other columns are not read.
    """
    rows = staged(fingerprints(docs, shingle, seed, id_col, text_col), "simhash-rows")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(staged(links(classes, radius, groups).distinct(), "simhash-links"))
    rooted = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(named, "fp").select("doc_id", "h", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns: one of each component, that of the smallest id.

    Where rows of one component share that id, the one of the smallest text
    hash stays.  Rows of a component without any id are one group too.
    """
    rows = staged(near_duplicates(docs, id_col=id_col, text_col=text_col, **how), "simhash-groups")
    # A null id comes last: it is kept only where its component has no other.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    best = staged(rows.groupBy("component_id").agg(F.min(order).alias("best")), "simhash-best")
    decided = rows.join(best, rows["component_id"].eqNullSafe(best["component_id"])).select(
        F.col("doc_id").alias("id"), "h", (order == F.col("best")).alias("kept"))
    # Rows that agree in id and text with the one kept are copies of it: one of them stays.
    first = staged(decided, "simhash-decided")
    return keep_rows(docs, one_of_copies(first), id_col, text_col)


def one_of_copies(decided: DataFrame) -> DataFrame:
    """Of kept rows that agree in (id, h), only one stays kept."""
    pairs = decided.where("kept").groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    extra = pairs.select("id", "h", F.lit(False).alias("kept"))
    return decided.unionByName(extra)
