"""Directly addressable codes for one run of documents' token ids.

An id is split into chunks of eight bits, low chunk first.  Level 0 holds the
first chunk of every id; a bitmap has a one where another chunk follows, which
stands in level 1 at the place given by the number of ones before it, and so
on.  A rank directory holds the number of ones before every 512th bit, so any
id is read with a few look-ups and no block is decoded.

Layout, little-endian: ``DAC1``, u32 documents, u64 ids, u64 place of the
first id in the file, u8 levels; i64 id of each document and a bitmap of those
that are not null; u64 start of each document and one end; then each level:
u64 length, chunk bytes, bitmap bytes, u32 rank directory.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
_HEAD = struct.Struct("<4sIQQB")
BLOCK = 512


def encode(doc_ids: list, ids: list[bytes], first: int) -> bytes:
    """The code of documents given by their ids as little-endian unsigned 32-bit integers."""
    starts = np.zeros(len(ids) + 1, dtype="<u8")
    np.cumsum([len(b) // 4 for b in ids], out=starts[1:])
    values = np.frombuffer(b"".join(ids), dtype="<u4")
    levels = []
    while True:
        more = values > 255
        padded = np.zeros(-(-len(values) // BLOCK) * BLOCK, dtype=bool)
        padded[:len(values)] = more
        ones = padded.reshape(-1, BLOCK).sum(axis=1, dtype="<u4")
        directory = np.zeros(len(ones) + 1, dtype="<u4")
        np.cumsum(ones, out=directory[1:])
        levels.append((values.astype(np.uint8), np.packbits(padded, bitorder="little"), directory))
        if not more.any():
            break
        values = values[more] >> 8
    present = np.packbits([d is not None for d in doc_ids], bitorder="little") if doc_ids else np.empty(0, np.uint8)
    out = [_HEAD.pack(MAGIC, len(ids), int(starts[-1]), first, len(levels)),
           np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), present.tobytes(), starts.tobytes()]
    for chunks, bitmap, directory in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), directory.tobytes()]
    return b"".join(out)


class Reader:
    """Reads a code in place: no part of it is copied or decoded up front."""

    def __init__(self, code: bytes):
        magic, self.n_docs, self.n_ids, self.first, n_levels = _HEAD.unpack_from(code)
        if magic != MAGIC:
            raise ValueError("not a DAC1 code")
        at = _HEAD.size

        def take(dtype, n):
            nonlocal at
            view = np.frombuffer(code, dtype=dtype, count=n, offset=at)
            at += view.nbytes
            return view

        self.doc_ids = take("<i8", self.n_docs)
        self.present = take(np.uint8, -(-self.n_docs // 8))
        self.starts = take("<u8", self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // BLOCK)
            self.levels.append((take(np.uint8, n), take(np.uint8, blocks * BLOCK // 8), take("<u4", blocks + 1)))

    def doc_id(self, k: int):
        return int(self.doc_ids[k]) if self.present[k // 8] >> (k % 8) & 1 else None

    def _rank(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a level's bitmap."""
        _, bitmap, directory = self.levels[level]
        block = i // BLOCK
        bits = bitmap[block * BLOCK // 8: -(-i // 8)]
        ones = int(np.bitwise_count(bits).sum())
        if i % 8 and len(bits):
            ones -= int(np.bitwise_count(np.uint8(int(bits[-1]) >> (i % 8))))
        return int(directory[block]) + ones

    def at(self, i: int) -> int:
        """Id number ``i``, by one look-up in each level."""
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bitmap[i // 8] >> (i % 8) & 1:
                return value
            i = self._rank(level, i)
        raise ValueError("the last level has a continuation")

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids ``a`` to ``b``: one run in each level."""
        out = np.zeros(b - a, dtype="<u4")
        where = np.arange(b - a)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if a == b:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(bitmap[a // 8: -(-b // 8)], bitorder="little")[a % 8: a % 8 + b - a]
            where = where[bits == 1]
            if level + 1 < len(self.levels):
                a = self._rank(level, a)
                b = a + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))
