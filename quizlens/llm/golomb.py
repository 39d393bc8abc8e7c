"""Golomb-Rice coding of sorted distinct integers with numpy."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray, low: int = 0) -> tuple[int, bytes, bytes]:
    """``(k, quotients, remainders)`` of sorted distinct unsigned integers from ``low`` on.

    Gaps are split at ``2**k`` (k from the mean gap): quotients in unary, one
    stream of bits, and remainders of k bits each, another, so that both are
    read back without a loop.
    """
    values = np.asarray(values, dtype=np.uint64)
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=np.uint64(low))
    k = max(int(gaps.mean()).bit_length() - 1, 0)
    ends = np.cumsum((gaps >> np.uint64(k)) + np.uint64(1)).astype(np.int64)
    unary = np.zeros(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def decode(n: int, k: int, quotients: bytes, remainders: bytes, low: int = 0) -> np.ndarray:
    """The ``n`` integers that :func:`encode` was given."""
    if not n:
        return np.empty(0, dtype=np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, dtype=np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(remainders, dtype=np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
        gaps += (bits << np.arange(k - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)
