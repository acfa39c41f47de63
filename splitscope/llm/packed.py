"""Packed exchange of hashed keys.

Operators that must learn which of billions of hashes occur in more than one document would spend most of their time on
one row per hash.  Here a task sorts its hashes, cuts them into hash ranges (*buckets*) and ships one binary row per
range; Spark shuffles and groups these rows by bucket.  A hash that several documents of one task share is sent
once, so however hot it is, a bucket gets it at most once per flush.
"""

from __future__ import annotations

import numpy as np

FLUSH = 1 << 20


def planes(x: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their differences, which compress well."""
    x = np.ascontiguousarray(x, dtype=np.uint64)
    d = x.copy()
    d[1:] -= x[:-1]
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64)


def small(x: np.ndarray) -> bytes:
    """64-bit integers as byte planes."""
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unsmall(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def edges(sorted_hash: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each of ``n_buckets`` equal hash ranges begins in a sorted array; its length ends it."""
    at = np.array([(k << 64) // n_buckets for k in range(n_buckets)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_hash, at, side="left"), len(sorted_hash))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return first, np.diff(np.append(first, len(sorted_values)))
