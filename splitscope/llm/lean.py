"""Task functions that hand their memory back.

A Python worker outlives its tasks and keeps the pages of what it has freed.  Wrapped functions take large blocks from the system
one by one, and return free pages at their end, so idle workers of earlier stages stay small beside the one at work.  Queries ask for Arrow batches of
``_ROWS`` rows where the session has the default of ten thousand; operators give the same results with any.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3
_LARGE = 32 << 20
_ROWS = 1000  # of an Arrow batch: texts are long, and a batch has copies on both sides of the pipe


@functools.cache
def _libc():
    """The C library with fixed thresholds, None where it has none."""
    try:
        lib = ctypes.CDLL(None)
        lib.mallopt(_M_MMAP_THRESHOLD, _LARGE)
        lib.mallopt(_M_TRIM_THRESHOLD, 2 * _LARGE)
        lib.malloc_trim.argtypes = [ctypes.c_size_t]
        return lib
    except (OSError, AttributeError):
        return None


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``_ROWS`` rows, unless they are smaller already.  For queries: operators leave the session as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > 5 * _ROWS:
        spark.conf.set(key, str(_ROWS))


def settle() -> None:
    _libc()
    pa.set_memory_pool(pa.system_memory_pool())


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def _named(run, f):
    """``run`` under the name of ``f``, which plans show."""
    run.__name__ = run.__qualname__ = f.__name__
    return run


def batches(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """For ``mapInArrow``."""

    def run(rows):
        settle()
        try:
            yield from f(rows)
        finally:
            release()

    return _named(run, f)


def group(f: Callable[[pa.Table], pa.Table]):
    """For ``applyInArrow`` on groups."""

    def run(table):
        settle()
        try:
            return f(table)
        finally:
            release()

    return _named(run, f)


def groups(f: Callable[[tuple, pa.Table, pa.Table], pa.Table]):
    """For ``applyInArrow`` on cogroups with their key."""

    def run(key, left, right):
        settle()
        try:
            return f(key, left, right)
        finally:
            release()

    return _named(run, f)
