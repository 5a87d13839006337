"""What runs inside Python workers: small slices of batches, and memory given back when a task ends."""

import ctypes
import functools
import gc

import pyarrow as pa


def slices(batches, rows: int = 256, size: int = 4_000_000):
    """(record batch slices): few rows and few bytes at a time, long texts alone."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n //= 2
            yield batch.slice(at, n)
            at += n


def release() -> None:
    """Workers are reused and idle ones stay, so freed memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run):
    """A mapInArrow function that gives its memory back at the end of the task."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
