"""Operators for training-data pipelines. Nothing else in the library imports this package."""

import ctypes

import pyarrow as pa


def _return_memory() -> None:
    """Make the C library give blocks of a MB or more back when they are freed, where it is the usual one.

    Workers and the driver's process live through many stages; else what one stage freed stays with the process.  Arrow
    takes its memory from the C library too then.  -3 is M_MMAP_THRESHOLD and -1 M_TRIM_THRESHOLD.
    """
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)
        libc.mallopt(-1, 1 << 20)
    except (AttributeError, OSError):
        return
    pa.set_memory_pool(pa.system_memory_pool())


_return_memory()
