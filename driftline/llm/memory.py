"""Memory of Python workers.

An executor's memory is shared by the JVM and its Python workers, and a worker lives on between tasks.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return to the system what this worker's allocators keep of freed blocks; to be called when a batch is done."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
