"""Freed memory back to the system."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def give_back(collect: bool = True) -> None:
    """Return freed memory to the system: the driver's after a fit, and after a task
    that of its Python worker, which may idle while others need it."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
