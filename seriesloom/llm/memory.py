"""Python workers stay alive beside later stages: what they have freed goes back to the system."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa


@cache
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim; elsewhere nothing needs doing."""
    return getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", lambda _: 0)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of a task's batches, that gives its memory back when the task ends."""
    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped
