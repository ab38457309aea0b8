"""What a Python worker keeps between tasks, and what it gives back.

Spark runs the tasks of one operator after another in the same Python processes. What an operator keeps in them for its
next task goes when another operator's task begins, and memory that a task has freed goes back to the system at its end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import pyarrow as pa

_kept: dict[tuple[str, str], Any] = {}


def keep(owner: str, key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in this process for as long as only the owner's tasks run in it."""
    if (owner, key) not in _kept:
        _kept[owner, key] = make()
    return _kept[owner, key]


def trim() -> None:
    """Hand freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def _task(batches: Iterator[pa.RecordBatch], f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str) -> Iterator[pa.RecordBatch]:
    for other in [k for k in _kept if k[0] != owner]:
        del _kept[other]
    try:
        yield from f(batches)
    finally:
        trim()


def task(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow, as a task of the owner."""
    return partial(_task, f=f, owner=owner)
