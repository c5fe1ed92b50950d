"""What a Python worker keeps from one task to the next.

Spark lends the same workers to one step after the other, so that a step's tables would lie beside the next one's in an
executor's memory. Here a worker keeps the things of one step only: when a task of another step begins, they go, and the
memory that they took goes back to the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_step = ""
_things: dict[Hashable, tuple[Hashable, Any]] = {}
#: What modules do with tables of their own when a worker goes over to another step.
at_change: list[Callable[[], None]] = []


def give_back() -> None:
    """Freed memory goes to the system, as far as Python, Arrow and the C library can tell it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def begin(step: str) -> None:
    """A task of ``step`` begins: what another step kept goes."""
    global _step
    if step == _step:
        return
    before, _step = _step, step
    _things.clear()
    for let_go in at_change:
        let_go()
    if before:
        give_back()


def kept(step: str, name: Hashable, make: Callable[[], Any], version: Hashable = None) -> Any:
    """The thing of that name, made once in a worker for as long as it does this step's tasks; another version takes its place."""
    begin(step)
    if name not in _things or _things[name][0] != version:
        _things.pop(name, None)
        _things[name] = version, make()
    return _things[name][1]
