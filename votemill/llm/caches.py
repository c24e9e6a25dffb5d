"""What a Python worker remembers between tasks.

Workers outlive a query's stages.  Each operator says whose tables it needs
when a task of its own starts, and the tables of all others are let go, so a
worker never holds more than one operator's memory.  Tables that point at each
other are freed by a collection only, which may not come for a long time by
itself, so one is made whenever the operator changes.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, Callable[[], object]] = {}
_owner: str | None = None


def enter(owner: str, release: Callable[[], object] | None = None) -> None:
    """Let go of what other owners remember; ``release`` is how to let go of this one's."""
    global _owner
    for name in [name for name in _held if name != owner]:
        _held.pop(name)()
    if _owner not in (None, owner):
        _trim()
    _owner = owner
    if release is not None:
        _held[owner] = release


def _trim() -> None:
    """Free what nothing reaches any more and hand it back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    library = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(library), "malloc_trim", None) if library else None
    if trim is not None:
        trim(0)
