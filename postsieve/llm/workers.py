"""What Python workers keep between tasks.

A worker serves task after task, also those of later stages.  Tables and caches that an operator keeps there for its next tasks go when another operator's tasks begin.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

_kept: dict[str, Callable[[], None]] = {}
_last = ""


def keep(name: str, drop: Callable[[], None]) -> None:
    """Register how what the operator ``name`` keeps is dropped."""
    _kept[name] = drop


def begin(name: str) -> None:
    """To be called where a task of the operator ``name`` begins."""
    global _last
    if name == _last:
        return
    _last = name
    for other, drop in _kept.items():
        if other != name:
            drop()
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
