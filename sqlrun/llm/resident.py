"""One model at a time in a Python worker.

Spark keeps Python workers between stages.  A model that a worker loads (a
tokenizer with its caches, language models) is used by many tasks of a stage,
so it stays - until another operator's is asked for in the same worker, which
then takes its place.  So a pipeline's workers hold what the present stage
needs, not what all stages needed.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def resident(key: Hashable, make: Callable[[], Any]) -> Any:
    """`make()`, made once for `key` while no other key is asked for."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]
