"""Memory of Python workers between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

from .lookup import let_go

Batches = Iterator[pa.RecordBatch]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, which after its last batch gives free memory back to the system and lets go of mapped files.

    Spark reuses its Python workers: what one keeps after a task would count against the executor through all later stages.
    """

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            let_go()
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):  # of the GNU library
                libc.malloc_trim(0)

    return whole
