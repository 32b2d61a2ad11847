"""Memory of reused Python workers: what a task has cached is given back when it ends."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

from panelwright.llm import common, word_tokens


def give_back() -> None:
    """Forgets cached tables and tokenizers, and returns freed pages to the system."""
    for cached in (common._powers, common.reference_tokenizer, common.byte_engine, common.byte_table, common.merges,
                   word_tokens.word_encoder):
        cached.cache_clear()
    if arrow := sys.modules.get("pyarrow"):
        arrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its allocator decides
        pass


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` over record batches, in a worker that holds nothing of earlier tasks and keeps nothing of this one."""
    def run(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
