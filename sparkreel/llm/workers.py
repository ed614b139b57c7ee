"""What Python workers hold: batches of texts in bounded parts, freed memory given back."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa

PART_CHARS = 1 << 18

Batches = Callable[[Iterator], Iterator]


def parts_of(texts: pd.Series, most: int = 500, chars: int = PART_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Texts in parts of at most ``most``, and no more than ``chars`` characters unless one alone has
    more; each part with the number of its first text."""
    begin, held, part = 0, 0, []
    for at, text in enumerate(texts):
        if part and (len(part) == most or held + len(text) > chars):
            yield begin, part
            begin, held, part = at, 0, []
        part.append(text)
        held += len(text)
    if part:
        yield begin, part


@functools.cache
def _trim() -> Callable[[int], int]:
    # The C library of Linux has it; elsewhere there is nothing to call.
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Returns freed memory to the system, which allocators else keep for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(function: Batches) -> Batches:
    """A function over batches that gives memory back at the end of its task.

    Workers are kept for later tasks, and while other stages run in the JVM beside them.
    """

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run
