"""Memory of reused Python workers: what an operator's task leaves behind is given back before the next operator's begins.

A worker serves one operator after another, and freed memory stays with its allocators; with several workers on an
executor that adds up beside the JVM. So caches that outlive a task are registered by name, a task clears those that it
has no use for, and freed memory goes back to the system at its end."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

_caches: dict[str, Callable[[], None]] = {}


def cached(name: str, clear: Callable[[], None]) -> None:
    """Registers how a cache of this worker is cleared."""
    _caches[name] = clear


@functools.cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except AttributeError:  # other C libraries have no such function
        return lambda _: 0


def begin(names: tuple[str, ...]) -> None:
    """Clears the caches other than the named ones."""
    for name, clear in _caches.items():
        if name not in names:
            clear()


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def keeping(*names: str):
    """A decorator of functions for mapInArrow that use the named caches."""

    def decorate(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        @functools.wraps(run)
        def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin(names)
            try:
                yield from run(batches)
            finally:
                release()

        return tidied

    return decorate


#: For functions that use hash powers alone.
tidy = keeping("powers")
