"""Texts as chunks that a tokenizer may treat one by one, each distinct chunk once."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: A run between spaces and line ends that has any character but printable ASCII, whole;
#: of the other runs the words, digits and punctuation.
_PARTS = re.compile(r"[!-~]*+[^!-~ \n][^ \n]*|'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[A-Za-z]+|[0-9]|[!-/:-@\[-`{-~]+")


def word_parts(text: str) -> list[str]:
    """Parts that a caseless tokenizer of words, single digits and punctuation treats one by one.

    It drops white space, and no character composes with a space or line end before it.
    """
    return _PARTS.findall(text)


_CLEAR: dict[str, Callable[[], None]] = {}
_NOW: list[str] = [""]


def turn(name: str, clear: Callable[[], None]) -> None:
    """Say that ``name``'s caches are in use in this worker: those of others, which stages before it have filled, are emptied.

    A worker serves one stage after another; what it has freed goes back to the system,
    as the executor's memory is shared with the JVM.
    """
    _CLEAR[name] = clear
    if _NOW[0] != name:
        for other, f in _CLEAR.items():
            if other != name:
                f()
        _NOW[0] = name
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            pass


class ChunkCache:
    """What a function makes of each chunk, kept within a worker for the chunks seen of late.

    Two generations of at most ``size`` chunks bound its memory; a result never
    depends on what is kept.
    """

    def __init__(self, make: Callable[[list[str]], Iterable], size: int = 150_000):
        self.make, self.size = make, size
        self.now: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def clear(self) -> None:
        self.now, self.old = {}, {}

    def need(self, chunks: Iterable) -> dict:
        """A dict that has at least these chunks."""
        chunks = set(chunks)
        if len(self.now) > self.size:
            self.old, self.now = self.now, {}
        missing = []
        for c in chunks - self.now.keys():
            if c in self.old:
                self.now[c] = self.old[c]
            else:
                missing.append(c)
        missing.sort()
        self.now.update(zip(missing, self.make(missing)))
        return self.now


def slices(texts: Iterable[str | None], limit: int = 3_000_000) -> Iterator[list[str]]:
    """Runs of whole texts of about ``limit`` characters; null counts as empty."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= limit:
            yield held
            held, n = [], 0
    if held:
        yield held
