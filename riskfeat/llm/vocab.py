"""Tokenizer files for tasks: read once on the driver, broadcast, parsed once a worker.

The files are of fixed size (under 2 MB), so their broadcast does not grow with data.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

_PARSED: dict[str, object] = {}
#: Functions with an ``lru_cache`` that a waiting worker need not hold.
CACHED: list = []
#: Of the C library, where it has it: else freed blocks stay with the worker.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def forget() -> None:
    """Drop the tokenizers and tables of this worker with their caches and give free memory back
    to the system. Operators that hash words call it for every batch: a worker goes on to other
    stages, and what it held of the last would stay beside them."""
    _PARSED.clear()
    for made in CACHED:
        made.cache_clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class VocabFile:
    """A broadcast tokenizer file; ``parsed(f)`` is ``f(text)``, made once in a worker."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.digest = hashlib.sha256(text.encode()).hexdigest()
        self.text = spark.sparkContext.broadcast(text)

    def parsed(self, build: Callable[[str], object]):
        key = f"{build.__module__}.{build.__qualname__}:{self.digest}"
        if key not in _PARSED:
            _PARSED[key] = build(self.text.value)
        return _PARSED[key]


class WordCache(dict):
    """word -> packed ids, made on demand. Once ``size`` words are in, they become the older
    half: a word of it that is met again comes back, the rest goes. Long words are not kept."""

    def __init__(self, make: Callable[[str], bytes], size: int = 250_000, longest: int = 48):
        self.make, self.size, self.longest = make, size, longest
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = self.make(word)
            if len(word) > self.longest:
                return packed
        self[word] = packed
        return packed

    def trim(self) -> None:
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
