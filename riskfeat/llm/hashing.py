"""Words of a whole Arrow batch as 64-bit hashes, without a Python object per word.

A word is a longest run of bytes of one class; class 0 separates. Each word's hash is a
polynomial in its bytes modulo 2**64, taken as a difference of running sums, then mixed
with its length. The same text gives the same hashes in every worker and every run.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from riskfeat.llm.vocab import CACHED, forget

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Texts are taken together until they pass this many bytes, which bounds the memory: words are
#: hashed by parts, as some ten arrays of 8 bytes a byte of text are alive there.
BLOCK, PART = 1 << 20, 1 << 18
#: Texts of a batch that are copied at a time.
SLICE = 1024


def byte_table(f) -> np.ndarray:
    return np.array([f(b) for b in range(256)], np.uint8)


#: Separated by space, tab, LF, VT, FF and CR only.
SPACED = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Letters (all bytes beyond ASCII count as such), digits and signs are words of their own.
RUNS = byte_table(lambda b: 1 if b >= 0x80 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if b > 0x20 and b != 0x7F else 0)
LOWER = byte_table(lambda b: b + 32 if 0x41 <= b <= 0x5A else b)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(1, U)
        while len(p) < n:
            p = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
        out.append(p[:n])
    return out[0], out[1]


CACHED.append(_powers)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the place where each begins; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, classes: np.ndarray, lower: bool):
    """Yields (first text, hashes of all words, places where each text's words begin) by block."""
    forget()
    for begin in range(0, len(texts), SLICE):  # a slice at a time is copied
        data, offsets = text_bytes(texts.slice(begin, SLICE))
        first, n = 0, len(offsets) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PART, "right")) - 1)
            yield begin + first, *_block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], classes, lower)
            first = last
        del data, offsets
    forget()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, usual: int = BLOCK) -> np.ndarray:
    """The hash of data[start:end] for each span; data of up to ``usual`` bytes share a table."""
    n = len(data)
    up, down = _powers(usual if n <= usual else 1 << int(n).bit_length())
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(data.astype(U) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def _block(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool):
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    kinds = classes[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    word = kinds[starts] != 0
    starts, ends = starts[word], ends[word]
    hashes = span_hashes(LOWER[data] if lower else data, starts, ends, PART)
    return hashes, np.searchsorted(starts, offsets)


#: Odd multipliers, one for each place in an n-gram.
PLACES = [U(pow(0xA0761D6478BD642F, 2 * i + 1, 1 << 64)) for i in range(8)]


def combine(*words: np.ndarray) -> np.ndarray:
    """Hashes of sequences, word by word; the places of the words count."""
    total = words[0] * PLACES[0]
    for place, w in zip(PLACES[1:], words[1:]):
        total = total + w * place
    return mix(total + U(len(words)))
