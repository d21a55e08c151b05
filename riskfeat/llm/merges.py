"""Byte-pair merges of all words of a block of texts at a time, for the tokenizers.

A block is cut into words from its bytes. Words are told apart by hash and then compared
byte by byte, so equal hashes of different words change nothing. Each different word of a
block is merged once: column by column a word keeps its parts and the ranks of neighbouring
parts, the smallest rank of every word is looked for again and again, its boundary is
deleted and the two neighbouring ranks are refreshed. Nothing is kept from block to block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view

from riskfeat.llm.hashing import BLOCK, U, span_hashes, text_bytes

#: Letters for which a word's class is known from its bytes: all beyond ASCII are letters.
UNCOMMON = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-įı-ɏ]")
SPACE, LETTER, DIGIT, SIGN = range(4)
KINDS = np.array(
    [LETTER if b >= 0x80 or chr(b).isalpha() else DIGIT if chr(b).isdigit() else SPACE if b == 0x20 or 9 <= b <= 13 else SIGN for b in range(256)],
    np.uint8,
)
#: Longer words are merged one by one.
WIDEST = 64
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, WIDEST)
NONE = np.int32(2**31 - 1)
#: Masks of the first 0 to 8 bytes of a little-endian number.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


class Merges:
    """Merges by pair of ids. ``first`` and ``last`` are the ids of the 256 bytes inside a word
    and at its end; ``ranks`` has (left, right) -> rank << 32 | merged; ``alone`` takes the
    bytes of a long word and returns its ids."""

    def __init__(self, first: list[int], last: list[int], ranks: dict[tuple[int, int], int], alone: Callable[[bytes], list[int]]):
        self.first, self.last, self.alone = np.array(first, np.int32), np.array(last, np.int32), alone
        pairs = np.array([a << 32 | b for a, b in ranks], U)
        packed = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.merged = np.zeros(int((packed >> 32).max(initial=0)) + 1, np.int32)
        self.merged[packed >> 32] = packed & 0xFFFFFFFF
        # open addressing, at most an eighth full; slot 0 of the pairs is told by its rank
        self.bits = max(8, (8 * len(pairs)).bit_length())
        self.pairs, self.ranks = np.zeros(1 << self.bits, U), np.full(1 << self.bits, NONE)
        rank, slot, left = (packed >> 32).astype(np.int32), self._slot(pairs), np.arange(len(pairs))
        while len(left):
            free = left[self.ranks[slot[left]] == NONE]
            self.pairs[slot[free]], self.ranks[slot[free]] = pairs[free], rank[free]
            left = left[self.pairs[slot[left]] != pairs[left]]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
        # ranks of two bytes as one number, inside a word and at its end
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.inner, self.ending = self.rank(self.first[a], self.first[b]), self.rank(self.first[a], self.last[b])

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or NONE."""
        pairs = left.astype(U) << U(32) | right.astype(U)
        slot = self._slot(pairs)
        out = self.ranks[slot]
        other = np.flatnonzero((self.pairs[slot] != pairs) & (out != NONE))
        out[other] = NONE
        while len(other):
            slot[other] = slot[other] + 1 & (1 << self.bits) - 1
            rank = self.ranks[slot[other]]
            same = self.pairs[slot[other]] == pairs[other]
            out[other[same]] = rank[same]
            other = other[~same & (rank != NONE)]
        return out

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each word's begin."""
        counts, found, low = np.zeros(len(starts), np.int64), [], 0
        for width in WIDTHS:
            some = np.flatnonzero((lengths > low) & (lengths <= width))
            if len(some):
                parts = self._merged(data, starts[some], lengths[some], width).T
                live = parts >= 0
                counts[some] = live.sum(axis=1)
                found.append((some, parts[live]))
            low = width
        for i in np.flatnonzero(lengths > WIDEST).tolist():
            ids = self.alone(data[starts[i] : starts[i] + lengths[i]].tobytes())
            counts[i] = len(ids)
            found.append((np.array([i]), np.array(ids, np.int32)))
        begins = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), "<u4")
        for some, ids in found:
            out[spread(begins[some], counts[some])] = ids
        return out, begins

    def _merged(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
        """A column of ``width`` parts a word, -1 where a part has gone into another."""
        n, rows = len(starts), np.arange(width, dtype=np.int32)[:, None]
        inside = rows < lengths
        letters = data[np.minimum(starts + rows, len(data) - 1)]
        out = np.where(rows == lengths - 1, self.last[letters], self.first[letters])
        out[~inside] = -1
        keys = np.full((width + 1, n), NONE)
        two = letters[:-1].astype(np.int32) << 8 | letters[1:]
        rank = np.where(rows[1:] == lengths - 1, self.ending[two], self.inner[two])
        keys[: width - 1] = np.where(inside[1:] & (rank != NONE), rank << 6 | rows[:-1], NONE)
        parts, names, lengths = out.copy(), np.arange(n), lengths.astype(np.int32)
        after, before = np.repeat(rows + 1, n, axis=1), np.repeat(rows - 1, n, axis=1)
        while True:
            least = keys.min(axis=0)
            c = np.flatnonzero(least != NONE)
            if 4 * len(c) < 3 * len(names):  # those that are done are left behind
                out[:, names] = parts
                if not len(c):
                    return out
                parts, keys, after, before = (np.ascontiguousarray(x[:, c]) for x in (parts, keys, after, before))
                names, lengths, least, c = names[c], lengths[c], least[c], np.arange(len(c))
            m = len(names)
            part, key, next_, last = parts.ravel(), keys.ravel(), after.ravel(), before.ravel()
            row = least[c] & 63
            i = row * m + c
            j = next_[i] * m + c
            part[i], part[j], key[i], key[j] = self.merged[least[c] >> 6], -1, NONE, NONE
            row2 = next_[j]
            next_[i] = row2
            has = np.flatnonzero(row2 < lengths[c])
            k = row2[has] * m + c[has]
            last[k] = row[has]
            rank = self.rank(part[i[has]], part[k])
            key[i[has]] = np.where(rank == NONE, NONE, rank << 6 | row[has])
            row0 = last[i]
            has = np.flatnonzero(row0 >= 0)
            h = row0[has] * m + c[has]
            rank = self.rank(part[h], part[i[has]])
            key[h] = np.where(rank == NONE, NONE, rank << 6 | row0[has])


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... (counts[0] of them), begins[1], ..."""
    ends = np.cumsum(counts)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, int(begins.max(initial=0)) + n) < 1 << 31 else np.int64
    return np.repeat((begins - (ends - counts)).astype(kind), counts) + np.arange(n, dtype=kind)


def same_words(data: np.ndarray, starts: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> bool:
    """Is each word's text that of the other one of its length? Eight bytes at a time."""
    eight = sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    while len(starts):
        one, two = (eight[x].view("<u8")[:, 0] for x in (starts, others))
        if ((one ^ two) & FIRST[np.minimum(lengths, 8)]).any():
            return False
        more = lengths > 8
        starts, others, lengths = starts[more] + 8, others[more] + 8, lengths[more] - 8
    return True


def cut_at_contractions(data: np.ndarray, kinds: np.ndarray, edge: np.ndarray, limit: np.ndarray, spaced: bool) -> None:
    """A single apostrophe goes with the s, t, m, d, re, ve or ll after it; with ``spaced`` not
    where a blank before it belongs to its word. ``limit`` marks the begins of texts."""
    n = len(data)
    at = np.flatnonzero(data == 0x27)
    at = at[edge[at] & edge[at + 1] & (at + 1 < n)]
    at = at[~limit[at + 1] & (kinds[np.minimum(at + 1, n - 1)] == LETTER)]
    if spaced:
        at = at[limit[at] | (at == 0) | (data[at - 1] != 0x20)]
    one, two = data[at + 1], np.where(at + 2 < n, data[np.minimum(at + 2, n - 1)], 0)
    two[limit[np.minimum(at + 2, n)]] = 0
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = np.isin(one.astype(np.int32) << 8 | two, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
    edge[at[short | long] + 1] = False
    edge[at[short] + 2] = True
    edge[at[long] + 3] = True


def id_blocks(texts: pa.Array, cut: Callable, merges: Merges) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of texts its ids and where each text's begin (and the last one's end).
    ``cut(data, offsets)`` gives starts and ends of the words."""
    data, offsets = text_bytes(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        yield block_ids(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], cut, merges)
        first = last


def block_ids(data: np.ndarray, offsets: np.ndarray, cut: Callable, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = cut(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 2
    if not len(starts):
        return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
    lengths = ends - starts
    _, which = np.unique(span_hashes(data, starts, ends), return_inverse=True)
    one = np.empty(int(which.max()) + 1, np.int64)
    one[which] = np.arange(len(which))
    begins = starts[one][which]
    if not (np.array_equal(lengths[one][which], lengths) and same_words(data, starts, begins, lengths)):
        one = which = np.arange(len(starts))  # two words of one hash: each word by itself
    ids, at = merges.words(data, starts[one], lengths[one])
    counts = np.diff(np.append(at, len(ids)))[which]
    ends = np.concatenate([[0], np.cumsum(counts)])
    return ids[spread(at[which], counts)], ends[np.searchsorted(starts, offsets)]


def common(text: str, special: Iterable[str]) -> bool:
    """Can ``encode_all`` take the text? Very long ones, which would be a block of their own, it does not."""
    return len(text) <= 4 * BLOCK and not (UNCOMMON.search(text) or any(s in text for s in special))


def encode_all(texts: list[str], cut: Callable, merges: Merges) -> Iterator[bytes]:
    """Packed ids of each text; all are common."""
    for ids, begins in id_blocks(pa.array(texts, pa.large_string()), cut, merges):
        packed, ends = ids.tobytes(), (4 * begins).tolist()
        yield from (packed[a:b] for a, b in zip(ends, ends[1:]))
