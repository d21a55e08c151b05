"""Byte-level BPE, encoded and decoded in tasks.

Ids travel packed: one binary value per text, 4 bytes per id, little-endian. A text is
cut into words by the tokenizer's own pattern; a word keeps its parts and the ranks of
neighbouring parts in two contiguous lists; texts of common letters are taken a block at a
time, all their words at once (see ``merges``). The smallest rank is looked for again and
again, its boundary is deleted and the two neighbouring ranks are refreshed. Words of
more than LONG_WORD bytes (one run of letters can fill a whole text) go through a heap
over linked parts instead, which gives the same ids in n log n steps.

Defined results: a null text is an empty text, an empty text has no ids; a special
token's string in a text becomes its single id, as the tokenizer file says; ids outside
the vocabulary are skipped in decoding; bytes that are not UTF-8 decode to U+FFFD.
Rows are mapped one by one, so ties, repeated rows and extra columns stay as they are.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from riskfeat.llm.merges import KINDS, SPACE, UNCOMMON, Merges, common, cut_at_contractions, encode_all
from riskfeat.llm.vocab import VocabFile, WordCache

#: The pattern of byte-level tokenizers. Fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 64
#: The same words for a text of COMMON letters only, in the quicker of two regex libraries.
COMMON_WORDS = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NO_RANK = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """COMMON_WORDS of texts of common letters, from their bytes: starts and ends."""
    kinds, limit = KINDS[data], np.zeros(len(data) + 1, bool)
    limit[offsets] = True
    edge = limit.copy()
    edge[1:-1] |= kinds[1:] != kinds[:-1]
    cut_at_contractions(data, kinds, edge, limit, True)
    # of a run of white space its last letter is cut off; a blank goes with what follows
    ends = np.flatnonzero(edge[1:] & (kinds == SPACE)) + 1
    ends = ends[~limit[ends]]
    edge[ends - 1] = True
    edge[ends[data[ends - 1] == 0x20]] = False
    at = np.flatnonzero(edge)
    return at[:-1], at[1:]


class ByteBpe:
    """One tokenizer file's ranks, with the cache of words already encoded."""

    def __init__(self, text: str):
        file = json.loads(text)
        vocab, letters = file["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        #: (left id, right id) -> rank of the merge << 32 | id of the merged part
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(file["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocab[left], vocab[right]] = rank << 32 | vocab[left + right]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = {k: np.uint32(v).tobytes() for k, v in special.items()}
        longest_first = sorted(special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if special else None
        self.bytes_of = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.find, self.find_common = regex.compile(WORDS).findall, re.compile(COMMON_WORDS).findall
        self.cache = WordCache(lambda word: np.array(self.word_ids(word.encode()), "<u4").tobytes())
        self.merges = Merges(self.byte_ids, self.byte_ids, self.ranks, self.word_ids)

    def word_ids(self, word: bytes) -> list[int]:
        parts = [self.byte_ids[b] for b in word]
        if len(parts) > LONG_WORD:
            return self._long_word(parts)
        get = self.ranks.get
        ranks = [get(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = least & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NO_RANK)
        return parts

    def _long_word(self, parts: list[int]) -> list[int]:
        """Least rank first, then leftmost, as above; parts are linked, dead ones hold -1."""
        n, get = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = rank & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def _plain(self, text: str) -> bytes:
        find = self.find if UNCOMMON.search(text) else self.find_common
        return b"".join(map(self.cache.__getitem__, find(text)))

    def encode(self, text: str) -> bytes:
        self.cache.trim()
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special.get(t) or self._plain(t) for t in self.special_pattern.split(text))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """As ``encode``, the common texts block by block."""
        blockwise = [common(t, self.special) for t in texts]
        found = encode_all([t for t, b in zip(texts, blockwise) if b], spaced_words, self.merges)
        return [next(found) if b else self.encode(t) for t, b in zip(texts, blockwise)]

    def decode(self, packed: bytes) -> str:
        table, n = self.bytes_of, len(self.bytes_of)
        ids = np.frombuffer(packed, "<u4").tolist()
        if ids and max(ids) >= n:
            ids = [i for i in ids if i < n]
        return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


def encoder(spark: SparkSession, path: str):
    """A column function: text -> packed ids (binary)."""
    file = VocabFile(spark, path)

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        bpe = file.parsed(ByteBpe)
        return pa.array(bpe.encode_all([t or "" for t in texts.to_pylist()]), pa.binary())

    return encode


def decoder(spark: SparkSession, path: str):
    """A column function: packed ids -> text; null stays null."""
    file = VocabFile(spark, path)

    @F.arrow_udf("string")
    def decode(packed: pa.Array) -> pa.Array:
        bpe = file.parsed(ByteBpe)
        return pa.array([None if p is None else bpe.decode(p) for p in packed.to_pylist()], pa.string())

    return decode


def n_ids(packed: Column) -> Column:
    return F.floor(F.octet_length(packed) / 4).cast("long")
