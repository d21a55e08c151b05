"""Packs tokenized texts into sequences of a fixed capacity.

Pieces of one length are alike, so the packing itself needs only how many there are of
each length (at most ``capacity`` numbers). Pieces above a third of the capacity fit at
most twice in a sequence: they are matched greedily, the longest with the longest that
still fits. Shorter ones follow in falling length, each into the smallest gap that takes
it, and open a sequence when none does. Everything is placed in bulk, so the plan has a
few thousand rows at most whatever the number of pieces.

A piece finds its place by its rank among the pieces of its length. Ranks are counted in
SALTS shares of every length, each share by its own window, so the commonest length is
spread too; the driver sees capacity x SALTS counts at most.

Defined results: a null text is an empty text and gives one piece with the end id alone;
repeated rows are packed each; a text longer than the capacity is cut into pieces of
exactly the capacity and a rest; no documents give no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from riskfeat.llm.bpe import byte_letters
from riskfeat.llm.hashing import SLICE
from riskfeat.llm.merges import DIGIT, KINDS, SPACE, UNCOMMON, Merges, common, cut_at_contractions, encode_all
from riskfeat.llm.vocab import VocabFile, WordCache, forget
from riskfeat.session import materialize

SALTS = 64
LETTERS = byte_letters()
PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"

#: The words of a text of common letters; other texts, and those that hold a special token,
#: go to the tokenizer whole.
COMMON_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordEndBpe:
    """Ids of a lower-casing BPE tokenizer with word ends: of many texts block by block, of one from
    caches of words and of what white space divides."""

    def __init__(self, text: str):
        self.text = text
        file = json.loads(text)
        self.special = [t["content"] for t in file["added_tokens"]]
        vocab, ranks = file["model"]["vocab"], {}
        for rank, merge in enumerate(file["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks[vocab[left], vocab[right]] = rank << 32 | vocab[left + right]
        ends = [vocab[c + file["model"]["end_of_word_suffix"]] for c in LETTERS]
        self.words, self.chunks = WordCache(self.word, size=150_000), WordCache(self.chunk, size=250_000)
        self.merges = Merges([vocab[c] for c in LETTERS], ends, ranks, lambda word: np.frombuffer(self.word(word.decode()), "<u4"))

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """Of texts and words that are not merged here, so often not needed."""
        tokenizer = Tokenizer.from_str(self.text)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return tokenizer

    @cached_property
    def model(self):
        return self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """One word goes straight to the merges, its bytes as the vocabulary's letters."""
        letters = word if word.isascii() and word.isprintable() else "".join(map(LETTERS.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """What stands between white space, which no word crosses."""
        return b"".join(map(self.words.__getitem__, COMMON_WORDS.findall(chunk)))

    def encode(self, text: str) -> bytes:
        self.words.trim()
        self.chunks.trim()
        if UNCOMMON.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """As ``encode``, the common texts block by block; their letters stay letters in lower case."""
        blockwise = [common(t, self.special) for t in texts]
        found = encode_all([t.lower() for t, b in zip(texts, blockwise) if b], single_words, self.merges)
        return [next(found) if b else self.encode(t) for t, b in zip(texts, blockwise)]


def single_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """COMMON_WORDS of lower-case texts, from their bytes: starts and ends."""
    kinds, limit = KINDS[data], np.zeros(len(data) + 1, bool)
    limit[offsets] = True
    edge = limit.copy()
    edge[1:-1] |= (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
    cut_at_contractions(data, kinds, edge, limit, False)
    at = np.flatnonzero(edge)
    word = kinds[at[:-1]] != SPACE
    return at[:-1][word], at[1:][word]


def token_encoder(spark: SparkSession, path: str, end_id: int | None = 0):
    """A column function: text -> packed ids (4 bytes each, little-endian), then the end id."""
    file = VocabFile(spark, path)
    end = b"" if end_id is None else np.uint32(end_id).tobytes()

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        bpe = file.parsed(WordEndBpe)
        return pa.array([ids + end for ids in bpe.encode_all([t or "" for t in texts.to_pylist()])], pa.binary())

    return encode


def piece_column(spark: SparkSession, path: str, capacity: int, end_id: int | None = 0):
    """A column function: text -> its pieces of at most ``capacity`` ids."""
    file = VocabFile(spark, path)
    end, step = b"" if end_id is None else np.uint32(end_id).tobytes(), 4 * capacity

    def pieces_of(texts: pa.Array) -> pa.Array:
        bpe = file.parsed(WordEndBpe)
        ends, piece, start, length, crc = [0], [], [], [], []
        for ids in (ids + end for begin in range(0, len(texts), SLICE) for ids in bpe.encode_all([t or "" for t in texts.slice(begin, SLICE).to_pylist()])):
            for n, i in enumerate(range(0, len(ids), step)):
                part = ids[i : i + step]
                piece.append(n)
                start.append(i // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
            ends.append(len(piece))
        columns = [pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["piece", "start", "length", "ids_crc32"]))

    @F.arrow_udf(PIECES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(pieces_of, batches)
        forget()  # Spark keeps more workers than it uses; the waiting ones hold no caches

    return cut


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int | None = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: the key, piece, start, length, ids_crc32."""
    cut = piece_column(docs.sparkSession, path, capacity, end_id)
    return docs.select(F.col(key), cut(F.col(text)).alias("cut")).select(key, F.inline("cut"))


@dataclass
class Bins:
    """``count`` sequences alike: runs of (length, how many of it), and what is free."""

    count: int
    runs: list[tuple[int, int]]
    gap: int


def plan(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Sequences for ``counts[length]`` pieces of each length up to ``capacity``."""
    left = Counter({k: v for k, v in counts.items() if v})
    done: list[Bins] = []
    by_gap: list[list[Bins]] = [[] for _ in range(capacity + 1)]

    def put(count: int, runs: list[tuple[int, int]], gap: int) -> None:
        if count:
            (by_gap[gap] if gap else done).append(Bins(count, runs, gap))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        for b in large:
            if not left[a]:
                break
            if a + b <= capacity and b <= a and left[b]:
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put(n, [(a, 2)] if a == b else [(a, 1), (b, 1)], capacity - a - b)
                left[a] -= n
                left[b] -= n
        put(left[a], [(a, 1)], capacity - a)
        left[a] = 0
    for a in sorted((k for k in left if left[k] and 3 * k <= capacity), reverse=True):
        need, gap = left[a], a
        while need:
            while gap <= capacity and not by_gap[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // a
                put(need // each, [(a, each)], capacity - each * a)
                put(1 if need % each else 0, [(a, need % each)], capacity - need % each * a)
                break
            bins, each = by_gap[gap][-1], gap // a
            n = min(bins.count, need // each)
            if not n:
                n, each = 1, need
            bins.count -= n
            if not bins.count:
                by_gap[gap].pop()
            put(n, bins.runs + [(a, each)], gap - each * a)
            need -= n * each
    return done + [b for bins in by_gap for b in bins]


def place_table(bins: list[Bins]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (length << 44 | first rank), and for each: first rank, first sequence,
    pieces of that length in one sequence, offset of the first."""
    rank, sequence, rows = Counter(), 0, []
    for b in bins:
        offset = 0
        for length, each in b.runs:
            rows.append((length << 44 | rank[length], rank[length], sequence, each, offset))
            rank[length] += each * b.count
            offset += each * length
        sequence += b.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table[:, 0].copy(), table[:, 1:].copy()


def assign(cut: DataFrame, capacity: int = 2048, salts: int = SALTS) -> DataFrame:
    """The pieces (rows with piece, start, length) with sequence_id and offset."""
    names = cut.columns
    salt = F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int")
    saved = materialize(cut.withColumn("salt_", salt))  # two readers, and tokenized once
    counts = saved.groupBy("length", "salt_").count().collect()  # capacity x salts rows at most
    share = np.zeros((capacity + 1, salts), np.int64)
    for r in counts:
        share[r["length"], r["salt_"]] = r["count"]
    keys, places = place_table(plan({k: int(n) for k, n in enumerate(share.sum(axis=1)) if n}, capacity))
    known = cut.sparkSession.sparkContext.broadcast((np.cumsum(share, axis=1) - share, keys, places))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, salt: pa.Array, number: pa.Array) -> pa.Array:
        before, keys, places = known.value
        length = length.to_numpy(zero_copy_only=False)
        rank = before[length, salt.to_numpy(zero_copy_only=False)] + number.to_numpy(zero_copy_only=False) - 1
        first, sequence, each, offset = places[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
        nth = rank - first
        return pa.StructArray.from_arrays(
            [pa.array(sequence + nth // each), pa.array(offset + nth % each * length)], ["sequence_id", "offset"]
        )

    share_window = Window.partitionBy("length", "salt_").orderBy(*names)
    return (
        saved.withColumn("number_", F.row_number().over(share_window))
        .withColumn("place_", place("length", "salt_", F.col("number_").cast("long")))
        .select(*names, "place_.sequence_id", "place_.offset")
    )


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int | None = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every text with its sequence and its place there."""
    return assign(pieces(docs, path, capacity, end_id, key, text), capacity)
