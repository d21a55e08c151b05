"""Hashed n-gram indicators of whole texts, and linear models over them, in tasks.

The features of a text are the distinct buckets of its n-grams. A model is sparse: it
names the buckets that have a weight, so what is broadcast depends on the sample it was
fitted on (a parameter) and not on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfeat.llm.hashing import RUNS, U, combine, mix, word_hashes
from riskfeat.llm.vocab import forget

REPEAT = mix(np.array([0x5265706561740000], U))  # the n-gram "a word right after itself"


@dataclass(frozen=True)
class Ngrams:
    """Which n-grams: words, ``bigrams``, pairs with up to ``skips`` words between."""

    bits: int = 22
    lower: bool = True
    skips: int = 0
    repeats: bool = False

    def blocks(self, texts: pa.Array, used: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, number of texts, text of each feature, bucket) with each pair
        once, sorted. With ``used`` (a flag for each bucket) only those buckets."""
        down = U(64 - self.bits)
        for first, words, begins in word_hashes(texts, RUNS, self.lower):
            n = len(begins) - 1
            text = np.repeat(np.arange(n), np.diff(begins))
            found = []

            def add(hashes: np.ndarray, of: np.ndarray) -> None:
                bucket = (hashes >> down).astype(np.int64)
                if used is not None:
                    keep = used[bucket]
                    bucket, of = bucket[keep], of[keep]
                found.append(of << self.bits | bucket)

            add(words, text)
            for gap in range(1, 2 + self.skips):
                same = text[gap:] == text[:-gap]
                a, b = words[:-gap][same], words[gap:][same]
                add(combine(a, b + U(gap)), text[gap:][same])
                if gap == 1 and self.repeats:
                    of = text[1:][same][a == b]
                    add(np.repeat(REPEAT, len(of)), of)
            pairs = np.unique(np.concatenate(found))
            yield first, n, pairs >> self.bits, pairs & ((1 << self.bits) - 1)

    def packed(self):
        """A column function: text -> its buckets, 4 bytes each, little-endian, rising."""

        @F.arrow_udf("binary")
        def extract(texts: pa.Array) -> pa.Array:
            rows: list[bytes] = []
            for _, n, text, bucket in self.blocks(texts):
                ends = np.searchsorted(text, np.arange(n + 1))
                rows += [bucket[i:j].astype("<u4").tobytes() for i, j in zip(ends, ends[1:])]
            return pa.array(rows, pa.binary())

        return extract


@dataclass
class Linear:
    """Score = 1 / (1 + exp(-(slope * margin + shift))); the margin is the sum of the
    weights of a text's buckets, over the root of the sum of squares of their scales if
    there are scales, plus the bias. ``buckets`` rise."""

    ngrams: Ngrams
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    scales: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A flag for each bucket, the flags as words of 64 bits, and the number of flags before
        each word: a byte and a fifth a bucket, where a table of each value took nine."""
        used = np.zeros(max(64, 1 << self.ngrams.bits), bool)
        used[self.buckets] = True
        words = np.packbits(used, bitorder="little").view("<u8")
        return used, words, np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)

    def places(self, bucket: np.ndarray) -> np.ndarray:
        """Where ``buckets`` holds each given one, which has to be among them."""
        _, words, before = self.tables
        word, below = bucket >> 6, (U(1) << (bucket & 63).astype(U)) - U(1)
        return before[word] + np.bitwise_count(words[word] & below)

    def score(self, texts: pa.Array) -> np.ndarray:
        used = self.tables[0]
        out = np.empty(len(texts))
        for first, n, text, bucket in self.ngrams.blocks(texts, used):
            at = self.places(bucket)
            margin = np.bincount(text, self.weights[at], n).astype(float)
            if self.scales is not None:
                margin /= np.sqrt(np.maximum(np.bincount(text, self.scales[at].astype(float) ** 2, n), 1e-12))
            out[first : first + n] = margin + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.shift, -500, 500)))


def sample_features(docs: DataFrame, rows: DataFrame, ngrams: Ngrams, key: str, text: str):
    """(labels, begins, buckets) of the rows to learn from, on the driver. ``rows`` comes
    from learn_rows and so is small by its own limit; it is broadcast to find the texts."""
    picked = docs.select(F.col(key).alias("id_"), F.col(text).alias("text_")).join(F.broadcast(rows), F.expr("id_ = key_"))
    got = picked.select("id_", "label_", ngrams.packed()("text_").alias("packed_")).toArrow().sort_by([("id_", "ascending"), ("packed_", "ascending")])
    packed = got["packed_"].combine_chunks().cast(pa.large_binary())
    if not len(packed):
        return np.zeros(0, int), np.zeros(1, int), np.zeros(0, np.uint32)
    begins = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1] // 4
    data = np.frombuffer(packed.buffers()[2], "<u4") if packed.buffers()[2] is not None else np.zeros(0, "<u4")
    return got["label_"].to_numpy(), begins, data


def numbered(buckets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets in order, and for each given bucket its place among them."""
    held = np.zeros(1 << bits, bool)
    held[buckets] = True
    known = np.flatnonzero(held)
    place = np.zeros(1 << bits, np.int32)
    place[known] = np.arange(len(known))
    return known, place[buckets]


def score_column(spark, model: Linear):
    """A column function: text -> score from 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            yield pa.array(model.score(texts))
        # a worker that waits for its next task keeps neither tables nor free memory
        model.__dict__.pop("tables", None)
        forget()

    return score
