"""What filters take from a corpus, alone and together, in every order.

1. Each document gets the set of filters it fails, as bits. The filters on texts are one
   pass over the texts; the copy filter compares a text's SHA-256 with the smallest id of
   all rows with that digest, from one aggregate.
2. A document's survival word has bit S set if it survives all filters of the subset S, so
   five filters make a word of 32 bits, the truth table of its survival.
3. Positional popcounts of the words, by part and label, are the survivors of every subset.
   They are counted with carry-save adders: three words become a sum word and a carry word
   of twice the weight, over whole arrays, until at most two words of each weight are left.
4. The report of every order follows from these 32 counts a part: what a filter removes after
   others is a difference of two subsets' survivors. No order reads the documents again.

Memory: a batch of words in a task, 96 counts a part after the sums. Copies of one text are
pre-aggregated, and the join that brings their smallest id back can be split by Spark.

Defined results: a null text is an empty text, and both are copies of each other; a null part
is the empty string; a row without an id is no smaller copy and fails the copy filter never;
rows that repeat an id are documents each, and no copies by that alone; of several labels of an
id the largest counts, null is none; very long texts are read whole; other columns are not
read; an empty table gives an empty report.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.session import materialize

UPPER = bytes(range(0x41, 0x5B))
SIGNS = re.compile(rb"[#$%&*|]")


@dataclass(frozen=True)
class TextFilter:
    """``fails(text, raw, words)``: the text, its UTF-8 bytes, its words."""

    letter: str
    fails: Callable[[str, bytes, list[bytes]], bool]


TEXT_FILTERS = (
    TextFilter("A", lambda text, raw, words: len(words) < 200),
    TextFilter("B", lambda text, raw, words: 100 * len(set(words)) < 50 * len(words)),
    TextFilter("C", lambda text, raw, words: 100 * (len(raw) - len(raw.translate(None, UPPER))) > 3 * len(text)),
    TextFilter("D", lambda text, raw, words: SIGNS.search(raw) is not None),
)
#: The filter on copies comes after those on texts.
COPY = "E"


def judged_column(filters: tuple[TextFilter, ...] = TEXT_FILTERS):
    """A column function: text -> the filters it fails, as bits, and the SHA-256 of the text."""

    @F.arrow_udf("struct<failed:int,digest:binary>")
    def judge(texts: pa.Array) -> pa.Array:
        failed, digests = [], []
        for value in texts:
            text = value.as_py() or ""
            raw = text.encode()
            words = raw.split()  # bytes are split at space, tab, LF, VT, FF and CR
            failed.append(sum(f.fails(text, raw, words) << i for i, f in enumerate(filters)))
            digests.append(sha256(raw).digest())
        return pa.StructArray.from_arrays([pa.array(failed, pa.int32()), pa.array(digests, pa.binary())], ["failed", "digest"])

    return judge


def failures(docs: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text", filters: tuple[TextFilter, ...] = TEXT_FILTERS) -> DataFrame:
    """Per document: id, part, failed; the copy filter has the bit after those of ``filters``."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), judged_column(filters)(F.col(text)).alias("j"))
    rows = materialize(rows.select("id", "part", "j.failed", "j.digest"))  # two readers
    first = rows.groupBy("digest").agg(F.min("id").alias("first"))
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    return rows.join(first, "digest").select("id", "part", (F.col("failed") + F.shiftleft(copy, len(filters))).alias("failed"))


def labelled(rows: DataFrame, labels: DataFrame, kinds: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """The rows with a 0/1 column for each kind of label."""
    held = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(*[F.max((F.col(k) == 1).cast("int")).alias(f"is_{k}") for k in kinds])
    joined = rows.join(held, "id", "left")
    return joined.select(*rows.columns, *[F.coalesce(f"is_{k}", F.lit(0)).alias(f"is_{k}") for k in kinds])


def survival_words(n: int) -> np.ndarray:
    """For each set of failed filters, the word whose bit S says that the subset S keeps it."""
    subsets = np.arange(1 << n, dtype=np.uint64)
    return np.array([np.bitwise_or.reduce(np.where(subsets & np.uint64(f) == 0, np.uint64(1) << subsets, np.uint64(0))) for f in range(1 << n)], np.uint64)


def positional_popcount(words: np.ndarray, width: int) -> np.ndarray:
    """How many words have each bit set."""
    counts, weight, bits = np.zeros(width, np.int64), 1, np.arange(width, dtype=np.uint64)
    while len(words):
        carries = []
        while (n := len(words) // 3) :
            a, b, c = words[:n], words[n : 2 * n], words[2 * n : 3 * n]
            half = a ^ b
            carries.append(a & b | half & c)
            words = np.concatenate([half ^ c, words[3 * n :]])
        counts += weight * ((words[:, None] >> bits) & np.uint64(1)).sum(axis=0).astype(np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return counts


def survivors(rows: DataFrame, kinds: tuple[str, ...], n: int) -> DataFrame:
    """Per part: ``all`` and each kind, arrays of the survivors of every subset of n filters."""
    width, table, names = 1 << n, survival_words(n), ["all", *kinds]
    fields = [pa.field("part", pa.string()), *(pa.field(f"{k}_{s}", pa.int64()) for k in names for s in range(width))]

    def count(batches):
        for batch in batches:
            words = table[batch["failed"].to_numpy()]
            held = [np.ones(len(words), bool), *(batch[f"is_{k}"].to_numpy() == 1 for k in kinds)]
            parts = batch["part"].dictionary_encode()
            of = parts.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(len(parts.dictionary) + 1))
            found = [[positional_popcount(words[order[i:j]][h[order[i:j]]], width) for h in held] for i, j in zip(ends, ends[1:])]
            columns = np.array(found, np.int64).reshape(len(found), -1).T
            yield pa.RecordBatch.from_arrays([parts.dictionary, *map(pa.array, columns)], schema=pa.schema(fields))

    schema = "part string, " + ", ".join(f"`{f.name}` long" for f in fields[1:])
    counted = rows.select("part", "failed", *[f"is_{k}" for k in kinds]).mapInArrow(count, schema)
    summed = counted.groupBy("part").agg(*[F.sum(f.name).alias(f.name) for f in fields[1:]])
    return summed.select("part", *[F.array(*[F.col(f"{k}_{s}") for s in range(width)]).alias(k) for k in names])


def report(parts: DataFrame, letters: str, lost: dict[str, str]) -> DataFrame:
    """One row per part, order of the filters and step, from the survivors of every subset.
    ``lost`` names the columns of removed documents of a kind."""
    n = len(letters)
    orders = ["".join(p) for p in permutations(letters)]
    bit = lambda x: F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(letters), x) - 1)
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    before = reduce(Column.__add__, [F.when(F.col("step") > i, bit(F.substring("filter_order", i, 1))).otherwise(0) for i in range(1, n)], F.lit(0))
    steps = steps.withColumn("own", bit(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("before", before)

    def left(kind: str, subset) -> Column:
        return F.get(F.col(kind), subset)

    everything = F.lit((1 << n) - 1)
    own, with_own = F.col("own"), F.col("before") + F.col("own")
    removed = left("all", F.col("before")) - left("all", with_own)
    # a filter stands at each place after a subset of the others in |S|! (n - 1 - |S|)! orders
    factorial = [1]
    for i in range(1, n + 1):
        factorial.append(factorial[-1] * i)
    times = [factorial[s.bit_count()] * factorial[n - 1 - s.bit_count()] if s.bit_count() < n else 0 for s in range(1 << n)]
    taken = [F.when(own.bitwiseAND(F.lit(s)) == 0, F.lit(t) * (left("all", F.lit(s)) - left("all", F.lit(s) + own))).otherwise(0) for s, t in enumerate(times) if t]
    return steps.select(
        "part", "filter_order", "step", left("all", with_own).alias("kept"), removed.alias("removed"),
        (left("all", F.lit(0)) - left("all", own) - removed).alias("redundant"),
        (left("all", everything - own) - left("all", everything)).alias("unique_fails"),
        *[(left(kind, F.col("before")) - left(kind, with_own)).alias(name) for kind, name in lost.items()],
        reduce(Column.__add__, taken).alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, part: str = "lang", lost: dict[str, str] | None = None, key: str = "doc_id",
    text: str = "text", filters: tuple[TextFilter, ...] = TEXT_FILTERS,
) -> DataFrame:
    """The report of every order of the filters, by part."""
    lost = lost or {"quality": "good_lost", "toxic": "toxic_lost"}
    kinds, letters = tuple(lost), "".join(f.letter for f in filters) + COPY
    rows = labelled(failures(docs, part, key, text, filters), labels, kinds, key)
    return report(materialize(survivors(rows, kinds, len(letters))), letters, lost)
