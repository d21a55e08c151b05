"""Small helpers of the operators on frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or a longer one that no column of the frames has in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def learn_rows(labels: DataFrame, label: str, held_out, most: int, key: str = "doc_id") -> DataFrame:
    """(key, label) of ``most`` rows at most to learn from: those with a label that are
    not held out, of several for a key the largest, in the order of the key's hash. So it
    is a fixed random sample of known size, whatever the number of labels."""
    return (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(key).agg(F.max(label).cast("int").alias("label_"))
        .select(F.col(key).alias("key_"), "label_")
        .orderBy(F.xxhash64("key_"), "key_").limit(most)
    )


def remainder(key, n: int):
    """crc32 of the key as text, modulo n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n
