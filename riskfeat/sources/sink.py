"""Writing feature tables and score files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_features(df: DataFrame, path: str, partition_by: str | None = "split") -> None:
    """Parquet, one folder per split, so a reader of one split skips the other."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_scores(df: DataFrame, path: str) -> None:
    """CSV parts with a header, written by all tasks at once."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
