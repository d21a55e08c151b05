"""Session settings the jobs rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Runtime settings applied only where the user has not chosen a value.
# forceOptimizeSkewedJoin lets adaptive execution split a hot key inside a join
# whose output is aggregated by the same key: each split is pre-aggregated and
# only the partial rows are shuffled again.
# maxPartitionBytes, advisoryPartitionSizeInBytes: an aggregate with nearly as many groups as
# rows holds all rows of a split or of a coalesced partition, several times their size on
# disk; smaller ones fit in a task's memory and do not spill.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply RUNTIME_DEFAULTS to a session, keeping every explicit user choice."""
    for key, value in RUNTIME_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", scratch: str = "") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskfeat")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # call-site capture on every Column call makes wide plans slow to build
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or where that is
    unset a folder in the session's warehouse. A warehouse on local disks serves a local
    session only: on a cluster every executor would write to its own."""
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    one_machine = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if not one_machine and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/_riskfeat"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark).rstrip("/"), "riskfeat", f"{name}-{uuid.uuid4().hex}")


#: Shuffle files go when their query ends; else they stay until the driver's JVM happens to
#: collect what refers to them.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers = threading.Lock(), Counter()


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """FILE_CLEANUP for the queries that begin within, where the user has not chosen a value.
    Writers of a session may overlap: the first sets it, the last one takes it back."""
    me = id(spark)
    with _lock:
        if _writers[me] or spark.conf.get(FILE_CLEANUP, None) is None:
            spark.conf.set(FILE_CLEANUP, "true")
            _writers[me] += 1
            mine = True
        else:
            mine = False
    try:
        yield
    finally:
        with _lock:
            _writers[me] -= mine
            if mine and not _writers[me]:
                spark.conf.unset(FILE_CLEANUP)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write the rows once as a table in the shared folder and read them back.

    Cuts the lineage, survives lost executors, and later readers prune columns
    and know the size. Column metadata is kept. The shuffle files of the write go at its end. With ``partition_by`` (last in the result) a
    reader of some of these values skips the files of the others.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    with _shuffles_dropped(spark):
        df.write.parquet(path, partitionBy=partition_by or None)
    saved = spark.read.schema(df.schema).parquet(path)
    saved.scratch_path = path
    return saved


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made and no later step reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Let long-running learners cut their lineage in the shared folder.

    Boosting over hundreds of rounds checkpoints its running prediction every
    few rounds, but only where a checkpoint folder is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))


def keep(df: DataFrame) -> DataFrame:
    """Cache that spills to disk and is recomputed from lineage when lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
