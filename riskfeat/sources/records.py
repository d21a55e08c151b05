"""CSV records that may hold line breaks, read by as many tasks as the file has blocks.

Spark reads such a file in one task, as it cannot know from the middle of a file whether a
line break stands within quotes. Here every block says how its lines change the state, from
outside and from inside of quotes. Chaining the blocks, one small row each, gives the state at
the start of every block; then each task cuts its own block into records. Only the ends of
blocks that a record runs across are brought together. A first look finds out whether any
line leaves a quote open at all; without one the lines are the records.

A quoted cell begins right after a comma or a line's start, and quotes in it are doubled, as in
Spark's own reader; a quote elsewhere is a letter. An unclosed quote makes the rest of its
file one record, there as here.

The driver holds one small row for each block, fewer bytes than Spark's own list of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?,)*+'
QUOTED = r'"(?:[^"]++|"")*+'
#: A line that starts outside of quotes and ends inside.
OPENS = CELLS + QUOTED
_OPENS, _INSIDE, _REST = re.compile(OPENS, re.DOTALL), re.compile(r'(?:[^"]++|"")*+', re.DOTALL), re.compile(r'"[^,]*+', re.DOTALL)

BLOCK_SCHEMA = "file long, block long, from_outside boolean, from_inside boolean, closes boolean"
RECORD_SCHEMA = "file long, block long, owner long, header boolean, text string"


def ends_inside(line: str, inside: bool) -> bool:
    """The state after a line, from the state before it."""
    at = 0
    if inside:
        at = _INSIDE.match(line).end()
        if at == len(line):
            return True
        at = _REST.match(line, at).end()
        if at == len(line):
            return False
        at += 1  # the comma
    return '"' in line[at:] and _OPENS.fullmatch(line, at) is not None


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): lines with their ends, and the block each begins in."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], str, bool]]:
    """((file, block), line, whether it is the block's first); the lines of a block follow one another."""
    last = None
    for batch in batches:
        for key, value in zip(zip(batch["file"].to_pylist(), batch["block"].to_pylist()), batch["value"].to_pylist()):
            yield key, value, key != last
            last = key


def block_states(lines: DataFrame) -> dict[tuple[int, int], tuple[bool, int | None]]:
    """(file, block) -> whether it starts inside of quotes, and the block where the record
    that it starts in began."""
    def states(batches):
        rows = {}
        for key, line, _ in _by_block(batches):
            outside, inside, closes = rows.get(key, (False, True, False))
            inside = ends_inside(line, inside)
            rows[key] = ends_inside(line, outside), inside, closes or not inside
        columns = list(zip(*[(*k, *v) for k, v in rows.items()])) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "from_outside", "from_inside", "closes"])

    known, last = {}, None
    for file, block, from_outside, from_inside, closes in sorted(tuple(r) for r in lines.mapInArrow(states, BLOCK_SCHEMA).collect()):
        if file != last:
            inside, owner, last = False, None, file
        known[file, block] = inside, owner
        if inside:
            owner = owner if not closes else block if from_inside else None
            inside = from_inside
        else:
            inside, owner = from_outside, block if from_outside else None
    return known


def records(lines: DataFrame) -> DataFrame:
    """(header, text): the records of all files, whole; ``header`` marks the first of each file."""
    known = block_states(lines)
    shared = lines.sparkSession.sparkContext.broadcast(known)

    def cut(batches):
        rows: list[tuple] = []
        held: list[str] = []
        key, inside, owner, first = None, False, None, False

        def rest():
            if held:  # the record goes on in the next block
                rows.append((*key, owner if owner is not None else key[1], first, "\n".join(held)))
                held.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "owner", "header", "text"])
            rows.clear()
            return out

        for at, line, starts in _by_block(batches):
            if starts:
                rest()
                key, first = at, at[1] == 0
                inside, owner = shared.value[at]
            held.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                rows.append((*key, owner, first, "\n".join(held)))
                held.clear()
                owner, first = None, False
                if len(rows) >= 4096:
                    yield batch()
        rest()
        yield batch()

    found = lines.mapInArrow(cut, RECORD_SCHEMA)
    whole = found.where("owner IS NULL").select("header", "text")
    if not any(inside for inside, _ in known.values()):
        # no record runs across blocks; one that the file's end leaves open stays as it is
        return found.select("header", "text")
    pieces = found.where("owner IS NOT NULL").groupBy("file", "owner").agg(
        F.max("header").alias("header"), F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts")
    )
    return whole.unionByName(pieces.select("header", F.concat_ws("\n", F.transform("parts", lambda p: p.text)).alias("text")))


def has_open_lines(lines: DataFrame) -> bool:
    """Whether any line leaves a quote open, looking at each as if it started outside, or holds
    a carriage return that is not its end."""
    open_ = F.col("value").contains('"') & F.col("value").rlike(f"(?s)^{OPENS}$")
    broken = F.col("value").contains("\r") & F.col("value").rlike("(?s)\r.")
    return lines.agg(F.count_if(open_ | broken)).first()[0] > 0


def parsed(found: DataFrame, names: list[str]) -> DataFrame:
    """One text column per name, from records; ``record`` keeps the text of each. Of equal
    names the first counts."""
    # where records end with a carriage return, line breaks within cells lose theirs, as in Spark's reader
    returns = F.col("text").endswith("\r")
    text = F.when(returns, F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    rows = found.where(~F.col("header")).select(text.alias("record")).where(F.trim("record") != "")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    cells = F.from_csv("record", F.lit(schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), {"quote": '"', "escape": '"', "multiLine": "true"})
    first: dict[str, int] = {}
    for i, n in enumerate(names):
        if n != "record":
            first.setdefault(n, i)
    return rows.select(cells.alias("cells"), "record").select(*[F.col(f"cells.c{i}").alias(n) for n, i in first.items()], "record")
