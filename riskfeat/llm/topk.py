"""The exact k best inner products of each query vector, by histogram selection.

All vectors are scored against all queries in blocks of rows. No score leaves its task:
of a pair of blocks a task returns, for each query, how many scores lie in each part of
that query's range, from the top down until k are counted. The counts of all tasks give
the part that holds the k-th best score; it becomes the range of the next round, in parts
as much finer, until a part is a single score. In a block of scores the k-th largest of the
maxima of a few runs bounds the k-th best score from below, so only the scores from there on
are placed in parts. Then the scores above it and, of those equal to
it, the k smallest ids leave each task, and the k first by score and id stay.

Vectors become whole numbers, floor(scale * x) in double precision, and scores are whole.

Every row counts: rows that share an id are candidates each, queries each with k rows of
their own, and candidates of one another; only a query's own row is left out. Ties go to the
smaller id, and among rows of one id to any.

Defined results: a vector that is null or holds a null, NaN or infinity takes no part, nor
does a row without an id; vectors of different lengths are not compared; an empty vector
scores 0 with empty ones; with fewer than k others a query gets them all; other columns are not
read, whatever their names; an empty table gives an empty table. Scores have to stay below
2**62 (an error says so otherwise).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskfeat.session import materialize

PARTS = 512
ROWS = 4096
EXACT, EXACT_SINGLE = 2.0**53, 2.0**24
#: Vectors of components up to this are packed in 16 bits.
SMALL = 2**15 - 1
#: Runs of a block whose maxima are compared, for each of the k.
RUNS = 16


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", whole)


def blocks(rows: DataFrame, per: int) -> DataFrame:
    """Rows (row, id, v) as packed blocks of about ``per`` rows, one length in each, by id."""
    n = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-rows.count() // per)))).cast("int")
    grouped = rows.groupBy(F.size("v").alias("dim"), n.alias("block"))
    @F.arrow_udf("struct<rows:binary,ids:binary,data:binary,most:double>")
    def packed(dim: pa.Array, members: pa.Array) -> pa.Array:
        out = []
        for d, m in zip(dim.to_pylist(), members):
            values = m.values
            rows, ids = values.field("row").to_numpy(), values.field("id").to_numpy()
            order = np.lexsort((rows, ids))
            data = values.field("v").flatten().to_numpy().reshape(len(values), d)[order]
            most = float(np.sqrt((data**2).sum(1)).max())
            if np.abs(data).max(initial=0) <= SMALL:
                data = data.astype(np.int16)
            out.append({"rows": rows[order].tobytes(), "ids": ids[order].tobytes(), "data": data.tobytes(), "most": most})
        return pa.array(out, pa.struct([("rows", pa.binary()), ("ids", pa.binary()), ("data", pa.binary()), ("most", pa.float64())]))

    return grouped.agg(F.collect_list(F.struct("row", "id", "v")).alias("m")).select("dim", "block", packed("dim", "m").alias("p")).select("dim", "block", "p.*")


def unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * n * dim else np.float64).reshape(n, dim)


def number(bound: float, dim: int) -> type:
    """The type in which scores up to ``bound`` are exact: floats while all sums stay whole
    in them; beyond, whole numbers of 64 bits."""
    if bound >= 2.0**62:
        raise OverflowError("scores of 2**62 and more are not supported")
    most = bound * max(dim, 1)
    return np.float32 if most < EXACT_SINGLE else np.float64 if most < EXACT else np.int64


def candidates(got: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column), by row, of the scores that are at least the row's ``low``; those
    below the row's k-th best may be left out."""
    width = max(1, got.shape[1] // (RUNS * k))
    runs = got.shape[1] // width
    if runs >= k:
        tops = got[:, : runs * width].reshape(len(got), width, runs).max(axis=1)
        low = np.maximum(low, np.partition(tops, runs - k, axis=1)[:, runs - k])
    return np.nonzero(got >= low[:, None])


def _running(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of ``n`` up to and with each place, anew for each value of the sorted ``of``."""
    total = np.cumsum(n)
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    before = np.repeat(total[begins] - n[begins], np.diff(begins, append=len(of)))
    return total - before


def _lists(kind: pa.DataType, found: list[list[np.ndarray]]) -> pa.Array:
    """A list of structs for each entry: its columns."""
    fields = list(kind.value_type)
    columns = [np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in range(len(fields))]
    offsets = np.cumsum([0] + [len(x[0]) if x else 0 for x in found])
    values = pa.StructArray.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _own(rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in rows, in others) of the rows that stand in both."""
    _, mine, at = np.intersect1d(rows, others, assume_unique=True, return_indices=True)
    return mine, at


def _scored(asked: dict, data: dict, dim: int, lowest: int, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of some queries, their lower ends, their scores) a few queries at a time; a
    query's score with its own row is below every range."""
    rows, others = np.frombuffer(asked["rows"], np.int64), np.frombuffer(data["rows"], np.int64)
    low = np.full(len(rows), lowest)
    mine, at = _own(rows, np.array(asked["queries"] or [], np.int64))
    low[mine] = np.array(asked["lows"] or [], np.int64)[at]
    kind = number(asked["most"] * data["most"], dim)
    if dim:
        x, y = (unpacked(part["data"], n, dim).astype(kind) for part, n in ((asked, len(rows)), (data, len(others))))
    for i in range(0, len(rows), step):
        some = np.arange(i, min(i + step, len(rows)))
        got = x[some] @ y.T if dim else np.zeros((len(some), len(others)), np.int64)
        mine, at = _own(rows[some], others)
        got[mine, at] = lowest - 1
        yield some, low[some], got


def histogram_column(k: int, parts: int, width: int, lowest: int):
    """Counts of scores by part: 0 is below the query's range, parts + 1 above it."""
    kind = pa.list_(pa.struct([("query", pa.int64()), ("low", pa.int64()), ("part", pa.int32()), ("n", pa.int64())]))

    @F.arrow_udf("array<struct<query:long,low:long,part:int,n:long>>")
    def count(asked: pa.Array, data: pa.Array, dim: pa.Array) -> pa.Array:
        out = []
        for a, d, size in zip(asked.to_pylist(), data.to_pylist(), dim.to_pylist()):
            found, queries = [], np.frombuffer(a["rows"], np.int64)
            for some, low, got in _scored(a, d, size, lowest):
                q, v = candidates(got, low.astype(got.dtype), k)
                part = np.minimum((got[q, v].astype(np.int64) - low[q]) // width + 1, parts + 1)
                # by query, from its highest part down
                place, n = np.unique(q * (parts + 2) + (parts + 1 - part), return_counts=True)
                q, part = place // (parts + 2), parts + 1 - place % (parts + 2)
                few = _running(n, q) - n < k
                found.append([queries[some[q]][few], low[q][few], part[few], n[few]])
            out.append([np.concatenate(c) for c in zip(*found)])
        return _lists(kind, out)

    return count


def chosen_column(k: int, lowest: int):
    """The scores above a query's k-th best, and the k least ids of those equal to it."""
    names = ("query", "query_id", "vec_id", "score")
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))

    @F.arrow_udf("array<struct<query:long,query_id:long,vec_id:long,score:long>>")
    def choose(asked: pa.Array, data: pa.Array, dim: pa.Array) -> pa.Array:
        out = []
        for a, d, size in zip(asked.to_pylist(), data.to_pylist(), dim.to_pylist()):
            found, others = [], np.frombuffer(d["ids"], np.int64)
            queries, ids = np.frombuffer(a["rows"], np.int64), np.frombuffer(a["ids"], np.int64)
            for some, low, got in _scored(a, d, size, lowest):
                q, v = np.nonzero(got >= low.astype(got.dtype)[:, None])
                score = got[q, v].astype(np.int64)
                equal = score == low[q]
                some_ = ~equal | (_running(equal.astype(np.int64), q) <= k)  # others are sorted by id
                q, v = q[some_], v[some_]
                found.append([queries[some[q]], ids[some[q]], others[v], score[some_]])
            out.append([np.concatenate(c) for c in zip(*found)])
        return _lists(kind, out)

    return choose


def top_k(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, parts: int = PARTS, rows: int = ROWS) -> DataFrame:
    """query_id, rank from 1, vec_id, score of the k best of all other vectors for each
    query; ``is_query(id)`` says which rows are queries."""
    vectors = materialize(whole_vectors(df, key, vector, scale))
    data = materialize(blocks(vectors, rows))
    asked = materialize(blocks(vectors.filter(is_query(F.col("id"))), rows))
    most = asked.groupBy("dim").agg(F.max("most").alias("a")).join(data.groupBy("dim").agg(F.max("most").alias("b")), "dim")
    bound = int(most.agg(F.max(F.col("a") * F.col("b"))).first()[0] or 0) + 1
    if bound >= 2**62:
        raise OverflowError("scores of 2**62 and more are not supported")
    width, lowest = 1, -bound
    while width * parts < 2 * bound + 1:
        width *= parts

    # every block of queries meets every block of vectors of the same length once
    query_blocks = asked.select("dim", F.col("block").alias("q"), F.struct("rows", "ids", "data", "most").alias("asked_"))
    data_blocks = data.select("dim", F.col("block").alias("d"), F.struct("rows", "ids", "data", "most").alias("data_"))
    names = data_blocks.groupBy("dim").agg(F.collect_list("d").alias("ds")), query_blocks.groupBy("dim").agg(F.collect_list("q").alias("qs"))
    right = data_blocks.join(names[1], "dim").select("dim", "d", "data_", F.explode("qs").alias("q"))

    def meet(lows: DataFrame | None) -> DataFrame:
        if lows is None:
            left = query_blocks.withColumn("queries", F.lit(None).cast("array<long>")).withColumn("lows", F.lit(None).cast("array<long>"))
        else:
            left = query_blocks.join(lows, ["dim", "q"], "left")
        left = left.select("dim", "q", F.struct("asked_.rows", "asked_.ids", "asked_.data", "asked_.most", "queries", "lows").alias("asked_"))
        return left.join(names[0], "dim").withColumn("d", F.explode("ds")).drop("ds").join(right, ["dim", "q", "d"])

    lows = None
    downward = Window.partitionBy("dim", "q", "query").orderBy(F.desc("part"))
    while width:
        count = histogram_column(k, parts, width, lowest)
        counts = meet(lows).select("dim", "q", F.inline(count("asked_", "data_", "dim")))
        counts = counts.groupBy("dim", "q", "query", "low", "part").agg(F.sum("n").alias("n")).withColumn("n", F.sum("n").over(downward))
        kth = counts.groupBy("dim", "q", "query", "low").agg(F.max(F.when(F.col("n") >= k, F.col("part"))).alias("part"))
        low = F.when(F.col("part").isNull(), F.lit(lowest)).otherwise(F.col("low") + (F.col("part").cast("long") - 1) * F.lit(width))
        kth = kth.select("dim", "q", F.struct("query", low.alias("low")).alias("x"))
        # the queries of one block: no more than the block has rows
        lows = kth.groupBy("dim", "q").agg(F.sort_array(F.collect_list("x")).alias("x"))
        lows = materialize(lows.select("dim", "q", F.col("x.query").alias("queries"), F.col("x.low").alias("lows")))
        width //= parts
    best = meet(lows).select(F.inline(chosen_column(k, lowest)("asked_", "data_", "dim")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
