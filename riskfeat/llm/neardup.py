"""Near-duplicate vectors by cosine: every link, counted block by block.

1. Equal vectors of a label are one class with a count.
2. The classes of a label and length that are more than TARGET are divided around some of
   their own vectors, each class going to the nearest, over at most LEVELS levels. What is
   still larger, such as a crowd of near copies, is dealt by hash. A block has about TARGET
   classes at most.
3. A block has a centre and a radius, the largest angle to it. Two blocks of a label are
   left uncompared only if the angles say that no vector of one can be in range of the other.
4. All other pairs of blocks, each block with itself included, are compared whole in double
   precision, a pair in one task. Links are added up per class and only a spanning forest
   of the pair's links leaves its task, so a crowd of near copies makes no quadratic output.

Nothing is searched approximately: links and components are exact. The price is work that
grows with the square of a label's classes where its blocks lie too close to be told apart;
memory of a task does not grow, being a pair of blocks.

Defined results: a vector that is null, empty, zero or holds a null, NaN or infinity, and
one without a label or id, links with nothing; without an id the component is null and
kept is false; repeated rows link like other equal vectors; vectors of different lengths
do not link; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.llm.components import components
from riskfeat.llm.topk import usable
from riskfeat.session import materialize

TARGET = 1500
MOST_PIVOTS, LEVELS = 64, 3
#: Radians that rounding may take from an angle.
SLACK = 1e-6


# ---- inside a task ----------------------------------------------------------------------------


def unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 5e-324)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def roots(found: np.ndarray) -> np.ndarray:
    """The least place that each place reaches."""
    q, v = np.nonzero(found)
    label = np.arange(len(found))
    while True:
        after = label.copy()
        np.minimum.at(after, q, label[v])
        after = after[after]
        if (after == label).all():
            return label
        label = after


def nearest_column():
    """A column function: (vector, pivots) -> the place of the nearest pivot, 0 without any."""

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array, pivots: pa.Array) -> pa.Array:
        out = []
        for v, p in zip(vectors, pivots):
            if not p.is_valid:
                out.append(0)
                continue
            centres = unit(p.values.flatten().to_numpy(), len(p.values))
            out.append(int((centres @ unit(v.values.to_numpy(), 1)[0]).argmax()))
        return pa.array(out, pa.int32())

    return nearest


def packed_column():
    """A column function: a block's members -> their bytes, and the centre and radius."""
    kind = pa.struct([("ids", pa.binary()), ("ns", pa.binary()), ("data", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())])

    @F.arrow_udf("struct<ids:binary,ns:binary,data:binary,centre:array<double>,radius:double>")
    def packed(blocks: pa.Array) -> pa.Array:
        out = []
        for block in blocks:
            members = block.values
            ids, ns = members.field("id").to_numpy(), members.field("n").to_numpy()
            order = np.argsort(ids)
            x = unit(members.field("v").flatten().to_numpy(), len(ids))[order]
            centre = x.sum(axis=0)
            # where the sum is next to nothing its direction is rounding, and any will do
            centre = unit(centre if np.abs(centre).max() > 1e-9 else x[0], 1)[0]
            radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
            out.append({"ids": ids[order].tobytes(), "ns": ns[order].tobytes(), "data": x.tobytes(), "centre": centre.tolist(), "radius": radius})
        return pa.array(out, kind)

    return packed


def linked_column(least: float):
    """A column function: two blocks -> the members that have links in this pair, how many,
    and the member that stands for them here. A block met with itself has no second one."""
    kind = pa.list_(pa.struct([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))

    def read(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(block["ids"], np.int64)
        return ids, np.frombuffer(block["ns"], np.int64), np.frombuffer(block["data"]).reshape(len(ids), -1)

    @F.arrow_udf("array<struct<id:long,links:long,root:long>>")
    def linked(first: pa.Array, second: pa.Array) -> pa.Array:
        out = []
        for one, two in zip(first, second):
            ids, ns, x = read(one.as_py())
            if two.is_valid:
                more, more_ns, y = read(two.as_py())
                part = x @ y.T >= least
                n = len(ids)
                ids, ns = np.concatenate([ids, more]), np.concatenate([ns, more_ns])
                found = np.zeros((len(ids), len(ids)), bool)
                found[:n, n:] = part
                found[n:, :n] = part.T
            else:
                found = x @ x.T >= least
                found |= found.T
                np.fill_diagonal(found, False)
            q, v = np.nonzero(found)
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, q, ns[v])
            some = np.flatnonzero(links)
            root = ids[roots(found)]
            out.append([dict(zip(("id", "links", "root"), r)) for r in zip(ids[some].tolist(), links[some].tolist(), root[some].tolist())])
        return pa.array(out, kind)

    return linked


# ---- over all blocks ---------------------------------------------------------------------------


def blocks(classes: DataFrame, target: int = TARGET) -> DataFrame:
    """The classes (id, n, label, v) as packed blocks of about ``target`` at most: label, dim,
    block, ids, ns, data, centre, radius."""
    placed = classes.withColumn("dim", F.size("v")).withColumn("cell", F.xxhash64("label", "dim"))
    nearest = nearest_column()
    for level in range(LEVELS):
        crowded = placed.groupBy("cell").agg(F.count("*").alias("m_")).filter(F.col("m_") > target)
        if crowded.isEmpty():
            break
        wanted = F.least(F.lit(MOST_PIVOTS), F.greatest(F.lit(2), F.ceil(F.col("m_") / target))).cast("long")
        crowded = crowded.withColumn("wanted_", wanted)
        picked = placed.join(crowded, "cell").filter(F.pmod(F.xxhash64("id", F.lit(level)), F.col("m_")) < F.col("wanted_"))
        pivots = picked.groupBy("cell").agg(F.collect_list("v").alias("pivots"))  # about ``wanted_``
        moved = placed.join(pivots.filter(F.size("pivots") > 1), "cell", "left")
        part = F.when(F.col("pivots").isNotNull(), F.xxhash64("cell", F.lit(level), nearest("v", "pivots"))).otherwise(F.col("cell"))
        placed = materialize(moved.select("id", "n", "label", "v", "dim", part.alias("cell")))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / target).alias("parts_"))
    dealt = placed.join(sizes, "cell").withColumn("block", F.xxhash64("cell", F.pmod(F.xxhash64("id", F.lit(LEVELS)), F.col("parts_"))))
    members = F.collect_list(F.struct("id", "n", "v")).alias("m")
    return dealt.groupBy("label", "dim", "block").agg(members).select("label", "dim", "block", packed_column()("m").alias("p")).select("label", "dim", "block", "p.*")


def in_reach(least: float) -> Column:
    """Whether a vector of the block (centre_a, radius_a) can be in range of one of b."""
    cosine = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    range_ = float(np.arccos(np.clip(least, -1, 1))) + SLACK
    return between <= F.col("radius_a") + F.col("radius_b") + F.lit(range_)


def linked_classes(classes: DataFrame, least: float, target: int = TARGET) -> tuple[DataFrame, DataFrame]:
    """(id, links) of the classes (id, n, label, v) that have any, and the edges (a, b) that
    tie them."""
    packed = materialize(blocks(classes, target))
    sides = [packed.select("label", "dim", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "centre", "radius"))) for s in "ab"]
    pairs = sides[0].join(sides[1], ["label", "dim"]).filter((F.col("block_a") <= F.col("block_b")) & in_reach(least))
    pairs = pairs.select("label", "dim", "block_a", "block_b")
    held = [packed.select("label", "dim", F.col("block").alias(f"block_{s}"), F.struct("ids", "ns", "data").alias(s)) for s in "ab"]
    pairs = materialize(pairs).join(held[0], ["label", "dim", "block_a"]).join(held[1], ["label", "dim", "block_b"])
    second = F.when(F.col("block_a") < F.col("block_b"), F.col("b"))
    found = materialize(pairs.select(F.inline(linked_column(least)("a", second))))
    return found.groupBy("id").agg(F.sum("links").alias("links")), found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def near_duplicates(
    df: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", target: int = TARGET,
) -> DataFrame:
    """Per row: the key, n_links, component_id and kept."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fit = usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    digest = F.struct(F.xxhash64("label", "v"), F.xxhash64(F.reverse("v"), F.lit(1), "label"))
    rows = rows.select("id", "label", "v", F.when(F.coalesce(fit, F.lit(False)), digest).alias("class"))
    classes = rows.filter("class is not null").groupBy("class").agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("v").alias("v")
    )
    classes = materialize(classes)
    links, edges = linked_classes(classes, least, target)
    tied = components(edges)
    result = classes.select("class", "n", F.col("id").alias("rep")).join(links.withColumnRenamed("id", "rep"), "rep", "left")
    result = result.join(tied, F.col("rep") == F.col("node"), "left").select(
        "class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    alone = rows.filter("class is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    full = rows.filter("class is not null").select("id", "class").join(result, "class").select("id", "links", "component").union(alone)
    return full.select(
        F.col("id").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )
