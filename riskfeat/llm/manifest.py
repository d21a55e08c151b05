"""A Merkle manifest of a dataset: a tree of digests per group, one over the groups, and for
every row the proof that it is under the root.

Where a row stands among the rows of its group is found without sorting them:

1. Each group's ids are a bitmap of 64-bit words; only words with an id exist. Words are made
   where the rows are and merged by bit_or, so rows are aggregated before they are shuffled.
2. A directory holds what stands before each word: running sums within nodes of 2**10 words,
   2**24 nodes and so on, so no window grows with a group.
3. The rank of an id is its word's count before, plus the bits below its own in the word.
   Ids with several rows are rare and get the difference from a list in their word.

Places then key everything: ``place div 16`` names the run and ``place mod 16`` the slot of
its array, level by level up. On the way down every run gets the digests beside its path, and
the last step writes the proofs of its 16 rows. Joins are on (group, run), so a hot group is
spread like any other; only numbers of levels reach the driver.

Defined results: a null in a column is ``-``; a null group comes first; a row without an id
comes first in its group and is never tampered with; rows that share an id stand in the
order of their leaves, equal rows all stay and differ in their proofs at most; columns that
are not named are not read and may clash with no name here; very long texts are hashed whole;
an empty table gives an empty manifest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfeat.llm.frames import remainder
from riskfeat.operators.encode import ranked_values
from riskfeat.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A power of two.
FAN = 16
#: Letters of a digest.
DIGEST = 64
PATH = "array<struct<before:string,after:string>>"
WORD_BITS = 6
#: Bits of a word's number that each level of the directory takes; the sign is left for the last.
NODE_BITS = (10, 24, 24)
#: Rows that one row of a count may become at a time.
BLOCK = 4096


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field_text(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, fields=FIELDS, key: str = "doc_id", group: str = "source", text: str = "text", every: int = 5) -> DataFrame:
    """(g, word, bit, id, leaf, changed, n): distinct rows and how many there are of each.

    ``g`` names the group in its order, ``changed`` is the leaf of a row that was tampered with.
    """
    parts = [field_text(F.col(c)) for c in fields]
    tampered = [field_text(lowered(F.col(c))) if c == text else field_text(F.col(c)) for c in fields]
    chosen = F.col(key).isNotNull() & (remainder(F.col(key), every) == 0)
    named = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.col(key).cast("long").alias("id"), digest(*parts).alias("leaf"), F.when(chosen, digest(*tampered)).alias("changed"),
    )
    first = F.lit(-(1 << 63 - WORD_BITS) - 1)  # a word before that of the least id
    word = F.coalesce(F.shiftright("id", WORD_BITS), first).alias("word")
    bit = F.coalesce(F.col("id").bitwiseAND(F.lit((1 << WORD_BITS) - 1)), F.lit(0)).cast("int").alias("bit")
    return named.groupBy("g", word, bit, "id", "leaf", "changed").agg(F.count("*").alias("n"))


def bitmap(rows: DataFrame) -> DataFrame:
    """(g, word, bits, more, n): the ids of each group as words, the ids that have more than
    one row with how many more, and the rows of the word."""
    ids = rows.groupBy("g", "word", "bit").agg(F.sum("n").alias("n"))
    # at most one entry for each bit
    more = F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("n"))))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    return ids.groupBy("g", "word").agg(F.bit_or(one).alias("bits"), more.alias("more"), F.sum("n").alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """The words with ``before``, the rows of the group that stand before each, and ``m``, all
    rows of the group."""
    level, levels = words.select("g", F.col("word").alias("node"), "n"), []
    for bits in (*NODE_BITS, None):
        level = level.withColumn("parent", F.shiftright("node", bits) if bits else F.lit(0).cast("long"))
        earlier = Window.partitionBy("g", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        levels.append(level.select("g", "node", "parent", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("here")))
        level = level.groupBy("g", F.col("parent").alias("node")).agg(F.sum("n").alias("n"))
    before = level.select("g", F.col("node").alias("parent"), F.lit(0).cast("long").alias("before"), F.col("n").alias("m"))
    for one in reversed(levels):
        before = one.join(before, ["g", "parent"]).select("g", F.col("node").alias("parent"), (F.col("here") + F.col("before")).alias("before"), "m")
    return words.drop("n").join(before.withColumnRenamed("parent", "word"), ["g", "word"])


def rank(words_before: Column, bits: Column, more: Column, bit: Column) -> Column:
    """Rows of the group that have a smaller id."""
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
    extra = F.aggregate(F.filter(more, lambda x: x.bit < bit), F.lit(0).cast("long"), lambda s, x: s + x.n)
    return words_before + F.bit_count(bits.bitwiseAND(below)) + extra


def placed(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(g, m, place, id, leaf, changed): every row with its place in its group, from 0."""
    held = rows.join(words, ["g", "word"])
    shared = F.exists("more", lambda x: x.bit == F.col("bit"))
    here = rank(F.col("before"), F.col("bits"), F.col("more"), F.col("bit")).alias("place")
    kept = ["g", "m", here, "id", "leaf", "changed", "n"]
    alone = held.filter(~shared).select(*kept).drop("n")
    # rows of one id: their leaves are spread evenly, so shares by their first letters are even
    crowd = held.filter(shared).select(*kept, F.substring("leaf", 1, 4).alias("share"))
    shares = crowd.groupBy("g", "place", "share").agg(F.sum("n").alias("of_share"))
    by_share = Window.partitionBy("g", "place").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("g", "place", "share", F.coalesce(F.sum("of_share").over(by_share), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("g", "place", "share").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    crowd = crowd.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(shares, ["g", "place", "share"])
    crowd = crowd.withColumn("place", F.col("place") + F.col("earlier") + F.col("within")).drop("earlier", "within", "share")
    blocks = crowd.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))))
    blocks = blocks.repartition("g", "place", "block")
    last = F.least(F.col("block") + BLOCK, F.col("n")) - 1
    each = blocks.withColumn("nth", F.explode(F.sequence("block", last)))
    return alone.unionByName(each.select("g", "m", (F.col("place") + F.col("nth")).alias("place"), "id", "leaf", "changed"))


def runs(nodes: DataFrame, *kept: str) -> DataFrame:
    """(g, m, run, slots, up): nodes (g, m, place, node) as arrays keyed by slot, each slot
    with ``node`` and the ``kept`` columns, and the digest of the run; a group's only node
    is its own digest."""
    slot = F.pmod("place", F.lit(FAN)).cast("int")
    cells = F.map_from_entries(F.collect_list(F.struct(slot, F.struct("node", *kept))))
    grouped = nodes.groupBy("g", "m", F.shiftright("place", FAN.bit_length() - 1).alias("run")).agg(cells.alias("cells"))
    keyed = F.transform(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: F.col("cells")[i])
    made = grouped.select("g", "m", "run", keyed.alias("slots"))
    up = F.when(F.col("m") == 1, F.col("slots")[0].node).otherwise(digest(joined(F.col("slots"))))
    return made.withColumn("up", up)


def joined(slots: Column) -> Column:
    return F.concat_ws("", F.transform(slots, lambda x: x.node))


def climb(nodes: DataFrame, most: int, *kept: str) -> tuple[list[DataFrame], DataFrame]:
    """The saved levels of runs over ``nodes`` (g, m, place, node), the lowest first, and (g,
    m, top) with the node that remains. ``most`` is the number of nodes of the largest group."""
    levels, tops, width = [], [], FAN
    while True:
        level = materialize(runs(nodes, *(() if levels else kept)))
        levels.append(level)
        tops.append(level.filter(F.col("m") <= width).select("g", "m", F.col("up").alias("top")))
        if most <= width:
            return levels, reduce(DataFrame.unionByName, tops)
        nodes = level.filter(F.col("m") > width).select("g", "m", F.col("run").alias("place"), F.col("up").alias("node"))
        width *= FAN


def descend(levels: list[DataFrame], above: DataFrame, *kept: str) -> DataFrame:
    """For each node of the lowest level: g, node, the ``kept`` columns, top, and path, the
    digests before and after it, level by level up, ending with those of ``above`` (g, m, top, path)."""
    carried = None
    for i in reversed(range(len(levels))):
        width = FAN ** (i + 1)
        # groups whose one run at this level is their last
        starts = above.filter((F.col("m") <= width) & (F.col("m") > (width // FAN if i else 0)))
        starts = starts.select("g", F.lit(0).cast("long").alias("run"), "top", "path")
        paths = starts if carried is None else carried.unionByName(starts)
        held = levels[i].join(paths, ["g", "run"]).withColumn("all", joined(F.col("slots")))
        each = held.select("g", "m", "run", "top", "path", "all", F.posexplode("slots").alias("slot", "cell"))
        before = F.substr("all", F.lit(1), F.col("slot") * DIGEST).alias("before")
        here = F.struct(before, F.substr("all", (F.col("slot") + 1) * DIGEST + 1).alias("after"))
        path = F.when(F.col("m") == 1, F.col("path")).otherwise(F.concat(F.array(here), F.col("path"))).alias("path")
        if i:
            carried = each.select("g", (F.col("run") * FAN + F.col("slot")).alias("run"), "top", path)
    return each.select("g", "cell.node", *[f"cell.{c}" for c in kept], "top", path)


def fold(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda node, x: digest(x.before, node, x.after))


def manifest(docs: DataFrame, fields=FIELDS, key: str = "doc_id", group: str = "source", text: str = "text", every: int = 5) -> DataFrame:
    """Per row: the key, leaf, subroot, root, proof_sha256, folded_root and verified. Rows whose
    key's crc32 is a multiple of ``every`` are tampered with: their text is in lower case."""
    rows = materialize(leaves(docs, fields, key, group, text, every))  # the texts are read once
    words = materialize(directory(bitmap(rows)))
    most = words.agg(F.max("m")).first()[0] or 1
    levels, subroots = climb(placed(rows, words).withColumnRenamed("leaf", "node"), most, "id", "changed")
    subroots = materialize(subroots)
    ranked, sizes = ranked_values(subroots, ["g"])
    names = subroots.join(ranked.select(F.col("value").alias("g"), F.col("code").alias("place")), "g")
    groups = names.select(F.lit("").alias("g"), F.lit(sizes["g"]).cast("long").alias("m"), "place", F.col("top").alias("node"), F.col("g").alias("name"), F.col("m").alias("rows"))
    group_levels, tops = climb(groups, sizes["g"], "name", "rows")
    root = tops.first()
    above = tops.withColumn("path", F.array().cast(PATH))
    paths = materialize(descend(group_levels, above, "name", "rows").select(F.col("name").alias("g"), F.col("rows").alias("m"), F.col("node").alias("top"), "path"))
    found = descend(levels, paths, "id", "changed")
    sides = F.concat_ws("", F.transform("path", lambda x: F.concat(x.before, x.after)))
    root = F.lit(root["top"] if root else None).cast("string")
    folded = found.select(
        F.col("id").alias(key), F.col("node").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"),
        digest(sides).alias("proof_sha256"), fold(F.coalesce("changed", "node"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
