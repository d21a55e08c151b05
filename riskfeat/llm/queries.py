"""One query per operator over the given tables, with its SQL where SQL can say it.

Each query keeps the operator's own parameters of production and derives digest columns
from the operator's outputs. Extra columns of the tables are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfeat.llm import audit, bpe, jaccard, licenses, manifest, neardup, packing, quality, secrets, sharding, topk, toxicity, warc
from riskfeat.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LEAST_SCORE = 0.3


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, folder: f(tune(spark), folder)
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def components_sql(links: str) -> str:
    """(node, component_id) of all nodes(node) under links(a, b) given both ways."""
    return f"""
  reach AS (
    SELECT node, node AS other FROM nodes
    UNION
    SELECT r.node, l.b FROM reach r JOIN {links} l ON l.a = r.other
  ),
  component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)"""


@query("op1_warc", """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(8), lambda j: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(sha1(coalesce(html, '')), CAST(5 * j + 1 AS INT), 5) AS INT) >> s) & 31) + 1 AS INT), 1)),
    'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)""")
def op1_warc(spark, folder):
    read = warc.round_trip(table(spark, folder, "pages"), least=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_bpe")
def op2_bpe(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, decode = bpe.encoder(spark, path), bpe.decoder(spark, path)
    ids = table(spark, folder, "documents").select("doc_id", encode("text").alias("ids"))
    both = ids.select("doc_id", "ids", decode("ids").alias("text"))
    return both.select(
        "doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query("op3_ngram_jaccard", rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b USING (t) WHERE a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), nodes AS (SELECT doc_id AS node FROM documents),{components_sql('links')}
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN component ON node = doc_id""")
def op3_ngram_jaccard(spark, folder):
    return jaccard.similar_documents(table(spark, folder, "documents"), words=4, percent=85)


def _scored(spark, folder, operator) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = operator.fit(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", operator.held_out(F.col("doc_id")).alias("held_out"), operator.score(docs, model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= LEAST_SCORE, 1).otherwise(0))


@query("op4_quality")
def op4_quality(spark, folder):
    return _scored(spark, folder, quality)


@query("op5_packing")
def op5_packing(spark, folder):
    docs = table(spark, folder, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def _spans_sql(rank: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    found = f"regexp_extract_all(t, '{pattern}', {{}})"
    return f"""
  s{rank} AS (SELECT doc_id, t, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gap,
    list_transform({found.format(0)}, lambda x: length(x)) AS whole, list_transform({found.format(rule.group)}, lambda x: length(x)) AS part FROM texts),
  f{rank} AS (SELECT doc_id, list_filter(list_transform(range(1, len(whole) + 1), lambda i: {{
      'a': CAST(coalesce(list_sum(gap[1 : i]), 0) + coalesce(list_sum(whole[1 : i - 1]), 0) AS BIGINT), 'r': {rank},
      'b': CAST(coalesce(list_sum(gap[1 : i]), 0) + coalesce(list_sum(whole[1 : i]), 0) AS BIGINT), 'n': part[i], 'k': '{rule.kind}'}}),
    lambda x: x.n >= {rule.least}) AS f FROM s{rank})"""


@query("op6_secrets", f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{','.join(_spans_sql(n, r) for n, r in enumerate(secrets.RULES))},
listed AS (
  SELECT doc_id, len(f0.f) AS n_assign, len(f1.f) AS n_access, len(f2.f) AS n_hex,
    coalesce(array_to_string(list_transform(list_sort(list_concat(f0.f, f1.f, f2.f)), lambda x: x.k || ':' || x.a || ':' || x.b), ','), '') AS spans
  FROM f0 JOIN f1 USING (doc_id) JOIN f2 USING (doc_id))
SELECT doc_id, n_assign, n_access, n_hex, sha256(spans) AS base_sha256, spans FROM listed""")
def op6_secrets(spark, folder):
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    counts = [secrets.count_of(spans, n).alias(f"n_{r.kind}") for n, r in enumerate(secrets.RULES)]
    listed = found.select("doc_id", *counts, secrets.listed(spans).alias("spans"))
    return listed.select("*", F.sha2(F.encode("spans", "UTF-8"), 256).alias("base_sha256"))


@query("op7_toxicity")
def op7_toxicity(spark, folder):
    return _scored(spark, folder, toxicity)


@query("op8_sharding", f"""
WITH places AS (SELECT string_split('{','.join(map(str, sharding.lookup_table()))}', ',') AS cells),
slots AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {sharding.HEX_DIGITS}) AS BIGINT)
  % {sharding.SIZE} AS INT) AS slot, source, coalesce(strlen(text), 0) AS text_bytes FROM documents)
SELECT doc_id, slot, CAST(cells[slot + 1] AS INT) AS shard, source, text_bytes FROM slots, places""")
def op8_sharding(spark, folder):
    placed = sharding.place(table(spark, folder, "documents"), "doc_id")
    return placed.select("doc_id", "slot", "shard", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("text_bytes"))


VECTORS_SQL = """
  v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


@query("op9_topk", f"""
WITH {VECTORS_SQL},
w AS (SELECT row_number() OVER () AS n, vec_id, list_transform(e, lambda x: floor(256 * x)) AS e FROM v),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id % 50 = 0 AND q.n <> c.n),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""")
def op9_topk(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), lambda i: i % 50 == 0, k=5)


@query("op10_neardup", f"""
WITH RECURSIVE {VECTORS_SQL},
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
nodes AS (SELECT vec_id AS node FROM embeddings),{components_sql('links')},
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT node AS vec_id, coalesce(n_links, 0) AS n_links, component_id, node = component_id AS kept
FROM component LEFT JOIN n ON a = node""")
def op10_neardup(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "embeddings"), least=0.93)


def _merkle_sql(levels: int, group_levels: int) -> str:
    """Trees of 16 over rows by source, then over the sources, up to so many levels: nK are
    the nodes, sK what stands before and after each in its run; a one-node group goes up as it is."""
    parts = []

    def tree(n: str, s: str, by: str, count: int) -> None:
        run = f"PARTITION BY {by}, pos // 16 ORDER BY pos ROWS BETWEEN"
        for k in range(count):
            parts.append(f"""
  {s}{k} AS (SELECT {by}, pos, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {n}{k} WHERE m > 1),
  {n}{k + 1} AS (SELECT {by}, pos // 16 AS pos, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h,
    (any_value(m) + 15) // 16 AS m FROM {n}{k} GROUP BY {by}, pos // 16)""")

    def folded(values: str, s: str, by: str, place: str, count: int) -> str:
        for k in range(count):
            values = f"""(SELECT v.* REPLACE (coalesce(sha256(b || f || a), f) AS f, p || coalesce(b || a, '') AS p)
    FROM {values} v LEFT JOIN {s}{k} s ON v.{by} = s.{by} AND v.{place} // {16 ** k} = s.pos)"""
        return values

    tree("n", "s", "g", levels)
    parts.append(f"""
  g0 AS (SELECT 0 AS z, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS m, g FROM n{levels})""")
    tree("g", "t", "z", group_levels)
    rows = f"(SELECT v.*, 0 AS z, g0.pos AS gpos, g0.h AS subroot FROM {folded('leaves', 's', 'g', 'pos', levels)} v JOIN g0 USING (g))"
    return ",".join(parts) + f",\n  done AS (SELECT * FROM {folded(rows, 't', 'z', 'gpos', group_levels)})"


def _leaf_sql(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in fields) + ")"


_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
    lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
    lambda y, j: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)))"""


@query("op11_manifest", f"""
WITH hashed AS (
  SELECT *, coalesce('=' || source, '') AS g, {_leaf_sql('text')} AS h, CASE WHEN {_CRC_SQL} % 5 = 0
    THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents),
  n0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, h, count(*) OVER (PARTITION BY g) AS m, doc_id, changed FROM hashed),
  leaves AS (SELECT g, pos, doc_id, h AS leaf, coalesce(changed, h) AS f, '' AS p FROM n0),{_merkle_sql(6, 3)}
SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified FROM done, g3""")
def op11_manifest(spark, folder):
    return manifest.manifest(table(spark, folder, "documents"))


@query("op12_licenses")
def op12_licenses(spark, folder):
    read = table(spark, folder, "documents").select("doc_id", licenses.scan_column()("text").alias("s")).select("doc_id", "s.*")
    found, base = F.col("found"), licenses.of_kind(F.col("found"), "base")
    words = F.transform(base, lambda p: p.word)
    return read.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        licenses.label_list(base).alias("base_labels"), licenses.label_list(found).alias("labels"), licenses.freedom(found).alias("score"),
        F.array_join(F.array_distinct(F.filter(F.transform(found, lambda p: p.expression), lambda e: e.isNotNull())), "; ").alias("expressions"),
    )


@query("op13_audit", r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
judged AS (
  SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM judged LEFT JOIN marks USING (doc_id)),
counted AS (SELECT part, f, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM failed GROUP BY part, f),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s, 1 << (ord(o[s]) - 65) AS own, CAST(coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ord(o[i]) - 65))), 0) AS INT) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS s)),
report AS (
  SELECT part, o, s, own, sum(n) FILTER (f & (before | own) = 0) AS kept, sum(n) FILTER (f & before = 0 AND f & own > 0) AS removed,
    sum(n) FILTER (f & before > 0 AND f & own > 0) AS redundant, sum(n) FILTER (f = own) AS unique_fails,
    sum(good) FILTER (f & before = 0 AND f & own > 0) AS good_lost, sum(toxic) FILTER (f & before = 0 AND f & own > 0) AS toxic_lost
  FROM counted, steps GROUP BY ALL)
SELECT part, o AS filter_order, CAST(s AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM report""")
def op13_audit(spark, folder):
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
