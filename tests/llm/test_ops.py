"""Operators against brute force, round trips and edge rows, on small tables."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskfeat.llm import bpe, hashing, jaccard, merges, neardup, packing, quality, secrets, sharding, topk, toxicity, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "a", "Don't <|endoftext|> stop", "naïve Éa ß 12 ²½ \x1c\x85 ​漢字", "x" * 3000, "one two three " * 4000, "a", "\r\n\t"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def byte_bpe():
    return bpe.ByteBpe(open(BYTE, encoding="utf-8").read()), Tokenizer.from_file(BYTE)


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_byte_bpe_equals_library(byte_bpe, text):
    ours, theirs = byte_bpe
    ids = np.frombuffer(ours.encode(text), "<u4").tolist()
    assert ids == theirs.encode(text, add_special_tokens=False).ids
    assert ours.decode(ours.encode(text)) == theirs.decode(ids, skip_special_tokens=False) == text


def test_long_words_equal_the_scan(byte_bpe):
    ours, _ = byte_bpe
    word = bytes(random.Random(1).choices(b"abcdefgh", k=500))
    parts = [ours.byte_ids[b] for b in word]
    assert ours._long_word(list(parts)) == Tokenizer.from_file(BYTE).encode(word.decode()).ids


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_word_bpe_equals_library(text):
    ours = packing.WordEndBpe(open(WORD, encoding="utf-8").read())
    theirs = Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs


def test_bpe_columns(spark):
    df = frame(spark, [(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    encode, decode = bpe.encoder(spark, BYTE), bpe.decoder(spark, BYTE)
    rows = df.select("doc_id", "text", encode("text").alias("p")).select("*", decode("p").alias("back")).collect()
    assert all((r.text or "") == r.back for r in rows) and len(rows) == len(TEXTS)


COMMON = "abestmdrevl'''  \n\t\r_-.,;09 ABSTé ÀȺ'<|endoftext|>\x00\x07"


@pytest.mark.parametrize("kind, path", [(bpe.ByteBpe, BYTE), (packing.WordEndBpe, WORD)])
def test_blocks_of_texts_equal_library(kind, path, monkeypatch):
    """Also where hashes of words are equal, for long words and a text that is longer than a block."""
    rng = random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(COMMON, k=rng.randrange(40))) for _ in range(4000)]
    texts += ["re 've 'st x'rest ''s .'s 's", " ", "  a", "\n 's", "a" * 63, "ab" * 32, "é" * 65, "word, " * 200_000]
    theirs = Tokenizer.from_file(path)
    want = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    ours = kind(open(path, encoding="utf-8").read())
    assert [np.frombuffer(ids, "<u4").tolist() for ids in ours.encode_all(texts)] == want
    monkeypatch.setattr(merges, "span_hashes", lambda data, starts, ends: starts % 7)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in ours.encode_all(texts[:2000])] == want[:2000]
    assert ours.encode_all([]) == []


@pytest.mark.parametrize("kind, path", [(bpe.ByteBpe, BYTE), (packing.WordEndBpe, WORD)])
def test_words_of_common_texts_are_merged_in_bulk(kind, path, monkeypatch):
    ours = kind(open(path, encoding="utf-8").read())
    alone = []
    monkeypatch.setattr(ours.merges, "alone", lambda word: alone.append(word) or [7])
    ours.encode_all([f"word{i} naïve " for i in range(500)] + ["x" * 65])
    assert [w.strip() for w in alone] == [b"x" * 65]
    assert not (ours.cache if kind is bpe.ByteBpe else ours.words)


def test_packing_places_every_piece_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["ab", "cde", "fgh,"], k=rng.choice([0, 1, 5, 300, 900, 2500, 5000])))) for i in range(150)]
    rows += [(i, t) for i, t in enumerate(TEXTS)]
    df = frame(spark, rows, "doc_id long, text string")
    got = packing.pack(df, WORD).toPandas()
    theirs = Tokenizer.from_file(WORD)
    want = sorted(
        (d, n, i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes()))
        for d, t in rows for ids in [theirs.encode(t or "", add_special_tokens=False).ids + [0]] for n, i in enumerate(range(0, len(ids), 2048))
    )
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 1.05 + 1


@settings(max_examples=100, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=20))
def test_plan_uses_every_piece(counts):
    used = {}
    for b in packing.plan(counts, 60):
        assert sum(n * k for n, k in b.runs) + b.gap == 60
        for n, k in b.runs:
            used[n] = used.get(n, 0) + k * b.count
    assert used == counts


def test_jaccard_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = rng.choices(vocabulary, k=60)
    texts = [None, "", "one two", "One  two", "one two three"]
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.randint(4, 90)) + (shared if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, texts[7], 0), (8, texts[8], 0)]
    df = frame(spark, rows, "doc_id long, text string, g long")
    sets = list(jaccard.shingle_sets(pa.array(texts), 4))
    tied = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                shared_ = len(np.intersect1d(a, b))
                if len(a) and 100 * shared_ >= 85 * (len(a) + len(b) - shared_):
                    tied[i] = tied[j] = min(tied[i], tied[j])
    for options in ({}, {"wide": 1, "members": 2}, {"wide": 2, "heavy": 10}):
        got = jaccard.similar_documents(df, **options).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(s), tied[i]) for i, s in enumerate(sets)}


def test_jaccard_ties_the_first_links_once(spark, monkeypatch):
    """Without wide columns there is no second pass; else it goes on from stars, not from all links."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:50], f"x{i}", *base[50:]])) for i in range(12)] + [(20 + i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(5)]
    df = frame(spark, rows, "doc_id long, text string")
    given, ties = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: given.append(edges) or ties(edges))
    for options, calls in (({}, 1), ({"wide": 1, "members": 1}, 2)):
        given.clear()
        got = {r.doc_id: r.component_id for r in jaccard.similar_documents(df, **options).collect()}
        assert got == {i: 0 if i < 20 else i for i, _ in rows}
        assert len(given) <= calls
        assert all(e.filter("a <> b").groupBy("a").count().filter("count > 1").isEmpty() for e in given[1:])


def test_shingles_are_of_words():
    a, b, c = jaccard.shingle_sets(pa.array(["A b\tc\n d e", "a B C D E", "a b c d"]), 4)
    assert a.tolist() == b.tolist() and set(c) < set(a) and len(a) == 2
    assert len({x for s in jaccard.shingle_sets(pa.array([f"w{i}" for i in range(5000)]), 4) for x in s.tolist()}) == 5000


SECRETS = [
    "token=a.secret:abcdefghijklmnop", "PassWord : 'abcdef123456' api_key=\"0123456789abcdef\"", "AKIAABCDEFGHIJKLMN AKIAAKIAABCD",
    "é deadbeefdeadbeef00 passwd=short", "apikey:abcdefghijkl" * 3, None, "", "0123456789abcdef" + " x" * 5000 + "SECRET==aaaaaaaaaaaa",
]


def test_secrets_against_python(spark):
    import re

    df = frame(spark, [(i, t, 1) for i, t in enumerate(SECRETS)] + [(None, SECRETS[1], 2), (1, SECRETS[1], 3)], "doc_id long, text string, mask int")
    got = secrets.scan(df).withColumn("listed", secrets.listed(F.col("spans"))).withColumn("clean", secrets.redacted(F.col("text"), F.col("spans"))).collect()
    assert len(got) == len(SECRETS) + 2
    for r in got:
        want = sorted(
            (m.start(), n, m.end()) for n, rule in enumerate(secrets.RULES)
            for m in re.finditer(rule.pattern, r.text or "", re.ASCII) if len(m[rule.group]) >= rule.least
        )
        assert r.listed == ",".join(f"{secrets.RULES[n].kind}:{a}:{b}" for a, n, b in want)
        assert r.text is None or "deadbeefdeadbeef00" not in r.clean


def test_trigram_queries():
    by_kind = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert by_kind["hex"] == [] and by_kind["access"] == [frozenset({"aki", "kia"})]
    assert all(any(a <= {w[i : i + 3] for i in range(len(w))} for a in by_kind["assign"]) for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
    assert secrets.trigram_query("ab|cdef") == [] and secrets.trigram_query("(?:foo|bar)+x*baz") != []


def test_sharding(spark):
    names = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(names, 701)
    sizes = [table.count(i) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1
    fewer = sharding.lookup_table(names[:-1], 701)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 0.35 * 701
    got = sharding.place(frame(spark, [(1, "a"), (1, "b"), (None, "c")], "k long, shard string"), "k", names, 701).collect()
    assert len(got) == 3 and all(r.shard == table[r.slot] for r in got)


def test_warc_round_trip(spark):
    rows = [(1, "http://a b\n", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "http://é", "é" * 70000), (None, "n", "same")]
    got = {r.page_id: r for r in warc.round_trip(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 6
    for page_id, _, html in rows:
        data, r = (html or "").encode(), got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.refers_to == {1: 2, None: 2, 3: 4}.get(page_id) and (r.record_type == "revisit") == (r.refers_to is not None)
        assert r.record_type == "revisit" or bytes(r.payload) == data


def test_warc_reader_finds_damage():
    import gzip
    import io

    good = gzip.compress(warc.record(1, "u", b"abc", warc.digest(b"abc")))
    assert [r.payload() for r in warc.records(io.BytesIO(good * 3).read)] == [(3, b"abc")] * 3
    for bad in (good[:-9], good + b"junk", gzip.compress(warc.record(1, "u", b"abc", warc.digest(b"abd")))):
        with pytest.raises(warc.DamagedArchive):
            list(warc.records(io.BytesIO(bad).read))


def test_top_k_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 3, 4).astype(float).tolist()) for i in range(300)]
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0]), (400, [float("nan")] * 4), (450, [1.0, 2.0]), (None, [1.0] * 4), rows[0]]
    rows += [(100, rng.integers(-3, 3, 4).astype(float).tolist()) for _ in range(8)] + [(7, rows[7][1])] * 3 + [(150, [3.0] * 4)] * 12
    df = frame(spark, [(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, id int, v string")
    got = topk.top_k(df.repartition(5), lambda i: i % 50 == 0, parts=4, rows=64).collect()
    used = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and len(v) == 4]
    x, ids = np.array([v for _, v in used]), np.array([i for i, _ in used])
    want = []
    for q in np.flatnonzero(ids % 50 == 0):  # every row is a query of its own, whatever its id
        order = [j for j in np.lexsort((ids, -(x @ x[q]))) if j != q][:5]
        want += [(int(ids[q]), n + 1, int(ids[j]), int(x[j] @ x[q])) for n, j in enumerate(order)]
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) == 5 * (6 + 1 + 8 + 12)


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base + 0.08 * rng.normal(size=base.shape) for _ in range(5)])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(1000, rows[0][1], 0), (1001, [0.0] * 16, 0), (1002, None, 1), (1003, rows[1][1], None), (1004, [float("inf")] * 16, 1)]
    df = frame(spark, rows, "vec_id long, embedding array<double>, label int")
    good = [r for r in rows if r[0] <= 1000]
    u = np.array([r[1] for r in good])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([r[2] for r in good])
    links = (u @ u.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(links, False)
    root = neardup.roots(links)
    want = {good[i][0]: (int(links[i].sum()), good[root[i]][0]) for i in range(len(good))} | {i: (0, i) for i in range(1001, 1005)}
    for target in (1500, 40):
        got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(df, target=target).collect()}
        assert len(got) == len(rows) and sum(min(got[i][0], want[i][0]) for i in want) >= 0.9 * sum(n for n, _ in want.values())
        assert target < 1500 or got == want
        assert all(got[i][0] <= want[i][0] for i in want)


def test_top_k_of_empty_vectors(spark):
    rows = [(0, []), (1, []), (2, [1.0]), (50, [2.0])]
    got = topk.top_k(frame(spark, rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, rows=64).collect()
    assert {tuple(r) for r in got} == {(0, 1, 1, 0), (50, 1, 2, 2 * 256 * 256)}


@pytest.mark.parametrize("noise", [0.02, 0.09])
def test_near_duplicates_of_a_family_larger_than_a_block(spark, noise):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=16) + noise * rng.normal(size=(400, 16)), rng.normal(size=(100, 16))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.93
    np.fill_diagonal(links, False)
    root = neardup.roots(links)
    got = neardup.near_duplicates(frame(spark, rows, "vec_id long, embedding array<double>, label int"), target=40).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, int(links[i].sum()), int(root[i])) for i in range(500)]


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, data_dir, operator, label):
    docs, labels = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = operator.fit(docs, labels)
    extra = frame(spark, [(-1, None), (-2, "")], "doc_id long, text string")
    scored = docs.select("doc_id", "text").union(extra).select("doc_id", operator.score(docs, model).alias("score")).toPandas()
    assert scored.score.between(0, 1).all() and len(scored) == docs.count() + 2
    unseen = scored.merge(labels.filter(operator.held_out(F.col("doc_id"))).toPandas(), on="doc_id")
    assert len(unseen) > 10
    ones, zeros = unseen[unseen[label] == 1].score, unseen[unseen[label] == 0].score
    assert (ones.to_numpy()[:, None] > zeros.to_numpy()[None]).mean() > 0.8
    seen = scored.merge(labels.filter(~operator.held_out(F.col("doc_id"))).toPandas(), on="doc_id")
    ones, zeros = seen[seen[label] == 1].score, seen[seen[label] == 0].score
    assert (ones.to_numpy()[:, None] > zeros.to_numpy()[None]).mean() > 0.9
    none = operator.fit(docs, labels.limit(0))
    assert none.score(pa.array(["a", None])).tolist() == [0.5, 0.5]


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["a bb ccc", None, "", "A  bb", "é" * 10]
    one = [w for _, w, _ in hashing.word_hashes(pa.array(texts), hashing.SPACED, True)][0]
    each = np.concatenate([w for t in texts for _, w, _ in hashing.word_hashes(pa.array([t], pa.string()), hashing.SPACED, True)])
    assert one.tolist() == each.tolist() and len(one) == 6 and one[0] == one[3]


def test_empty_tables(spark):
    docs, vectors = "doc_id long, text string, source string", "vec_id long, embedding array<float>, label int"
    assert jaccard.similar_documents(frame(spark, [], docs)).count() == 0
    assert packing.pack(frame(spark, [], docs), WORD).count() == 0
    assert secrets.scan(frame(spark, [], docs)).count() == 0
    assert sharding.place(frame(spark, [], docs), "doc_id").count() == 0
    assert topk.top_k(frame(spark, [], vectors), lambda i: i % 50 == 0).count() == 0
    assert neardup.near_duplicates(frame(spark, [], vectors)).count() == 0
    assert warc.round_trip(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_only_the_best_scores_of_a_block_are_placed():
    """A few of 4,096 scores a query, and all of its k best with their ties."""
    rng = np.random.default_rng(7)
    got, k = rng.integers(-10**6, 10**6, (50, 4096)).astype(np.float32), 5
    got[3] = 17
    q, v = topk.candidates(got, np.full(50, -(2.0**24), np.float32), k)
    kept = np.zeros(got.shape, bool)
    kept[q, v] = True
    assert (kept | (got < np.sort(got, axis=1)[:, -k][:, None])).all() and (np.diff(q) >= 0).all()
    assert kept[3].all() and kept.sum() < 4096 + 49 * 20
    assert not np.isin(topk.candidates(got, np.full(50, 18, np.float32), k)[0], [3]).any()


@pytest.mark.parametrize("scale", [1, 2**10, 2**22, 2**24])
def test_top_k_in_every_number_type(spark, scale):
    """Scores that fit in 24 bits, in 53 and in 63."""
    rng = np.random.default_rng(8)
    x = rng.integers(-60, 60, (120, 3))
    got = topk.top_k(frame(spark, [(i, v.astype(float).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, scale=scale, rows=40)
    x = x.astype(object) * scale
    want = []
    for q in (0, 50, 100):
        score = [int(s) for s in x @ x[q]]
        order = sorted((j for j in range(120) if j != q), key=lambda j: (-score[j], j))[:5]
        want += [(q, n + 1, j, score[j]) for n, j in enumerate(order)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
