"""Manifest, licence scans and filter audit against plain versions, with edge rows."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskfeat.llm import audit, licenses, manifest
from riskfeat.llm import queries as llm_queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x) for x in r])


# ---- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def beside(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
        i //= 16
    return out


def plain_manifest(rows):
    groups = {}
    for doc_id, text, lang, source, n in rows:
        def leaf(t):
            return sha(*map(field, (doc_id, source, lang, n, t)))

        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        small = text and re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)
        entry = (doc_id is not None, doc_id or 0, leaf(text), leaf(small) if changed else leaf(text))
        groups.setdefault("" if source is None else "=" + source, []).append(entry)
    trees = {g: tree([x[2] for x in sorted(v)]) for g, v in groups.items()}
    names = sorted(groups, key=str.encode)
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (has, doc_id, leaf, changed) in enumerate(sorted(groups[g])):
            path = beside(trees[g], i) + beside(top, k)
            for before, after in path:
                changed = sha(before, changed, after)
            root = top[-1][0]
            out.append((doc_id if has else None, leaf, trees[g][-1][0], root, sha("".join(b + a for b, a in path)), changed, changed == root))
    return out


def test_manifest_against_plain_version(spark):
    """Null and extreme ids, ids with many rows, equal rows beyond a block, 40 groups of one to thousands."""
    rng = random.Random(1)
    ids = [None, 5, 5, -7, 2**63 - 1, -(2**63)]
    rows = [
        (rng.choice([*ids, rng.randrange(40), rng.randrange(10**6)]), rng.choice([None, "", "Aé", f"Tx{rng.randrange(9)}"]), None,
         rng.choice([None, "", "a", "é", f"src{rng.randrange(40)}"]), rng.choice([None, 3])) for _ in range(2000)
    ] + [(77, "same", "en", "a", 4)] * 5000 + [(8, "X" * 300_000, "en", "long", None)]
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], DOCS + ", g int, leaf string, `place` int")
    got = manifest.manifest(df.repartition(5))
    assert ordered(got.collect()) == ordered(plain_manifest(rows))
    # the order of arrival does not matter
    again = manifest.manifest(df.orderBy("text"))
    assert ordered(again.collect()) == ordered(plain_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257])
def test_manifest_sizes(spark, n):
    rows = [(i * 97, f"T{i}", "en", "s", i) for i in range(n)]
    got = manifest.manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert ordered(got) == ordered(plain_manifest(rows) if rows else [])


# ---- licences


def plain_expression(parts):
    """(freedom, identifiers) by recursive descent over a complete expression."""
    known = licenses.scanner(licenses.Policy())

    def chain(at, operator, below, value):
        result, names, at = below(at)
        while at < len(parts) and parts[at] == operator:
            right, more, at = below(at + 1)
            result, names = value(result, right), names + (more if operator != "with" else [])
        return result, names, at

    def one(at):
        if parts[at] == "(":
            result, names, at = whole(at + 1)
            return result, names, at + 1
        return known.free(known.label(parts[at])), [parts[at]], at + 1

    def exception(at):
        return chain(at, "with", one, lambda a, b: (a + 1) / 2)

    def both(at):
        return chain(at, "and", exception, min)

    def whole(at):
        return chain(at, "or", both, max)

    result, names, _ = whole(0)
    return result, names


def expressions(depth):
    name = st.sampled_from(["mit", "gpl-2.0-only", "apache-2.0", "cc-by-nc-4.0", "mpl-2.0+", "licenseref-x"])
    if not depth:
        return name.map(lambda x: [x])
    inner = expressions(depth - 1)
    return st.one_of(
        name.map(lambda x: [x]), inner.map(lambda x: ["(", *x, ")"]),
        st.tuples(inner, st.sampled_from(["and", "or"]), inner).map(lambda x: [*x[0], x[1], *x[2]]),
        name.map(lambda x: [x, "with", "some-exception"]),
    )


@settings(max_examples=200, deadline=None)
@given(parts=expressions(3))
def test_expressions_equal_recursive_descent(parts):
    known = licenses.scanner(licenses.Policy())
    _, found = known.scan(("SPDX-License-Identifier: " + " ".join(parts).replace("and", "AND") + " */").encode())
    freedom, names = plain_expression(parts)
    tagged = [p for p in found if p.kind == "tag"]
    assert sorted(p.label for p in tagged) == sorted(known.label(n) for n in names)
    assert all(p.freedom == pytest.approx(freedom) for p in tagged)


@pytest.mark.parametrize("line, postfix", [
    ("MIT AND", "mit"), ("MIT or (", "mit"), ("((mit", "mit"), ("mit) and isc", "mit"), ("and mit", ""), ("()", ""), ("mit isc", "mit"),
    ("mit or isc and bsd-3-clause", "mit isc bsd-3-clause and or"), ("a with b and c or d", "a b with c and d or"),
    ("(mit or\nisc)", "mit"), ("mit -->", "mit"), ("mit and (isc or", "mit isc and"), ("", ""),
])
def test_expressions_that_stop_early(line, postfix):
    down = line.encode().translate(licenses.DOWN).split(b"\n")[0]
    assert " ".join(licenses.postfix(licenses.tokens(down))) == postfix


def test_deep_parentheses_need_no_recursion():
    deep = b"SPDX-License-Identifier: " + b"(" * 50_000 + b"mit" + b")" * 50_000
    _, found = licenses.scanner(licenses.Policy()).scan(deep)
    assert [p.label for p in found] == ["mit"]


def test_licences_against_plain_version(spark):
    rng = random.Random(4)
    bits = ["MIT", "license", "License", "apache", "general", "public", "é", "lesser", ". ", "-", "\x1f", "\x85", " ", "\n", "mitlicense", "CC BY-NC 4.0", "cc by", "x9"]
    texts = [None, "", " ", "mit license " * 30_000] + ["".join(rng.choices(bits, k=40)) for _ in range(200)]
    texts += [" ".join(rng.choices(bits, k=30)) for _ in range(200)]
    rows = [(i if i % 50 else None, t, 1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found int, n_words string")
    got = df.select("doc_id", "text", licenses.scan_column()("text").alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        want = []
        for kind, phrases in (("base", licenses.BASE), ("phrase", licenses.FURTHER)):
            for i in range(len(words)):
                here = [(len(p), label) for p, label in phrases if words[i : i + len(p.split())] == p.split()]
                here = sorted(here, reverse=True)[: 1 if kind == "phrase" else None]
                want += [(i, kind, label) for _, label in here]
        assert r.s.n_words == len(words)
        assert [(p.word, p.kind, p.label) for p in r.s.found] == sorted(want)


def test_licence_query(spark, tmp_path):
    rows = [
        (1, "Released under the MIT License. SPDX-License-Identifier: MIT OR GPL-2.0-only", "en", "s", 1), (2, None, None, None, None),
        (3, "GNU General Public License; Apache License; general public license", "en", "s", 1), (None, "cc by-nc", "en", "s", 1),
    ]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in llm_queries.QUERIES["op12_licenses"](spark, str(tmp_path)).collect()}
    assert got[1] == (14, 1, 3, 3, "mit", "gpl,mit", 1.0, "mit gpl-2.0-only or")
    assert got[2] == (0, 0, None, None, "", "", 0.0, "")
    assert got[3] == (9, 3, 1, 6, "apache,gpl", "apache,gpl", 0.4, "")
    assert got[None] == (3, 0, None, None, "", "cc-by-nc", 0.1, "")


# ---- audit


@settings(max_examples=100, deadline=None)
@given(words=st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_positional_popcount(words):
    want = [sum(w >> b & 1 for w in words) for b in range(32)]
    assert audit.positional_popcount(np.array(words, np.uint64), 32).tolist() == want


def test_survival_words():
    words = audit.survival_words(5)
    assert all(int(words[f]) >> s & 1 == (f & s == 0) for f in range(32) for s in range(32))


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    judged = []
    for i, t, lang, *_ in docs:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = "".join(x for x, bad in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)),
            ("D", re.search(r"[#$%&*|]", t) is not None), ("E", i is not None and first[t] < i)) if bad)
        judged.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {p for p, *_ in judged}:
        rows, taken, lines = [r for r in judged if r[0] == part], {}, []
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone, kept = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                redundant = sum(x in r[1] for r in rows) - len(gone)
                lines.append([part, "".join(order), step, len(kept), len(gone), redundant, sum(r[1] == x for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone)])
                taken[x] = taken.get(x, 0) + len(gone)
                left = kept
        out += [(*line, taken[line[1][line[2] - 1]]) for line in lines]
    return out


def test_audit_against_plain_version(spark):
    rng = random.Random(5)
    texts = [None, "", "a b", "A B", "x # y", "w " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}|" for i in range(250)), "é\x85 " * 100, "LONG " * 100_000]
    docs = [(rng.choice([None, rng.randrange(150)]) if k % 9 == 0 else k, rng.choice(texts), rng.choice([None, "", "en", "de", "fr"]), None, None) for k in range(400)]
    labels = [(rng.choice([None, rng.randrange(400)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(300)]
    df = spark.createDataFrame([(*d, 1, "p") for d in docs], DOCS + ", failed int, part string")
    marks = spark.createDataFrame([(*m, "x") for m in labels], "doc_id long, quality int, toxic int, id string")
    assert ordered(audit.audit(df.repartition(7), marks).collect()) == ordered(plain_audit(docs, labels))


def test_audit_of_nothing(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], DOCS), marks).count() == 0
    got = audit.audit(spark.createDataFrame([(1, None, None, None, None)], DOCS), marks).collect()
    assert len(got) == 600 and ordered(got) == ordered(plain_audit([(1, None, None, None, None)], []))
