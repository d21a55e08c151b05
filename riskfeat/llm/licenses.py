"""Licence scans: notice phrases and identifier tags found by one Aho-Corasick automaton over
the words of a text; the expression after a tag goes through a shunting-yard parser.

A text becomes its words (letters, digits and all beyond ASCII, A-Z in lower case) with single
spaces between, so a phrase is found wherever its words stand consecutively, whatever stands
between them. All places count; of the further phrases that begin at one word the longest does.

After a tag (``SPDX-License-Identifier:``) an expression reaches to the end of its line at most:
identifiers, ``and``, ``or``, ``with`` and parentheses, ``with`` binding first and ``or`` last.
It ends before the first sign or word that cannot go on; an operator left without a right side
is dropped, an open parenthesis is closed there. A tag without any identifier is no tag.

Every label has a freedom from 0 to 1 (``Policy.freedom``). Of ``a or b`` the freer counts, of
``a and b`` the stricter, ``with`` an exception goes half the way to 1. A text scores the least
freedom of all it names, and 0 if it names nothing.

Memory is a text and its places. Defined results: a null text is an empty text; a text without
places has an empty list; unknown identifiers get the label ``other``; very long texts and very
deep parentheses are read whole, without recursion; rows are mapped one by one, so ties,
repeated rows, null ids and other columns stay as they are; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The base phrases, further phrases and tags of this scan.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
FURTHER = (
    ("affero general public license", "agpl"), ("lesser general public license", "lgpl"),
    ("library general public license", "lgpl"), ("gnu gpl", "gpl"), ("bsd license", "bsd"), ("2 clause bsd", "bsd"),
    ("3 clause bsd", "bsd"), ("isc license", "isc"), ("zlib license", "zlib"), ("boost software license", "bsl"),
    ("mozilla public license", "mpl"), ("eclipse public license", "epl"), ("the unlicense", "unlicense"),
    ("public domain", "public-domain"), ("creative commons zero", "cc0"), ("cc0 1 0", "cc0"), ("cc by", "cc-by"),
    ("cc by sa", "cc-by-sa"), ("cc by nc", "cc-by-nc"), ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc-by"), ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution share alike", "cc-by-sa"), ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution non commercial", "cc-by-nc"), ("all rights reserved", "reserved"),
)
TAGS = ("spdx license identifier", "license expression")
#: Freedom of each label; an identifier has the label that it is or that it begins with before a hyphen.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc0": 1.0,
    "apache": 0.95, "cc-by": 0.9, "mpl": 0.7, "epl": 0.65, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3,
    "other": 0.25, "cc-by-nd": 0.15, "cc-by-nc": 0.1, "reserved": 0.0,
}
BINDS = {"or": 1, "and": 2, "with": 3}

#: A-Z in lower case, other ASCII signs than letters and digits as spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
DOWN = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
COLON = re.compile(rb"[ \t]*:")
TOKEN = re.compile(rb"[ \t]*([()]|[0-9a-z](?:[0-9a-z.+:-]*[0-9a-z+])?)")

FOUND = "array<struct<kind:string,label:string,word:long,freedom:double,expression:string>>"


@dataclass(frozen=True)
class Policy:
    base: tuple[tuple[str, str], ...] = BASE
    further: tuple[tuple[str, str], ...] = FURTHER
    tags: tuple[str, ...] = TAGS
    freedom: tuple[tuple[str, float], ...] = field(default=tuple(FREEDOM.items()))


@dataclass(frozen=True)
class Place:
    kind: str
    label: str
    word: int
    freedom: float
    expression: str | None = None


def tokens(line: bytes) -> Iterator[str]:
    at = 0
    while m := TOKEN.match(line, at):
        yield m[1].decode("latin-1")
        at = m.end()


def postfix(parts: Iterator[str]) -> list[str]:
    """The longest expression at the beginning of the parts, operators after their sides."""
    out: list[str] = []
    held: list[str] = []
    side, depth = False, 0  # whether a side stands complete; parentheses open
    for part in parts:
        if not side:
            if part == "(":
                held.append(part)
                depth += 1
            elif part == ")" or part in BINDS:
                break
            else:
                out.append(part)
                side = True
        elif part in BINDS:
            while held and BINDS.get(held[-1], 0) >= BINDS[part]:
                out.append(held.pop())
            held.append(part)
            side = False
        elif part == ")" and depth:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        else:
            break
    if not side:  # what waits for a right side goes, and so do parentheses with nothing in them
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    return out + [p for p in reversed(held) if p != "("] if out else []


def exceptions(expression: list[str]) -> set[int]:
    """Places in a postfix expression of what stands to the right of ``with``."""
    stack, out = [], set()
    for i, part in enumerate(expression):
        if part in BINDS:
            right, left = stack.pop(), stack.pop()
            if part == "with":
                out.add(right)
            stack.append(left)
        else:
            stack.append(i)
    return out


class Scanner:
    """The automaton and the freedoms of one policy."""

    def __init__(self, policy: Policy):
        self.freedom = {"other": 0.25} | dict(policy.freedom)
        meanings: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", policy.base), ("phrase", policy.further), ("tag", [(t, "") for t in policy.tags])):
            for phrase, label in phrases:
                meanings.setdefault(f" {phrase} ", []).append((kind, label))
        self.automaton = ahocorasick.Automaton()
        for key, value in meanings.items():
            # words in letters of one byte each, as the texts are
            key = key.encode().decode("latin-1")
            self.automaton.add_word(key, (len(key), key.count(" ") - 1, value))
        self.automaton.make_automaton()

    def free(self, label: str) -> float:
        return self.freedom.get(label, self.freedom["other"])

    def label(self, identifier: str) -> str:
        name = identifier.rstrip("+")
        while name:
            if name in self.freedom:
                return name
            name = name.rpartition("-")[0]
        return "other"

    def evaluated(self, expression: list[str]) -> float:
        stack: list[float] = []
        for part in expression:
            if part not in BINDS:
                stack.append(self.freedom[self.label(part)])
                continue
            right, left = stack.pop(), stack.pop()
            stack.append(max(left, right) if part == "or" else min(left, right) if part == "and" else (left + 1) / 2)
        return stack[0]

    def tagged(self, raw: bytes, hits: list[tuple[int, int]]) -> Iterator[Place]:
        """The places of expressions; a hit is the first word of a tag and its number of words."""
        down, ends = raw.translate(DOWN), {first + n - 1: first for first, n in hits}
        for i, m in enumerate(WORD.finditer(down)):
            if i not in ends or not (colon := COLON.match(down, m.end())):
                continue
            stop = min((x for x in (down.find(b"\n", colon.end()), down.find(b"\r", colon.end())) if x >= 0), default=len(down))
            found = postfix(tokens(down[colon.end() : stop]))
            if not found:
                continue
            freedom, text = self.evaluated(found), " ".join(found)
            aside = exceptions(found)
            for k, part in enumerate(found):
                if part not in BINDS and k not in aside:
                    yield Place("tag", self.label(part), ends[i], freedom, text)

    def scan(self, raw: bytes) -> tuple[int, list[Place]]:
        """The number of words, and all places in the order of their first words."""
        words = raw.translate(LETTERS).split()
        line = b" ".join([b"", *words, b""])
        found: list[Place] = []
        hits = list(self.automaton.iter(line.decode("latin-1")))
        if not hits:
            return len(words), found
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        firsts = np.searchsorted(spaces, [end - size + 1 for end, (size, *_) in hits]).tolist()
        tags, longest = [], {}
        for first, (_, (size, words_in, meanings)) in zip(firsts, hits):
            for kind, label in meanings:
                if kind == "base":
                    found.append(Place(kind, label, first, self.free(label)))
                elif kind == "tag":
                    tags.append((first, words_in))
                elif size > longest.get(first, (0, ""))[0]:
                    longest[first] = size, label
        found += [Place("phrase", label, first, self.free(label)) for first, (_, label) in longest.items()]
        if tags:
            found += self.tagged(raw, tags)
        return len(words), sorted(found, key=lambda p: (p.word, p.kind, p.label))


@lru_cache(8)
def scanner(policy: Policy) -> Scanner:
    return Scanner(policy)


def scan_column(policy: Policy = Policy()):
    """A column function: text -> n_words and ``found``, its places."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("freedom", pa.float64()), ("expression", pa.string())]))

    @F.arrow_udf(f"struct<n_words:long,found:{FOUND}>")
    def scan(texts: pa.Array) -> pa.Array:
        known = scanner(policy)
        counts, places = [], []
        for text in texts.cast(pa.large_binary()):
            n, found = known.scan(text.as_py() or b"")
            counts.append(n)
            places.append([vars(p) for p in found])
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(places, kind)], ["n_words", "found"])

    return scan


def of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda p: p.kind == kind)


def label_list(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda p: p.label))), ",")


def freedom(found: Column) -> Column:
    """The least freedom of all places, 0 without any."""
    return F.coalesce(F.array_min(F.transform(found, lambda p: p.freedom)), F.lit(0.0))
