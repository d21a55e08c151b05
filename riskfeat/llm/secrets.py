"""Secrets in texts, found through a trigram index. DataFrame functions only.

Each rule's regex gives a Boolean trigram query: any of some alternatives, each a set of
trigrams that every match must hold. The inverted index has a posting (trigram, row) for
the trigrams that occur in some query. The postings of a row meet in one bit mask; the
rows whose mask holds an alternative are the candidates of the rule, and only there does
the regex run. A rule without a mandatory trigram runs on every text.

Places are code points, end exclusive. They come from the lengths of the matches and of
the pieces between them, so a text is never walked by position.

Defined results: a null text is an empty text, without spans; repeated rows and rows that
share a key are scanned each for themselves; a null key is a key like others; an empty
table gives an empty table. Input columns other than the key and the text do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.llm.frames import fresh

try:  # the parser of Python's own regexes; its place depends on the version
    from re import _constants as sre, _parser as sre_parse
except ImportError:
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost, non-overlapping matches of ``pattern``, of which those
    stay whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int


# The kinds, in the order in which they are listed at equal starts.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)


# ---- from a regex to a trigram query ------------------------------------------------------

#: Literal alternatives are followed up to so many; beyond, a part counts as anything.
MOST_LITERALS = 64


def _literals(tokens) -> list[set[str]]:
    """The regex as a sequence of runs; each run is a set of literal alternatives, one of
    which stands there in every match. Between runs anything may stand."""
    runs: list[set[str]] = [{""}]

    def more(words: set[str] | None) -> None:
        if words is None:
            runs.append({""})
        elif len(runs[-1]) * len(words) <= MOST_LITERALS:
            runs[-1] = {a + b for a, b in product(runs[-1], words)}
        else:
            runs.append(words)

    for op, arg in tokens:
        if op is sre.LITERAL:
            more({chr(arg).lower()})
        elif op is sre.SUBPATTERN:
            inner = _literals(arg[-1])
            for n, run in enumerate(inner):
                more(run)
                if n + 1 < len(inner):
                    more(None)
        elif op is sre.BRANCH:
            parts = [_literals(branch) for branch in arg[1]]
            more({w for p in parts for w in p[0]} if all(len(p) == 1 for p in parts) else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            part = _literals(inner)
            if (least, most) == (0, 1) and len(part) == 1:
                more(part[0] | {""})
            else:
                for _ in range(min(least, 3)):
                    for run in part:
                        more(run)
                if least != most or len(part) > 1:
                    more(None)
        elif op is sre.IN and len(arg) <= 4 and all(o is sre.LITERAL for o, _ in arg):
            more({chr(c).lower() for _, c in arg})
        elif op is not sre.AT:
            more(None)
    return runs


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, of which one has all its trigrams in every lower-cased match; empty
    if there is no mandatory trigram. Of several runs the one with the longest words is used."""
    best: list[frozenset[str]] = []
    for run in _literals(sre_parse.parse(pattern)):
        words = [frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in run]
        if words and all(words) and (not best or min(map(len, words)) > min(map(len, best))):
            best = words
    least = [a for a in best if not any(b < a for b in best)]
    return sorted(set(least), key=sorted)


# ---- index and candidates ------------------------------------------------------------------


def _trigrams(rules) -> list[str]:
    return sorted({t for r in rules for alternative in trigram_query(r.pattern) for t in alternative})


def postings(df: DataFrame, key: str, text: str, rules=RULES) -> DataFrame:
    """The inverted index: (trigram number, key) for the trigrams of the rules' queries."""
    lowered = df.select(F.col(key), F.lower(F.col(text)).alias("low_"))
    found = F.array_compact(F.array(*(F.when(F.contains("low_", F.lit(t)), F.lit(n)) for n, t in enumerate(_trigrams(rules)))))
    return lowered.select(F.col(key), F.explode(found).alias("trigram"))


def candidates(df: DataFrame, key: str, text: str, rules=RULES) -> DataFrame:
    """(key, mask): bit n is set where all trigrams of an alternative of rule n occur."""
    numbers = {t: n for n, t in enumerate(_trigrams(rules))}
    if len(numbers) > 62:
        raise ValueError("more than 62 query trigrams: scan the rules in groups")
    held = postings(df, key, text, rules).groupBy(key).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram"))).alias("held_"))
    mask = F.lit(0)
    for n, rule in enumerate(rules):
        for alternative in trigram_query(rule.pattern):
            bits = sum(1 << numbers[t] for t in alternative)
            mask = mask.bitwiseOR(F.when(F.col("held_").bitwiseAND(F.lit(bits).cast("long")) == bits, 1 << n).otherwise(0))
    return held.select(F.col(key), mask.alias("mask_")).filter("mask_ > 0")


# ---- spans ------------------------------------------------------------------------------------


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end>> of one rule's matches that are long enough."""
    pattern = F.lit(rule.pattern)
    lengths = lambda strings: F.transform(strings, lambda s: F.char_length(s))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    cells = F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"), lengths(whole).alias("whole"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("part"),
    )
    none = F.array().cast("array<struct<start:long,rank:int,end:long>>")
    state = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(s, x):
        start = s["at"] + x["gap"]
        end = start + F.coalesce(x["whole"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(cells, state, step, lambda s: s["spans"])


def _likely(rule: Rule) -> str:
    """A quick test that each text with a match long enough passes."""
    least = rule.least if rule.group == 0 and rule.pattern.endswith("]+") and rule.pattern.startswith("[") else 0
    return f"{rule.pattern[:-1]}{{{least}}}" if least else rule.pattern


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES, into: str = "spans") -> DataFrame:
    """The rows with ``into``: array<struct<start, rank, end>> by start and rule. A column
    of that name is replaced."""
    df = df.drop(into)
    id_, mask = fresh("key", df), fresh("mask", df)
    content = F.coalesce(F.col(text), F.lit(""))
    indexed = {n for n, r in enumerate(rules) if trigram_query(r.pattern)}
    hits = candidates(df, key, text, rules).select(F.col(key).alias(id_), F.col("mask_").alias(mask))
    joined = df.join(hits, F.col(key).eqNullSafe(F.col(id_)), "left").drop(id_)
    none = F.array().cast("array<struct<start:long,rank:int,end:long>>")
    parts = []
    for n, rule in enumerate(rules):
        opened = F.rlike(content, F.lit(_likely(rule)))
        if n in indexed:
            opened = F.coalesce(F.col(mask).bitwiseAND(1 << n) > 0, F.lit(False)) & opened
        parts.append(F.when(opened, _spans(content, rule, n)).otherwise(none))
    return joined.withColumn(into, F.array_sort(F.concat(*parts))).drop(mask)


def listed(spans: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, and spans that overlap as one, replaced by the mark."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s, x):
        gap = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"]).alias("out"),
        )

    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, state, step, rest)).otherwise(text)


