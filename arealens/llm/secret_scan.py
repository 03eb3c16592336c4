"""Secret scans with a trigram inverted index.

Each rule is a regular expression.  From its parse tree follows a Boolean query
over trigrams: the alternatives of what every match must contain.  The index
holds postings (trigram, doc_id) for the trigrams that some rule's query names;
intersecting the postings of a clause gives its documents, the union over the
clauses the rule's candidates, and only those are searched with the expression.
Rules whose matches need not hold any trigram scan all texts.

Texts and trigrams are compared in lower case, so the index may admit a document
too many (the expression then finds nothing) but never loses one.  Only
DataFrame functions run on the executors; the queries are derived on the driver.

Spans are the leftmost, non-overlapping matches of a rule, in code points of the
whole text, end exclusive; a match whose counted group is shorter than
``at_least`` is dropped after it was found.

Defined results
* null text has no span; empty table: empty result;
* rows that repeat a doc_id are searched each for itself, candidates are shared;
  a null doc_id is a value like any other;
* extra columns pass through; ``found`` replaces a column of that name.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``group``'s text must have ``at_least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


# Fixed patterns: the three base kinds, in order, then common key formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{20,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")


def _texts(node) -> list[str] | None:
    """All texts that a parsed item can match, if they are few; else None."""
    op, arg = node
    if op is C.LITERAL:
        return [chr(arg).lower()]
    if op is C.IN:
        out: list[str] = []
        for kind, value in arg:
            if kind is C.LITERAL:
                out.append(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < 8:
                out += [chr(c).lower() for c in range(value[0], value[1] + 1)]
            else:
                return None
        return sorted(set(out))
    if op is C.BRANCH:
        return _union([_sequence_texts(b) for b in arg[1]])
    if op is C.SUBPATTERN:
        return _sequence_texts(arg[3])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 4:
        once = _sequence_texts(arg[2])
        if once is not None and len(once) ** arg[1] <= MAX_ALTERNATIVES:
            return _union([["".join(p) for p in itertools.product(once, repeat=k)] for k in range(arg[0], arg[1] + 1)])
    return None


def _union(sets: list[list[str] | None]) -> list[str] | None:
    if any(s is None for s in sets):
        return None
    out = sorted({x for s in sets for x in s})
    return out if len(out) <= MAX_ALTERNATIVES else None


def _sequence_texts(items) -> list[str] | None:
    out = [""]
    for item in items:
        more = _texts(item)
        if more is None or len(out) * len(more) > MAX_ALTERNATIVES:
            return None
        out = [a + b for a in out for b in more]
    return sorted(set(out))


def _absorb(clauses: set[frozenset]) -> set[frozenset]:
    """Drop a clause that another one implies; an empty clause means no condition."""
    return {c for c in clauses if not any(o < c for o in clauses)}


def _both(left: set[frozenset], right: set[frozenset]) -> set[frozenset]:
    return _absorb({a | b for a in left for b in right})


def _grams(texts: list[str]) -> set[frozenset]:
    return _absorb({frozenset(t[i:i + 3] for i in range(len(t) - 2)) for t in texts})


def _query(items) -> set[frozenset]:
    """Alternatives (sets of trigrams) of which every match holds at least one whole."""
    found, run = {frozenset()}, [""]
    for item in items:
        more = _texts(item)
        if more is not None and len(run) * len(more) <= MAX_ALTERNATIVES:
            run = sorted({a + b for a in run for b in more})
            continue
        found, run = _both(found, _grams(run)), more if more is not None else [""]
        if more is None:
            op, arg = item
            inner = None
            if op is C.SUBPATTERN:
                inner = _query(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                inner = _query(arg[2])
            elif op is C.BRANCH:
                inner = _absorb(set().union(*(_query(b) for b in arg[1])))
            if inner:
                found = _both(found, inner)
    return _both(found, _grams(run))


def trigram_query(pattern: str) -> list[list[str]]:
    """The rule's query in disjunctive form; ``[]`` where no trigram is mandatory."""
    clauses = _query(_parser.parse(pattern))
    return [] if frozenset() in clauses else sorted(sorted(c) for c in clauses)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index over the rules' trigrams: (trigram, doc_id), a row for each document that holds it."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(doc_id, kinds): the postings of each clause intersected, clauses united.

    A document's postings are at most as many as the rules have trigrams."""
    held = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    kinds = []
    for kind, clauses in queries.items():
        whole = [F.size(F.array_except(F.array(*map(F.lit, c)), F.col("held"))) == 0 for c in clauses]
        test = whole[0]
        for w in whole[1:]:
            test = test | w
        kinds.append(F.when(test, F.lit(kind)))
    return (held.select(F.col("doc_id").alias("__id"), F.array_compact(F.array(*kinds)).alias("__kinds"))
            .where(F.size("__kinds") > 0))


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """array<struct<start, rank, end, kind>> of one rule's matches.

    Splitting at the pattern gives the texts between the matches, so the lengths
    of both add up to the places."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"),
                          F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"))
    hits = F.filter(zipped, lambda x: x["hit"].isNotNull())
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")

    def step(s: Column, x: Column) -> Column:
        start = (s["at"] + F.length(x["gap"])).cast("bigint")
        end = (start + F.length(x["hit"])).cast("bigint")
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        kept = F.when(F.length(x["value"]) >= rule.at_least, F.concat(s["out"], span)).otherwise(s["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    walked = F.aggregate(hits, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step)
    return F.when(text.rlike(rule.pattern), walked["out"]).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``found``: array<struct<start, rank, end, kind>> by start, then rule order."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    trigrams = sorted({t for q in indexed.values() for c in q for t in c})
    rows = docs
    if indexed:
        hits = candidates(postings(docs, trigrams), indexed)
        rows = docs.join(hits, docs["doc_id"].eqNullSafe(hits["__id"]), "left").drop("__id")
    parts = []
    for rank, rule in enumerate(rules):
        spans = _spans(rule, rank, F.coalesce("text", F.lit("")))
        if rule.kind in indexed:
            spans = F.when(F.array_contains("__kinds", rule.kind), spans).otherwise(F.array().cast(
                "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
        parts.append(spans)
    return rows.withColumn("found", F.array_sort(F.concat(*parts))).drop("__kinds")


def joined(found: Column) -> Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                 x["end"].cast("string"))), ",")


def compiles() -> bool:
    """Every rule is valid here too (used by the tests)."""
    return all(re.compile(r.pattern) for r in RULES)
