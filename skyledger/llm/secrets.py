"""Secrets by a trigram index: DataFrame functions only.

From each rule's pattern a Boolean trigram query is derived: the literal texts that a match
must begin with, each the AND of its trigrams, joined by OR. Postings (trigram, document)
are kept for the trigrams that some query asks for, and intersected per document; a rule is
verified only in the documents its query finds, and only their texts travel. A rule without mandatory trigrams
scans every text where it is read.

Texts may be of any length: no pattern looks at a place more than a bounded number of times. A null or empty text has no spans. Offsets are code points, the end is exclusive. Repeated
rows and ids give repeated results.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.llm.common import attach, keyed_texts, let, row_texts, running_sum, stored

_MOST_LITERALS = 64  # beyond so many alternatives a pattern counts as one without literals
_BITS = 63  # trigrams to a word of a document's set


@dataclass(frozen=True)
class Rule:
    """A pattern in the syntax that Java and Python share.

    ``group`` is the group whose length must be at least ``least`` (0: the whole match).
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


# The patterns of the rules.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs are maximal, so the least length can stand in the pattern
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
)


def literals(pattern: str) -> set[str] | None:
    """The texts, in lower case, of which every match begins with one; ``None`` if there is no such set."""

    def walk(nodes: list, heads: set[str]) -> tuple[set[str], bool]:
        """The texts extended by ``nodes``, and whether what follows still adjoins them."""
        for op, what in nodes:
            name = str(op)
            if name == "AT":
                continue  # a border has no width
            if name == "LITERAL":
                heads = {h + chr(what).lower() for h in heads}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in what):
                heads = {h + chr(c).lower() for h, (_, c) in product(heads, what)}
            elif name == "SUBPATTERN":
                heads, open_ = walk(list(what[-1]), heads)
                if not open_:
                    return heads, False
            elif name == "BRANCH":
                ways = [walk(list(way), heads) for way in what[1]]
                heads = set().union(*(h for h, _ in ways))
                if not all(open_ for _, open_ in ways):
                    return heads, False
            elif name == "MAX_REPEAT" and what[:2] == (0, 1):
                more, open_ = walk(list(what[2]), heads)
                if not open_:
                    return heads, False
                heads = heads | more
            else:
                return heads, False
            if len(heads) > _MOST_LITERALS:
                return {""}, False
        return heads, True

    heads, _ = walk(list(sre.parse(pattern)), {""})
    return heads if all(len(h) >= 3 for h in heads) else None


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of trigrams of which one must be in a matching text as a whole; ``None``: no such query."""
    found = literals(pattern)
    if found is None:
        return None
    sets = {frozenset(text[i : i + 3] for i in range(len(text) - 2)) for text in found}
    return sorted((s for s in sets if not any(other < s for other in sets)), key=sorted)


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, document) for the trigrams asked for; a document is ``doc_id`` and ``row_key``."""
    lowered = texts.select("doc_id", "row_key", F.lower("text").alias("low"))
    held = F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams])
    return lowered.select("doc_id", "row_key", F.explode(F.array_compact(held)).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]], trigrams: list[str]) -> DataFrame:
    """Documents with the kinds whose query their postings fulfil."""
    # A document's set takes as many words as the trigrams asked for need.
    place = {t: divmod(i, _BITS) for i, t in enumerate(trigrams)}
    number = F.element_at(F.create_map(*[F.lit(x) for t, (word, bit) in place.items() for x in (t, word * 64 + bit)]), F.col("trigram"))
    words = range(-(-len(trigrams) // _BITS))
    placed = index.select("doc_id", "row_key", number.alias("number")).selectExpr(
        "doc_id", "row_key", "shiftright(number, 6) AS word", "shiftleft(1L, number & 63) AS bit"
    )
    none = F.lit(0).cast("long")
    held = placed.groupBy("doc_id", "row_key").agg(
        *[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(none)).alias(f"held{w}") for w in words]
    )

    def fulfilled(sets: list[frozenset[str]]) -> Column:
        def within(s: frozenset[str]) -> Column:
            masks = [F.lit(sum(1 << bit for word, bit in map(place.get, s) if word == w)).cast("long") for w in words]
            return reduce(Column.__and__, [F.col(f"held{w}").bitwiseAND(m) == m for w, m in zip(words, masks)])

        return reduce(Column.__or__, [within(s) for s in sets])

    kinds = F.array_compact(F.array(*[F.when(fulfilled(sets), F.lit(kind)) for kind, sets in queries.items()]))
    return held.select("doc_id", "row_key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Sorted spans of one rule: the gaps between the matches and the matches give the places."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found

    def placed(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        rows = F.zip_with(
            F.arrays_zip(running_sum(steps).alias("before"), F.slice(x["gaps"], 1, F.size(x["found"])).alias("gap")),
            F.arrays_zip(x["found"].alias("match"), x["held"].alias("held")),
            lambda p, m: F.struct(
                (p["before"] + F.length(p["gap"])).alias("start"),
                F.lit(order).alias("order"),
                (p["before"] + F.length(p["gap"]) + F.length(m["match"])).alias("end"),
                F.lit(rule.kind).alias("kind"),
                m["match"].alias("value"),
                (F.length(m["held"]) >= rule.least).alias("right"),
            ),
        )
        return F.filter(rows, lambda s: s["right"])

    parts = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), found.alias("found"), held.alias("held"))
    return F.when(text.rlike(rule.pattern), let(parts, placed))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``spans`` by start, then by the order of the rules, with their texts."""
    texts = keyed_texts(docs)
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    asked = {kind: sets for kind, sets in queries.items() if sets is not None}
    trigrams = sorted({t for sets in asked.values() for s in sets for t in s})
    order = {rule.kind: n for n, rule in enumerate(rules)}
    found = lambda rule: spans_of(F.col("text"), rule, order[rule.kind]).alias(rule.kind)
    # Rules without a query look at every text; the others at those of their candidates.
    joined = texts.select("doc_id", "row_key", *[found(rule) for rule in rules if rule.kind not in asked])
    if asked:
        hits = stored(candidates(postings(texts, trigrams), asked, trigrams), "candidates")
        looked = row_texts(texts, hits)
        verified = [F.when(F.array_contains("kinds", rule.kind), found(rule)).alias(rule.kind) for rule in rules if rule.kind in asked]
        joined = attach(joined, looked.select("doc_id", "row_key", *verified).dropDuplicates(["doc_id", "row_key"]))
    every = F.flatten(F.array_compact(F.array(*[F.col(rule.kind) for rule in rules])))
    return joined.select("doc_id", F.array_sort(every).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, digest of the base spans and all spans as one string, a row for each row of ``docs``."""
    base = [rule.kind for rule in rules if rule.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return secret_spans(docs, rules).select(
        "doc_id",
        *[count(rule.kind).alias(f"n_{rule.kind}") for rule in rules],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
