"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes: insult, threat, target, negation, reported speech, other. Small transducers
read the classes of a clause and put out a factor for each word: an insult is full only where
it isn't negated or reported, a threat only with a target in the clause, before or behind it, and a target
before it strengthens an insult. What a threat weighs is put out late: its weight is held until a target or the end of
the clause is read. A negation may be a word or the end of one (``aren't``, ``n'es``). A colon ends a clause, but not one with a verb of
reporting, which reaches over it. They are composed into one table, and a clause's weight
is the sum of its words' weights times their factors. A logistic function of the weights
of all matched clauses, fitted on labels, is the document's score.

Insults are learned: whole words and stems (first 4 to 7 letters) that are far more frequent in
toxic than in other labelled texts. Threats, targets, negations and verbs of reporting are closed
classes, given as fixed values; threats are stems with the endings of their language.

Only texts are inputs of a score. Labels are learned from at most ``SAMPLE`` rows with
crc32(doc_id as text) mod ``FOLDS`` other than ``HELD``, in the order of a hash of ``doc_id``;
equal texts count once, as 0 if their labels differ, so no order of rows matters. A null text counts as empty and is scored like any other; a null ``doc_id`` is
never learned from and not held out. With labels of one class only, or none, all scores are the
share of ones, or 0.5. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skyledger.llm.common import map_in_arrow
from skyledger.llm.quality import fold, training_labels
from skyledger.llm.tokens import Memo

FOLDS, HELD = 3, 1
SAMPLE = 30_000
THRESHOLD = 0.7
STEMS = range(4, 8)
#: Of the toxic texts that hold an entry; log of the odds against other texts. The share bounds the entries: a hundred for each
#: word and stem that a toxic text of the sample has on average.
LEAST_SHARE, LEAST_ODDS = 0.01, 2.5

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# The closed word classes, and stems of threats with the endings they take in their language.
CLOSED = {
    TARGET: "you your yours yourself u he him his she her they them du dich dir dein ihr euch tu te toi vous tú ti usted ustedes",
    NEGATION: "not no never neither nor without cannot nicht kein keine nie niemals ne pas jamais sans nunca jamás sin n't n'",
    REPORT: "said says wrote quoted reported called claimed sagte schrieb zitierte berichtete dit écrit cité dijo escribió citó",
}
THREATS = [
    ("kill hurt destroy murder beat stab stabb shoot hang", "- s ed ing"),
    ("töt umbring schlag schläg schlug verprügel", "- e en n est st et t"),
    ("tu frapp cogn", "e es er ez ons erai era erons ant é"),
    ("détrui", "re s t rai ra sant"),
    ("mat golpe", "ar o as a an aré ará arte aros ando"),
    ("destru", "ir yo yes ye iré irá irte yendo"),
]

_PARTS = re.compile(r"[^\W\d_]+(?=n['’]t\b)|n['’]t\b|\bn['’]|[^\W\d_]+|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")
_LETTERS = r"[^\p{L}]+"


@dataclass(frozen=True)
class Transducer:
    """``table[state][class]`` is the next state and the factor for the word read.

    ``final[state]`` is the factor for the threats held when the clause ends in the state. A target
    releases them at their full weight.
    """

    table: tuple[tuple[tuple[int, float], ...], ...]
    final: tuple[float, ...]

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same classes; factors multiply."""
        n = len(other.table)
        return Transducer(
            tuple(
                tuple((a[0] * n + b[0], a[1] * b[1]) for a, b in zip(mine, theirs, strict=True))
                for mine in self.table for theirs in other.table
            ),
            tuple(a * b for a in self.final for b in other.final),
        )


def _row(next_of: dict[int, int], factor_of: dict[int, float], stay: int) -> tuple[tuple[int, float], ...]:
    return tuple((next_of.get(c, stay), factor_of.get(c, 1.0)) for c in range(6))


def negation(reach: int = 3, factor: float = 0.5) -> Transducer:
    """An insult or threat at most ``reach`` words behind a negation is weakened."""
    rows = [_row({NEGATION: reach}, {}, 0)]
    rows += [_row({NEGATION: reach}, {INSULT: factor, THREAT: factor}, left - 1) for left in range(1, reach + 1)]
    return Transducer(tuple(rows), (1.0,) * len(rows))


def reported(factor: float = 0.6) -> Transducer:
    """What stands behind a verb of reporting in the clause is weakened."""
    return Transducer((_row({REPORT: 1}, {}, 0), _row({}, {INSULT: factor, THREAT: factor}, 1)), (1.0, 1.0))


def targeted(bonus: float = 1.25, untargeted: float = 0.1) -> Transducer:
    """An insult with a target before it is stronger; a threat in a clause without any hardly counts."""
    return Transducer((_row({TARGET: 1}, {}, 0), _row({}, {INSULT: bonus}, 1)), (untargeted, 1.0))


GRAMMAR = targeted().compose(negation()).compose(reported())


def closed_words() -> dict[str, int]:
    """Every word of a closed class and its class; of two classes the one listed first in ``CLOSED``, threats last."""
    words = {w: THREAT for stems, ends in THREATS for stem in stems.split() for end in ends.split() for w in [stem + end.strip("-")]}
    return words | {w: c for c, listed in CLOSED.items() for w in listed.split()}


@dataclass
class Lexicon:
    """Class and weight of words; insults are entries (whole words) and stems."""

    entries: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    closed: dict[str, int] = field(default_factory=closed_words)

    def __post_init__(self):
        self.memo = Memo(self._look_up)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.memo = Memo(self._look_up)

    def _look_up(self, word: str) -> tuple[int, float, str] | None:
        """Class, weight and the matched entry; ``None`` for other words, ends of clauses as class -1."""
        if word in _ENDS:
            return (-1, 0.0, word)
        found = [(self.entries[word], word)] if word in self.entries else []
        found += [(self.stems[word[:n]], word[:n]) for n in STEMS if word[:n] in self.stems and len(word) >= n]
        if found:
            weight, entry = max(found)
            return (INSULT, weight, entry)
        kind = self.closed.get(word.replace("’", "'"))
        return None if kind is None else (kind, 2.0 if kind == THREAT else 0.0, word)


def clause_weights(text: str, lexicon: Lexicon) -> tuple[list[float], int]:
    """Weights of the clauses with an insult or threat, and the number of different entries matched."""
    parts = _PARTS.findall(text.lower())
    looked = list(map(lexicon.memo.__getitem__, parts))
    weights, matched, table, final = [], set(), GRAMMAR.table, GRAMMAR.final
    if not any(x is not None and x[0] in (INSULT, THREAT) for x in looked):
        return weights, 0
    state, weight, held, hit, said = 0, 0.0, 0.0, False, False
    for x in looked:
        if x is None:
            state = table[state][OTHER][0]
            continue
        kind, value, entry = x
        if kind == -1:
            if entry == ":" and said:
                continue
            if hit:
                weights.append(weight + final[state] * held)
            state, weight, held, hit, said = 0, 0.0, 0.0, False, False
            continue
        said |= kind == REPORT
        state, factor = table[state][kind]
        if kind == TARGET:
            weight, held = weight + held, 0.0
        elif kind == THREAT:
            hit = True
            held += factor * value
            matched.add(entry)
        elif kind == INSULT:
            hit = True
            weight += factor * value
            matched.add(entry)
    if hit:
        weights.append(weight + final[state] * held)
    return weights, len(matched)


def measures(text: str, lexicon: Lexicon) -> tuple[float, float, float]:
    """Total weight of the matched clauses, weight of the strongest, and different entries, as logarithms."""
    weights, different = clause_weights(text, lexicon)
    return float(np.log1p(sum(weights))), float(np.log1p(max(weights, default=0.0))), float(np.log1p(different))


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """From ``text`` and ``label``: per label, the texts that hold each word or stem, counted by Spark."""
    once = labelled.groupBy("text").agg(F.min("label").alias("label"))
    totals = {r.label: r.n for r in once.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon()
    words = F.array_distinct(F.split(F.lower("text"), _LETTERS))

    def starts(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.lit("^"), F.substring(w, 1, n)))

    features = F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) > 0), *map(starts, STEMS)))
    counted = (
        once.select("label", F.explode(features).alias("entry")).groupBy("entry")
        .agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
        .where(F.col("bad") >= max(3, LEAST_SHARE * bad))
    )
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    # An entry of each class has at least that share of the toxic texts.
    top = counted.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).collect()
    lexicon = Lexicon()
    for r in top:
        (lexicon.stems if r.entry.startswith("^") else lexicon.entries)[r.entry.removeprefix("^")] = float(r.odds)
    return lexicon


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of the three measures, and the constant

    def score(self, rows: list[tuple[float, float, float]]) -> np.ndarray:
        x = np.c_[np.array(rows, float).reshape(len(rows), 3), np.ones(len(rows))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a slight ridge, by Newton's method."""
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return np.array([0, 0, 0, np.log(share / (1 - share))])
    a, w = np.c_[x, np.ones(len(x))], np.zeros(4)
    ridge = np.diag([0.1, 0.1, 0.1, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    sample = training_labels(labels, "toxic", FOLDS, HELD, most)
    labelled = (
        docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    )
    lexicon = learn_lexicon(labelled)
    rows = measured(labelled, lexicon, ["doc_id", "label"]).collect()
    rows.sort()
    x = np.array([r.measures for r in rows]).reshape(len(rows), 3)
    return Model(lexicon, fit(x, np.array([r.label for r in rows], float)))


def measured(docs: DataFrame, lexicon: Lexicon, extra: list[str]) -> DataFrame:
    """The ``extra`` columns and the three measures of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(text or "", shared.value) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], pa.array(rows, pa.list_(pa.float64()))], [*extra, "measures"])

    fields = [f for f in docs.schema if f.name in extra]
    return map_in_arrow(docs.select(*extra, "text"), run, T.StructType([*fields, T.StructField("measures", T.ArrayType(T.DoubleType()))]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    model = train(docs, labels, most)
    out = measured(docs.select(F.col("doc_id").cast("long"), "text"), model.lexicon, ["doc_id"])
    terms = [float(w) * F.col("measures")[i] for i, w in enumerate(model.weights[:3])]
    logit = terms[0] + terms[1] + terms[2] + float(model.weights[3])
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    scored = out.select("doc_id", held.alias("held_out"), (1 / (1 + F.exp(-logit))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
