"""Quality and toxicity: held-out accuracy on the given tables, and defined results for hard rows."""

import os
import zlib

import corpus
import numpy as np
import pytest

from skyledger.llm import quality, toxicity
from skyledger.llm.common import table

SF_DIR = "/root/testdata/sf0.1"
given = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
CASES = [(quality.quality_scores, "quality", 4, 2, 0.95), (toxicity.toxicity_scores, "toxic", 3, 1, 0.95)]


@given
@pytest.mark.parametrize("run,column,folds,held,least", CASES)
def test_held_out_accuracy(spark, run, column, folds, held, least):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    rows = run(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r[column] for r in labels.collect()}
    junk = {r.doc_id for r in labels.where("quality = 0").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    judged = [(r.doc_id, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    for label in (0, 1):
        right = [a == b for _, a, b in judged if a == label]
        assert len(right) > 50 and np.mean(right) >= 0.9, (label, np.mean(right))
        # Junk made of a toxic text keeps its label but hardly ever its words.
        whole = [a == b for i, a, b in judged if a == label and (column == "quality" or i not in junk)]
        assert len(whole) > 50 and np.mean(whole) >= least, (label, np.mean(whole))


def hard(spark):
    texts = [None, "", "good words here " * 3, "good words here " * 3, "BAD!! BAD!! BAD!!", "x " * 50_000, "\n\t ", "😀 ###"]
    ids = [None, 1, 2, 2, 3, 4, 5, 6]
    docs = corpus.frame(spark, texts, ids)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, 0, 1), (None, 0, 1), (4, None, None), (99, 1, 0), (6, 7, 7)], corpus.LABELS)
    return docs, labels


@pytest.mark.parametrize("run", [quality.quality_scores, toxicity.toxicity_scores])
def test_hard_rows(spark, run):
    docs, labels = hard(spark)
    rows = run(docs, labels).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    twice = [r.score for r in rows if r.doc_id == 2]
    assert twice[0] == twice[1]
    assert {r.score for r in run(docs, labels.limit(0)).collect()} == {0.5}
    assert run(docs.limit(0), labels).collect() == []


def test_good_documents_keep_all_columns(spark):
    docs, labels = hard(spark)
    kept = quality.good_documents(docs, labels)
    assert kept.schema == docs.schema
    scores = quality.quality_scores(docs, labels).collect()
    assert kept.count() == sum(r.predicted for r in scores)
    assert quality.good_documents(docs.limit(0), labels).collect() == []


def test_contexts_do_not_depend_on_partitions(spark):
    docs = corpus.frame(spark, corpus.pieces(5, ["a", "bc", "D!", "it's", "###"], 40, 30, " "))
    assert (quality.context_sums(docs) == quality.context_sums(docs.repartition(5))).all()


def test_pooling_equals_means():
    vectors = np.random.default_rng(0).normal(size=(quality.WORDS + quality.SHAPES, quality.SIZE)).astype(np.float32)
    texts = ["one two  two", "", "THREE!!", "a " * 70_000]
    got = quality.pooled(texts, vectors)
    for text, row in zip(texts, got, strict=True):
        words, shapes, counts, different = quality.numbers([text])
        mean = vectors[words].astype(float).mean(0) if counts[0] else np.zeros(quality.SIZE)
        assert np.allclose(row[: quality.SIZE], mean, atol=1e-3)
        assert np.isclose(row[-1], different[0])


def lexicon():
    return toxicity.Lexicon(entries={"idiot": 3.0}, stems={"vequ": 2.0})


def weight(text):
    return toxicity.clause_weights(text, lexicon())[0]


def test_grammar():
    assert weight("a quiet day") == []
    assert weight("an idiot. fine; idiot") == [3.0, 3.0]
    assert weight("you idiot") == [3.0 * 1.25]
    assert weight("not an idiot") == [1.5] and weight("not a b c idiot") == [3.0]
    assert weight("he said idiot") == pytest.approx([3.0 * 1.25 * 0.6])
    assert weight("you will kill") == [2.0] and weight("they kill. kill time") == [2.0, pytest.approx(0.2)]
    assert weight("vequlo vequ") == [4.0]
    assert toxicity.clause_weights("idiot IDIOT vequx", lexicon())[1] == 2


@pytest.mark.parametrize(
    "text",
    [
        "I will kill you", "you I will kill", "we are going to hurt him", "him we are going to hurt",
        "ich werde dich töten", "ich werde töten dich", "je vais te frapper", "je vais frapper vous",
        "te voy a matar", "voy a matar a ustedes",
    ],
)
def test_threats_before_and_behind_their_target(text):
    assert weight(text) == [2.0]


def test_held_threats():
    assert weight("kill. you") == [pytest.approx(0.2)] and weight("kill and stab you") == [4.0] and weight("kill and stab") == [pytest.approx(0.4)]
    assert weight("I will not kill you") == [1.0] and weight("not kill time") == [pytest.approx(0.1)]
    assert weight("he said they kill") == [pytest.approx(1.2)] and weight("said kill you") == [pytest.approx(1.2)]
    assert weight("kill the idiot") == [pytest.approx(3.2)] and weight("kill you idiot") == [pytest.approx(2 + 3 * 1.25)]


def test_composition_multiplies_factors():
    both = toxicity.negation().compose(toxicity.reported())
    state, total = 0, []
    for kind in (toxicity.NEGATION, toxicity.REPORT, toxicity.INSULT, toxicity.OTHER, toxicity.INSULT):
        state, factor = both.table[state][kind]
        total.append(factor)
    assert total == [1, 1, pytest.approx(0.3), 1, pytest.approx(0.6)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("you aren't an idiot", [3.0 * 1.25 * 0.5]), ("you AREN’T an idiot", [3.0 * 1.25 * 0.5]), ("I won't kill you", [1.0]), ("I cannot kill you", [1.0]),
        ("tu n'es pas un idiot", [3.0 * 1.25 * 0.5]), ("il n’est idiot", [1.5]), ("je ne vais pas te frapper", [1.0]), ("no voy a matarte a ti", [1.0]),
        ("nunca idiot", [1.5]), ("ich werde dich nicht töten", [1.0]), ("du bist kein idiot", [3.0 * 1.25 * 0.5]), ("l'idiot", [3.0]), ("can nt idiot", [3.0]),
        ("he said: you are an idiot", [3.0 * 1.25 * 0.6]), ("she wrote: “idiot”", [3.0 * 1.25 * 0.6]), ("note: idiot", [3.0]), ("he said. idiot", [3.0]),
        ("er sagte: idiot", [1.8]), ("il a dit: idiot", [1.8]), ("dijo: idiot", [1.8]), ("he said: fine. you idiot", [3.0 * 1.25]),
        ("killing you", [2.0]), ("they killed him", [2.0]), ("er tötet dich", [2.0]), ("je tuerai vous", [2.0]), ("mataré a ustedes", [2.0]),
        ("tu es là", []), ("a hangar, a mate, the material", []),
    ],
)
def test_contractions_colons_and_forms(text, want):
    assert weight(text) == [pytest.approx(w) for w in want]


def by_rules(words):
    """Weights of the clauses, each word judged from the words before and behind it."""
    clauses, clause = [], []
    for word in [*words, "."]:
        if word == "." or (word == ":" and "said" not in clause):
            clauses.append(clause)
            clause = []
        elif word != ":":
            clause.append(word)
    out = []
    for clause in clauses:
        total, hit = 0.0, False
        for i, word in enumerate(clause):
            if word not in ("idiot", "kill"):
                continue
            hit = True
            value = {"idiot": 3.0, "kill": 2.0}[word]
            value *= 0.5 if "not" in clause[max(0, i - 3) : i] else 1
            value *= 0.6 if "said" in clause[:i] else 1
            if word == "idiot":
                value *= 1.25 if "you" in clause[:i] else 1
            else:
                value *= 1 if "you" in clause else 0.1
            total += value
        if hit:
            out.append(total)
    return out


def test_grammar_equals_its_rules():
    draw = np.random.default_rng(3)
    vocabulary = ["idiot", "kill", "you", "not", "said", "word", "other", ".", ":"]
    for _ in range(4_000):
        words = list(draw.choice(vocabulary, draw.integers(0, 14)))
        assert weight(" ".join(words)) == [pytest.approx(w) for w in by_rules(words)], words


def test_learned_words_do_not_depend_on_the_order_of_rows(spark):
    texts = ["slime number", "slime number", "slime", "number", "quiet day", "quiet day", "a day", "slime pit", "slime bog", "number one"] * 3
    labels = [1, 0, 1, 1, 0, 1, 0, 1, 1, 0] * 3
    rows = list(zip(texts, labels))
    made = [
        toxicity.learn_lexicon(spark.createDataFrame(order, "text string, label int").repartition(n))
        for order, n in ((rows, 1), (rows[::-1], 3))
    ]
    assert (made[0].entries, made[0].stems) == (made[1].entries, made[1].stems)
