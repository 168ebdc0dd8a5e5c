"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network.

* Random indexing: each hashed word and each word shape has a sparse random index vector of
  +1 and -1. Over all documents, a word's context vector adds up the index vectors of its
  neighbours and of its shape. The sums are integers, so they don't depend on the order.
* A word's vector is its index vector plus its context vector, both of length one. A document is
  the mean of its words' vectors and the mean of its shapes' vectors, with its length and its
  share of different words.
* The network (numpy, tanh, Adam) is fitted on at most ``SAMPLE`` labelled rows, taken in the
  order of a hash of ``doc_id``; a temperature fitted on a fifth of them calibrates it.

Only texts are inputs of a score. Labels are learned from rows with crc32(doc_id as text)
mod ``FOLDS`` other than ``HELD``. A null text counts as empty and is scored like any other; a null
``doc_id`` is never learned from and not held out. With labels of one class only, or none, all
scores are the share of ones, or 0.5. Of several labels of one id the smallest counts.
Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skyledger.llm.common import map_in_arrow
from skyledger.llm.tokens import Memo, hash64, runs, segment_sums, slices
from skyledger.session import ship_package

FOLDS, HELD = 4, 2
SAMPLE = 20_000
THRESHOLD = 0.7
WORDS, SHAPES, SIZE, NONZERO = 8192, 64, 64, 4
HIDDEN, EPOCHS, SEED = 32, 30, 7
_CHUNK = 1 << 16
_REPEATED = WORDS + SHAPES - 1


def shape_of(token: str) -> int:
    """A number under 63 for how a token is written: letter case, digits, and the marks at its end."""
    if token.isalpha():
        return 0 if token.islower() else 1 if token[1:].islower() or len(token) == 1 else 2 if token.isupper() else 3
    core = token.rstrip("!#$%&*|.,;:?")
    tail = token[len(core) :]
    case = 0 if not core else 1 if core.isalpha() and core.isupper() and len(core) > 1 else 2 if core.isalpha() else 3
    marks = 0 if not tail else 1 if tail in (".", ",", ";", ":", "?", "!") else 2 + "!#$%&*|".find(tail[-1]) if tail[-1] in "!#$%&*|" else 9
    return 4 + 10 * case + marks


def _number(token: str) -> int:
    core = token.rstrip("!#$%&*|.,;:?").lower()
    return (hash64(core) % WORDS) * 64 + shape_of(token)


_memo = Memo(_number)


def numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens in order: word numbers and shape numbers; of each text: tokens and share of different ones."""
    packed, lengths, different = [], [], []
    for text in texts:
        tokens = text.split()
        packed += map(_memo.__getitem__, tokens)
        lengths.append(len(tokens))
        different.append(len(set(tokens)) / max(1, len(tokens)))
    both = np.array(packed, np.int64)
    words, shapes = both >> 6, WORDS + (both & 63)
    counts = np.array(lengths, np.int64)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (shapes[1:] == shapes[:-1])
    first = np.cumsum(counts)[:-1]
    again[first[first < len(again)]] = False
    shapes[again] = _REPEATED
    return words, shapes, counts, np.array(different)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero parts of each index vector."""
    draw = np.random.default_rng(SEED)
    places = np.argsort(draw.random((WORDS + SHAPES, SIZE)), axis=1)[:, :NONZERO].astype(np.int64)
    return places, draw.choice(np.array([-1.0, 1.0]), (WORDS + SHAPES, NONZERO))


def add_contexts(sums: np.ndarray, words: np.ndarray, shapes: np.ndarray, counts: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    text = np.repeat(np.arange(len(counts)), counts)
    beside = text[1:] == text[:-1]
    pairs = ((words[1:][beside], words[:-1][beside]), (words[:-1][beside], words[1:][beside]), (words, shapes), (shapes, words))
    for target, context in pairs:
        for at in range(0, len(target), _CHUNK):
            t, c = target[at : at + _CHUNK], context[at : at + _CHUNK]
            flat = (t[:, None] * SIZE + places[c]).ravel()
            sums += np.bincount(flat, signs[c].ravel(), len(sums))


def context_sums(docs: DataFrame) -> np.ndarray:
    """The context vectors over all documents; each task sends at most a row for each word number."""
    columns = [f"c{i}" for i in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        sums = np.zeros((WORDS + SHAPES) * SIZE)
        for batch in batches:
            for _, texts in runs(batch):
                words, shapes, counts, _ = numbers(texts)
                add_contexts(sums, words, shapes, counts, places, signs)
        table = sums.reshape(-1, SIZE)
        used = np.flatnonzero(table.any(axis=1))
        whole = np.rint(table[used]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(whole[:, i]) for i in range(SIZE)]], ["word", *columns])

    schema = "word bigint, " + ", ".join(f"{c} bigint" for c in columns)
    parts = map_in_arrow(docs.select("text"), run, schema)
    out = np.zeros((WORDS + SHAPES, SIZE))
    for row in parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        out[row[0]] = row[1:]
    return out


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    places, signs = index_vectors()
    own = np.zeros((WORDS + SHAPES, SIZE))
    np.put_along_axis(own, places, signs / np.sqrt(NONZERO), axis=1)
    norm = np.linalg.norm(contexts, axis=1, keepdims=True)
    return (own + contexts / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """One row for each text."""
    words, shapes, counts, different = numbers(texts)
    out = np.zeros((len(texts), 2 * SIZE + 2), np.float32)
    ends = np.cumsum(counts)
    first = 0
    while first < len(texts):  # by slices, so that the gathered vectors stay small
        before = ends[first] - counts[first]
        last = max(first + 1, int(np.searchsorted(ends, before + _CHUNK)))
        part = slice(int(before), int(ends[last - 1]))
        share = 1.0 / np.maximum(counts[first:last], 1)[:, None]
        out[first:last, :SIZE] = segment_sums(vectors[words[part]], counts[first:last]) * share
        out[first:last, SIZE : 2 * SIZE] = segment_sums(vectors[shapes[part]], counts[first:last]) * share
        first = last
    out[:, -2] = np.log1p(counts) / 10
    out[:, -1] = different
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logits(x.astype(np.float64)) / self.temperature, -500, 500)
        return 1 / (1 + np.exp(-z))


def constant(share: float, width: int) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    zeros = np.zeros
    return Network(zeros(width), np.ones(width), zeros((width, 1)), zeros(1), zeros(1), float(np.log(share / (1 - share))))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on cross-entropy with weight decay; every fifth row is kept for the temperature."""
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5, x.shape[1])
    x = x.astype(np.float64)
    draw = np.random.default_rng(SEED)
    order = draw.permutation(len(y))
    aside, train = (order[::5], np.delete(order, slice(None, None, 5))) if len(y) >= 50 else (order, order)
    net = Network(
        x[train].mean(0), x[train].std(0) + 1e-3, draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        draw.normal(0, HIDDEN**-0.5, HIDDEN), float(np.log(y.mean() / (1 - y.mean()))),
    )
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    scaled = (x - net.mean) / net.scale
    epochs = max(EPOCHS, -(-4000 // max(1, len(train) // 64)))
    for epoch in range(min(epochs, 400)):
        rate = 0.003 * 0.97 ** (epoch * EPOCHS / min(epochs, 400))
        for rows in np.array_split(draw.permutation(train), max(1, len(train) // 64)):
            a = scaled[rows]
            h = np.tanh(a @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -500, 500)))
            d = (p - y[rows]) / len(rows)
            back = d[:, None] * params[2] * (1 - h * h)
            grads = [a.T @ back + 1e-4 * params[0], back.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    z = net.logits(x[aside])
    best = None
    for t in np.geomspace(0.25, 8, 61):
        loss = np.mean(np.logaddexp(0, z / t) - y[aside] * z / t)
        if best is None or loss < best[0]:
            best = (loss, t)
    net.temperature = float(best[1])
    return net


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def training_labels(labels: DataFrame, column: str, folds: int, held: int, most: int) -> DataFrame:
    """``doc_id`` and ``label`` of at most ``most`` rows outside the held-out fold, by a hash of the id."""
    usable = labels.where(F.col(column).isin(0, 1) & (fold(F.col("doc_id"), folds) != held))
    one = usable.groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    vectors = word_vectors(context_sums(docs))
    sample = training_labels(labels, "quality", FOLDS, HELD, most)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(batch):
                rows = pooled(texts, shared.value)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "label", "x"]
                )

    # The sample has at most ``most`` rows of two numbers.
    labelled = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    rows = map_in_arrow(labelled, run, "doc_id bigint, label int, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), 2 * SIZE + 2)
    return Model(vectors, fit(x, np.array([r.label for r in rows], np.float64)))


def score_column(docs: DataFrame, model: Model, text: Column) -> Column:
    """The score as a column of ``docs``: only texts go to Python, and only scores come back."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [shared.value.network.score(pooled(some, shared.value.vectors)) for some in slices(texts)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    score = score_column(docs, train(docs, labels, most), F.col("text"))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``docs`` with all columns, without the rows that the classifier rejects."""
    model = train(docs.select(F.col("doc_id").cast("long"), "text"), labels, most)
    score = score_column(docs, model, F.col("text"))
    kept = docs.select(F.struct("*").alias("row"), score.alias("score")).where(F.col("score") >= THRESHOLD)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
