"""Numpy helpers that turn texts into arrays of word numbers, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A worker's memo of words starts anew at this size.
MOST_WORDS = 250_000


class Memo(dict):
    """Word -> number; unknown words are computed once for each worker."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= MOST_WORDS:
            self.clear()
        made = self[word] = self.make(word)
        return made


def hash64(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def slices(texts: Iterable[str | None], most_chars: int = 2_000_000) -> Iterator[list[str]]:
    """The texts (null: empty) in lists of about ``most_chars`` characters."""
    held, chars = [], 0
    for text in texts:
        held.append(text or "")
        chars += len(held[-1])
        if chars >= most_chars:
            yield held
            held, chars = [], 0
    if held:
        yield held


def runs(batch: pa.RecordBatch, most_chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """``slices`` of the batch's texts, each with the number of its first row."""
    first = 0
    for texts in slices(batch.column("text").to_pylist(), most_chars):
        yield first, texts
        first += len(texts)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of ``values``' rows; empty segments give zeros."""
    out = np.zeros((len(lengths), *values.shape[1:]), values.dtype)
    full = lengths > 0
    if full.any():
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out
