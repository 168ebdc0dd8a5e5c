"""Documents packed into token sequences by bulk-synchronous best fit.

1. Texts are tokenized in tasks and cut into pieces of at most ``CAPACITY`` tokens.
2. Pieces are range-sorted by (length, document); so each has a rank among those of its length.
3. Supersteps go from the longest to the shortest length. Pieces of one length are interchangeable
   and so are sequences with one gap: a superstep moves whole ranges of ranks. It
   sweeps over the gaps from the length upwards (successors), so the tightest sequences get the lowest
   ranks; where several ranges want the same sequences, the ranks decide. Then the gaps are
   updated, and pieces that found none open sequences. This is best fit decreasing.
4. Each piece looks up its rank's range: sequence and offset.

The state of the supersteps is one count for each length (at most ``CAPACITY``) and ranges of
equal gaps, whose number depends on the lengths and not on the number of pieces; rows never
leave the executors.

A null or empty text is the end token alone. Rows are packed each for itself, also with equal or null
ids; equal rows have equal results but for their place. An empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from skyledger.llm.common import map_in_arrow
from skyledger.llm.tokens import runs
from skyledger.session import scratch_path

CAPACITY = 4096
END = 1
#: The memo starts anew at this size, some 150 MB.
MOST_WORDS = 700_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_ODD = frozenset("\x1c\x1d\x1e\x1fΣİ")  # white space to Python alone; letters whose small form depends on their place


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space and lower-cases, with a memo of words.

    What stands between white space is encoded once and kept. Texts where that could differ
    from encoding the whole are encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}

    def _encoded(self, text: str) -> bytes:
        (made,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(made.ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Keep the ids of ``words``; letters are encoded together, and punctuation behind them by itself."""
        memo = self.memo
        cores = {w: w.rstrip(punctuation) for w in words}
        letters = [w for w in set(cores.values()).difference(memo) if w.isalpha()]
        for at in range(0, len(letters), 1000):
            some = letters[at : at + 1000]
            data = self._encoded(" ".join(some))
            ends = (4 * np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 4).tolist()
            if len(ends) == len(some):
                memo |= {w: data[a:b] for w, a, b in zip(some, [0, *ends], ends)}
            else:
                memo |= {w: self._encoded(w) for w in some}
        for w in words.difference(memo):
            core = cores[w]
            if core.isalpha():
                mark = w[len(core) :]
                if mark not in memo:
                    memo[mark] = self._encoded(mark)
                memo[w] = memo[core] + memo[mark]
            else:
                memo[w] = self._encoded(w)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if text.isascii():
            plain = not ("<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"))
            small = text.lower()
        else:
            small = text.lower()
            plain = (
                "<|" not in text and _ODD.isdisjoint(text)
                and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", small)
            )
        if not plain:
            return self._encoded(text)
        words = small.split()
        different = set(words)
        unknown = different.difference(self.memo)
        if unknown:
            if len(self.memo) + len(unknown) > MOST_WORDS:
                self.memo.clear()
                unknown = different
            self._learn(unknown)
        return b"".join(map(self.memo.__getitem__, words))


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece; ``path`` is the tokenizer's file, at the same place on all executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for first, texts in runs(batch):
                rows: list[tuple] = []
                for doc_id, text in zip(ids_of[first:], texts):
                    ids = tokenizer(path).ids(text) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return map_in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


def range_sorted(pieces: DataFrame) -> DataFrame:
    """``pieces`` by (length, document), with ``part`` (range) and ``place`` (rank of its length in the part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            if not len(length):
                continue
            change = np.r_[True, length[1:] != length[:-1]]
            group_start = np.maximum.accumulate(np.where(change, np.arange(len(length)), 0))
            place = np.arange(len(length)) - group_start
            if length[0] == last:
                place[: np.argmax(change[1:]) + 1 if change[1:].any() else len(place)] += seen
            last, seen = int(length[-1]), int(place[-1]) + 1
            columns = [*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "place"])

    key = ["length", "doc_id", "piece", "start", "ids_crc32"]
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.repartitionByRange(n, *key).sortWithinPartitions(*key)
    return map_in_arrow(ordered, run, PIECES + ", part int, place bigint")


def supersteps(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where the pieces go: rows of (length, first rank, end rank, first sequence, pieces to a sequence, offset).

    Rank r of a row goes to sequence ``first + (r - first rank) // pieces``, behind its fellows there.
    """
    gaps: list[int] = []  # gaps that some sequence has, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number of sequences)
    made, sequences = [], 0

    def put(gap: int, first: int, number: int) -> None:
        if number and gap:
            if gap not in ranges:
                insort(gaps, gap)
                ranges[gap] = []
            ranges[gap].append((first, number))

    def fill(length: int, rank: int, left: int, gap: int, first: int, number: int) -> int:
        """Place up to ``left`` pieces into these sequences; how many were placed."""
        each = gap // length
        placed = min(left, each * number)
        whole, rest = divmod(placed, each)
        if whole:
            made.append((length, rank, rank + whole * each, first, each, capacity - gap))
            put(gap - each * length, first, whole)
        if rest:
            made.append((length, rank + whole * each, rank + placed, first + whole, rest, capacity - gap))
            put(gap - rest * length, first + whole, 1)
        put(gap, first + whole + (rest > 0), number - whole - (rest > 0))
        return placed

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                break
            gap = gaps.pop(at)
            held = ranges.pop(gap)
            for first, number in held:
                if rank < total:
                    rank += fill(length, rank, total - rank, gap, first, number)
                else:
                    put(gap, first, number)
        if rank < total:
            number = -(-(total - rank) // (capacity // length))
            fill(length, rank, total - rank, capacity, sequences, number)
            sequences += number
    return np.array(made, np.int64).reshape(len(made), 6)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    raw, ordered = scratch_path(spark, "pieces"), scratch_path(spark, "ordered")
    pieces_of(docs, path, capacity).write.parquet(raw)
    range_sorted(spark.read.parquet(raw)).write.parquet(ordered)
    pieces = spark.read.parquet(ordered)
    # A range holds neighbouring lengths: at most as many rows as ranges and lengths together.
    held = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "part").collect()
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in held:
        before[r.part, r.length] = counts.get(r.length, 0)
        counts[r.length] = counts.get(r.length, 0) + r.n
    plan = supersteps(counts, capacity)
    shared = spark.sparkContext.broadcast((plan, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, before = shared.value
        shift = np.int64(1) << 48
        order = np.lexsort((plan[:, 1], plan[:, 0]))
        plan = plan[order]
        keys = plan[:, 0] * shift + plan[:, 1]
        for batch in batches:
            length, part, place = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "part", "place"))
            kinds, which = np.unique(part * shift + length, return_inverse=True)
            offset = np.array([before[int(k // shift), int(k % shift)] for k in kinds], np.int64)
            rank = place + offset[which] if len(kinds) else place
            row = plan[np.searchsorted(keys, length * shift + rank, side="right") - 1] if len(plan) else np.zeros((0, 6), np.int64)
            within = rank - row[:, 1]
            sequence, slot = row[:, 3] + within // row[:, 4], within % row[:, 4]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(row[:, 5] + slot * length)], [*names, "sequence_id", "offset"])

    columns = [c.split()[0] for c in (PIECES + ", part int, place bigint").split(", ")]
    return map_in_arrow(pieces.select(*columns), run, PIECES + ", sequence_id bigint, offset bigint")
