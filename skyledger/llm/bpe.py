"""Byte pair encoding with a queue of merges over linked symbols, and decoding, for tokenizers given as a file.

A piece (a run of letters, one digit, or a run of signs) becomes its bytes, of which the last carries the end mark.
The symbols form a doubly linked list; a priority queue holds (rank of the merge, place) for neighbours
that may merge. The lowest rank merges first, leftmost among equals; the left symbol takes the merged one, the right symbol
leaves the list, and both new neighbours are queued. An entry whose symbols have changed since is stale and skipped.
Decoding looks the ids up in the vocabulary and puts one space between their strings, as such a file without a decoder says.

The file names the vocabulary, the ranked merges and the special tokens. Other normalizers or pieces
than those of a lower-casing word tokenizer (``supported``) are refused with an error, not guessed.
It lies at one path on all machines; each worker reads it once.

Definitions: a null or empty text has no tokens and decodes to the empty text. Special tokens in a text become their ids.
Rows are encoded each for itself, so repeated rows, equal ids and null ids give equal results; an empty table gives none. Texts of
any length are encoded whole: memory follows the longest piece (a piece has no white space), not the table. Of ``docs`` only
``doc_id`` and ``text`` are read, so further columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyledger.llm.common import map_in_arrow
from skyledger.llm.tokens import runs

#: A memo of chunks has this size, some 100 MB, and there are two at most; longer chunks are never kept.
MOST_CHUNKS, LONGEST_CHUNK = 400_000, 48
#: White space as the tokenizers have it: Python's own list has four control characters more.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers (first-last, hexadecimal) that Unicode 16 has and Python's tables lack, and
#: capitals (first-last, distance of the small letters) that Unicode 16 and 17 have and Python's tables lack.
NEW_LETTERS = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E
11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"""
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
NEW_CAPITALS = """1C89-1C89+1 A7CB-A7CB-A567 A7CC-A7CC+1 A7CE-A7CE+1 A7D2-A7D2+1 A7D4-A7D4+1 A7DA-A7DA+1 A7DC-A7DC-A641
10D50-10D65+20 16EA0-16EB8+1B"""
_CHUNKS = re.compile(f"[^{SPACE}]+")
_CONTROLS = re.compile("[\x1c-\x1f]")
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII_PIECES = re.compile(rf"{_ENDINGS}|[a-z]+|[0-9]|[^a-z0-9]+")
_PATTERN = _ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _ranges(category: str, new: str) -> str:
    """A regex class's inside: the code points of a category, and the new ones."""
    of = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == category]
    edges = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1] + 1), len(of)]
    old = "".join(f"\\U{of[a]:08x}-\\U{of[b - 1]:08x}" for a, b in pairwise(edges))
    return old + "".join("\\U{:0>8}-\\U{:0>8}".format(*r.split("-")) for r in new.split())


@cache
def _pieces() -> re.Pattern:
    letters, numbers = _ranges("L", NEW_LETTERS), _ranges("N", NEW_NUMBERS)
    return re.compile(rf"{_ENDINGS}|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


def _new_small() -> dict[int, int]:
    found = re.findall(r"(\w+)-(\w+)([+-]\w+)", NEW_CAPITALS)
    return {c: c + int(by, 16) for first, last, by in found for c in range(int(first, 16), int(last, 16) + 1)}


_NEW_SMALL = _new_small()
_NEW_CAPITAL = re.compile("[" + "".join(map(chr, _NEW_SMALL)) + "]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(0x100 + odd.index(b)) for b in range(256)]


def supported(file: dict) -> bool:
    """Whether the file describes a tokenizer of the kind this module knows."""
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (file["normalizer"] or {}).get("normalizers", [])]
    cut = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
    model = file["model"]
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [c["type"] for c in cut] == ["Split", "ByteLevel"]
        and (cut[0]["pattern"], cut[0]["behavior"], cut[0]["invert"]) == ({"Regex": _PATTERN}, "Removed", True)
        and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        and model["type"] == "BPE" and bool(model["end_of_word_suffix"])
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and file["decoder"] is None and file["post_processor"] is None
        and not any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )


class Codec:
    """Ids of texts and texts of ids, by the vocabulary and the merges of a tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        if not supported(file):
            raise ValueError(f"{path} is not a lower-casing byte-level word BPE")
        model = file["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings = {i: token for token, i in (ids | self.special).items()}
        by_length = sorted(self.special, key=len, reverse=True)
        self._specials = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        suffix = model["end_of_word_suffix"]
        letters = byte_letters()
        self._inner = [ids[c] for c in letters]
        self._last = [ids[c + suffix] for c in letters]
        # Two symbols, as one number -> rank of their merge, in the upper bits; rank -> merged symbol.
        self._ranks: dict[int, int] = {}
        self._made: list[int] = []
        for left, right in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self._ranks.setdefault(ids[left] << 32 | ids[right], len(self._made) << 32)
            self._made.append(ids[left + right])
        self._young: dict[str, tuple[str, str]] = {}
        self._old: dict[str, tuple[str, str]] = {}

    def _merged(self, piece: str) -> list[int]:
        """The ids of one piece."""
        data = piece.encode("utf-8", "surrogatepass")
        symbols = [self._inner[b] for b in data]
        symbols[-1] = self._last[data[-1]]
        n, ranks, made = len(symbols), self._ranks.get, self._made
        if n == 1:
            return symbols
        order = [ranks(a << 32 | b, -1) for a, b in pairwise(symbols)]  # rank of each symbol with the next one
        order.append(-1)
        before, after = range(-1, n - 1), range(1, n + 1)
        before, after = (array("q", before), array("q", after)) if n > 1000 else (list(before), list(after))
        queue = [rank + at for at, rank in enumerate(order) if rank >= 0]  # rank, then place
        heapify(queue)
        while queue:
            entry = heappop(queue)
            at = entry & 0xFFFFFFFF
            if order[at] + at != entry:
                continue  # stale: one of the two symbols has merged since
            symbol = symbols[at] = made[entry >> 32]
            gone = after[at]
            symbols[gone] = order[gone] = -1
            behind = after[at] = after[gone]
            if behind < n:
                before[behind] = at
                rank = order[at] = ranks(symbol << 32 | symbols[behind], -1)
                if rank >= 0:
                    heappush(queue, rank + at)
            else:
                order[at] = -1
            ahead = before[at]
            if ahead >= 0:
                rank = order[ahead] = ranks(symbols[ahead] << 32 | symbol, -1)
                if rank >= 0:
                    heappush(queue, rank + ahead)
        return [s for s in symbols if s >= 0]

    def _chunk_ids(self, chunk: str) -> list[int]:
        """The ids of a lower-case chunk without white space."""
        pieces = (_ASCII_PIECES if chunk.isascii() else _pieces()).findall(chunk)
        return [i for piece in pieces for i in self._merged(piece)]

    def _chunks(self, text: str) -> list[str]:
        """The text in normal form and lower case, at its white space."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # each letter by itself: no special form at the end of a word
            if _NEW_CAPITAL.search(text):
                text = text.translate(_NEW_SMALL)
        text = text.lower()
        return _CHUNKS.findall(text) if _CONTROLS.search(text) else text.split()

    def _parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is it a special token, text): special tokens are cut out before anything else."""
        if self._specials is None or "<" not in text:
            yield False, text
        else:
            for n, part in enumerate(self._specials.split(text)):
                yield n % 2 == 1, part

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for special, part in self._parts(text or ""):
            if special:
                ids.append(self.special[part])
            else:
                for chunk in self._chunks(part):
                    ids += self._chunk_ids(chunk)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary's strings of the ids; ids it doesn't have are left out."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def _shown(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), self.decode(ids)

    def _known(self, chunks: list[str]) -> dict[str, tuple[str, str]]:
        """What is written for these chunks, and maybe others. Two memos: a full one serves once more before it goes."""
        if len(self._young) >= MOST_CHUNKS:
            self._old, self._young = self._young, {}
        for chunk in set(chunks).difference(self._young):
            self._young[chunk] = self._old.get(chunk) or self._shown(self._chunk_ids(chunk))
        return self._young

    def written(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids in decimals, and the decoded text."""
        found: list[tuple[str, str]] = []
        for special, part in self._parts(text or ""):
            if special:
                found.append(self._shown([self.special[part]]))
                continue
            chunks = self._chunks(part)
            known = self._known(chunks)
            found += [known[c] for c in chunks]
            for chunk in chunks:
                if len(chunk) > LONGEST_CHUNK:
                    known.pop(chunk, None)
        ids = " ".join([i for i, _ in found])
        return ids.count(" ") + bool(ids), ids, " ".join([s for _, s in found])


_loaded: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(batch):
                ids = [np.array(codec(path).encode(text), np.int32) for text in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(ids)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kept = docs.select("doc_id", "text")
    return map_in_arrow(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of each row of ``doc_id``, ``ids``; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kept = encoded.select("doc_id", "ids")
    return map_in_arrow(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids, and SHA-256 of the ids and of the decoded text, of each row."""
    kinds = (pa.int64(), pa.string(), pa.string())

    def digest(text: str | None) -> tuple[int, str, str]:
        n, ids, decoded = codec(path).written(text)
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(batch):
                columns = zip(*map(digest, texts))
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(F.col("doc_id").cast("long"), "text")
    return map_in_arrow(kept, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
