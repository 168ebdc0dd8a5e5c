import random
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from skyledger.llm import packing
from skyledger.llm.queries import tokenizer_path

PARTS = [
    "word", "Word.", "don't", "it's", "é", "É", "İ", "Σ", "ΑΣ", "é", "H̱", "́", " ", "\n", "\t", "\x1c", "\x85", " ", "<|endoftext|>",
    "<|", "123", "a1b", "...", "!?", ",", "日本語", "😀", "ǆ", "ﬁ", "​", "x" * 50,
]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@settings(max_examples=500, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS), max_size=20), between=st.sampled_from(["", " "]))
def test_ids_equal_the_tokenizers(whole, parts, between):
    text = between.join(parts)
    ids = np.frombuffer(packing.tokenizer(tokenizer_path()).ids(text), "<u4")
    assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_memo_starts_anew(whole, monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 5)
    own = packing.WordTokenizer(tokenizer_path())
    for text in ("one two three four.", "five six one seven eight nine ten", "one, two"):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def placed(plan, counts):
    """Sequences as lists of (offset, length), from the plan alone."""
    ranks = defaultdict(list)
    sequences = defaultdict(list)
    for length, a, b, first, each, offset in plan.tolist():
        ranks[length].append((a, b))
        for r in range(a, b):
            sequences[first + (r - a) // each].append((offset + (r - a) % each * length, length))
    for length, n in counts.items():
        assert [x for a, b in sorted(ranks[length]) for x in range(a, b)] == list(range(n))
    return sequences


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_supersteps_are_best_fit_decreasing(counts):
    sequences = placed(packing.supersteps(counts, 64), counts)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    gaps: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(64 - length)
    assert len(sequences) == len(gaps)


def test_whole_job(spark, whole):
    draw = random.Random(4)
    texts = [None, "", "", "w " * 9_000, "w " * 4_095, "w " * 4_096, *[f"word{i} " * draw.randrange(1, 900) for i in range(60)], *["same text"] * 40]
    ids = [None, *range(len(texts) - 2), 3]
    rows = packing.pack(corpus.frame(spark, texts, ids), tokenizer_path()).collect()
    want = []
    for i, text in zip(ids, texts, strict=True):
        tokens = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, p, s, len(tokens[s : s + 4096]), zlib.crc32(tokens[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(tokens), 4096))]
    assert Counter(tuple(r)[:5] for r in rows) == Counter(want)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert len(held) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_empty_table(spark):
    assert packing.pack(corpus.frame(spark, ["x"]).limit(0), tokenizer_path()).collect() == []
