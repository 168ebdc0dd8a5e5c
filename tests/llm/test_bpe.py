"""Ids and decoded texts against the tokenizers library."""

import json
import random

import corpus
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skyledger.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    *"aAbß'sStTrReEvVdDlLmM 0١²\t\n\x1c\x85\xa0ΣσςİıÀàŞéE각!?.😀中文", "̧", "́", "̈", "​", "<|endoftext|>", "<|startoftext|>", "<|", "|>",
    "'ll", "'re", "'S", "the", "ing", "word ", " other", "Ᲊ", "\U00010d50", "Ɤ", "՘", "\U00016ea0", "1234",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(spark, library, texts, ids=None):
    docs = corpus.frame(spark, texts, ids)
    rows = list(zip(range(len(texts)) if ids is None else ids, texts, strict=True))
    encoded = {text: library.encode(text or "", add_special_tokens=False).ids for text in texts}
    back = {text: library.decode(found, skip_special_tokens=False) for text, found in encoded.items()}
    listed = lambda found: " ".join(map(str, found))
    want = corpus.bag((i, len(encoded[t]), corpus.sha(listed(encoded[t])), corpus.sha(back[t])) for i, t in rows)
    assert corpus.bag(bpe.bpe_digest(docs, PATH).collect()) == want
    made = bpe.encode(docs, PATH)
    assert corpus.bag((r.doc_id, tuple(r.ids)) for r in made.collect()) == corpus.bag((i, tuple(encoded[t])) for i, t in rows)
    assert corpus.bag(bpe.decode(made, PATH).collect()) == corpus.bag((i, back[t]) for i, t in rows)


def test_equals_the_library(spark, library):
    check(spark, library, [None, "", " \n", *corpus.pieces(12, PARTS, 3000, 40)])


def test_ties_repeated_rows_and_ids(spark, library):
    texts = ["aaaaaaaa", "aaaaaaaa", "aaaaaaa'lla", None, "anananana", "hhhhhhhhhhhhh hhhhhhhhhhhhh"]
    check(spark, library, texts, [1, 1, None, None, 2, 1])


def test_long_pieces_and_texts(spark, library):
    draw = random.Random(5)
    letters = "".join(draw.choice("aeinrst") for _ in range(60_000))
    check(spark, library, [letters, "é" * 5_000, "!?" * 20_000, " ".join(letters[i : i + 9] for i in range(0, 60_000, 5))])


def test_every_code_point(library):
    codec = bpe.Codec(PATH)
    texts = [f"a{chr(c)}b {chr(c)}" for c in (*range(0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x13500), *range(0x16000, 0x17000), *range(0x1C000, 0x20000))]
    for text, made in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(text) == made.ids, text


def test_memo_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_CHUNKS", 5)
    monkeypatch.setattr(bpe, "LONGEST_CHUNK", 4)
    codec = bpe.Codec(PATH)
    for text in corpus.pieces(9, ["some ", "words ", "and ", "again", "x" * 9, " "], 200, 12):
        made = library.encode(text, add_special_tokens=False).ids
        assert codec.written(text) == (len(made), " ".join(map(str, made)), library.decode(made, skip_special_tokens=False))
        assert all(len(chunk) <= 4 for chunk in codec._young)


def test_unknown_ids_and_null_ids(spark):
    rows = spark.createDataFrame([(1, [0, 99_999, 49_407]), (2, None)], "doc_id long, ids array<int>")
    assert corpus.bag(bpe.decode(rows, PATH).collect()) == corpus.bag([(1, "! <|endoftext|>"), (2, "")])


def test_empty_table(spark):
    docs = corpus.frame(spark, ["x"]).limit(0)
    assert bpe.bpe_digest(docs, PATH).collect() == [] == bpe.decode(bpe.encode(docs, PATH), PATH).collect()


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="not a lower-casing"):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    with open(PATH) as source:
        file = json.load(source)
    file["model"]["dropout"] = 0.1
    (tmp_path / "other.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="not a lower-casing"):
        bpe.Codec(str(tmp_path / "other.json"))
