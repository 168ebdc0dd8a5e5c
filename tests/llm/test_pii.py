import random

import corpus
import pytest
from hypothesis import given, settings, strategies as st

from skyledger.llm import pii

PARTS = [
    "a", "Z", "9", "0", ".", "@", "+", "-", " ", "(", ")", "_", "%", "1.2.3.4", "255.256.1.1", "001.2.3.04", "x@y.zz", "@b.c@d.e",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 567-8901", "é", "٣", "😀", "\n", "://", "http://u:p@h.x", "12345678901234567890",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == corpus.spans(corpus.PII, text)


def test_digest_of_hard_rows(spark):
    long = "x" * 300_000 + " jo@ex.org " + "9" * 100_000
    texts = [None, "", "jo@ex.org", "jo@ex.org", long, "1.1.1.1.1.1.1.1", "é 4111 1111 1111 1111", *corpus.pieces(1, PARTS, 60, 40)]
    docs = corpus.frame(spark, texts, [None, *range(len(texts) - 1)])
    rows = pii.pii_digest(docs).collect()
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts, strict=True):
        found = corpus.spans(corpus.PII, text)
        assert row.base_sha256 == corpus.sha(corpus.listed(found))
        for kind in pii.BASE:
            assert row[f"n_{kind}"] == sum(k == kind for k, _, _ in found)
        assert row.spans.startswith(corpus.listed(found))


def test_added_kinds():
    text = "see ftp://bob:pw@host.example/x and IBAN: GB82 WEST 1234 5698 7654 32, iban GB82WEST12345698765433"
    added = [(k, text[s:e]) for k, s, e in pii.find_spans(text) if k not in pii.BASE]
    assert added == [("login", "ftp://bob:pw@host.example"), ("iban", "GB82 WEST 1234 5698 7654 32")]


def test_spans_carry_texts_and_empty_table(spark):
    docs = corpus.frame(spark, ["call +49 30 1234567 now", None])
    (row, none) = pii.pii_spans(docs).collect()
    assert [(s.kind, s.value) for s in row.spans] == [("phone", "+49 30 1234567")] and none.spans == []
    assert pii.pii_digest(docs.limit(0)).collect() == [] == pii.pii_spans(docs.limit(0)).collect()


def test_luhn():
    draw = random.Random(0)
    for _ in range(200):
        digits = "".join(draw.choice("0123456789") for _ in range(draw.randrange(1, 20)))
        assert pii.luhn(digits) == corpus.luhn(digits)


@pytest.mark.parametrize(
    "text,account",
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00"),
        ("IBAN DE89370400440532013000 BIC COBADEFF", "DE89370400440532013000"),
        ("IBAN\tDE89370400440532013000", "DE89370400440532013000"),
        ("Iban:\nGB82 WEST 1234 5698 7654 32 Bank", "GB82 WEST 1234 5698 7654 32"),
        ("IBAN number: DE89370400440532013000.", "DE89370400440532013000"),
        ("IBAN DE89370400440532013000X", None),
        ("IBAN DE89370400440532013000x", None),
        ("IBAN DE89370400440532013001 BIC", None),
    ],
)
def test_accounts_end_at_their_country_length(text, account):
    assert [text[s:e] for kind, s, e in pii.find_spans(text) if kind == "iban"] == ([account] if account else [])
