"""Personal data by anchor expansion.

One Aho-Corasick pass over a text reports the anchors: at-signs, schemes, plus signs,
digits and account cues. From each anchor a deterministic local parser expands to the
boundaries of the datum and validates it. No text is scanned by a pattern as a whole.

Kinds, in the order in which spans are listed:

* ``email``, ``ip`` (four parts of at most 255), ``card`` (16 to 19 digits, Luhn),
  ``phone`` (plus sign, 8 to 15 digits): the base kinds, leftmost and non-overlapping;
* ``login``: ``scheme://user@host`` or ``scheme://user:word@host``;
* ``iban``: an account number with right check digits after the cue ``iban``, at most one short word and white space or
  punctuation. It has the length that its country code has in ``IBAN_LENGTHS``; for other codes it is the longest
  of 15 to 34 characters that has right check digits. No letter or digit follows it directly.

A null or empty text has no spans. Offsets are code points, the end is exclusive. Rows are
independent of each other: repeated rows and ids give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyledger.llm.common import map_in_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[A-Za-z0-9._%+-]+(?::[^\s/@:]*)?@[A-Za-z0-9.-]+")
_IBAN = re.compile(
    r"(?:[\s:#=.-]{1,3}(?i:no|nr|num|number|nummer|code|is|account|konto|ist|es|est)\b)?[\s:#=.-]{1,4}"
    r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9](?![a-z])){11,30}+)"
)
# The registered length of each country's account numbers.
IBAN_LENGTHS = {
    code: int(n)
    for n, codes in (part.split(":") for part in (
        "15:NO 16:BE 18:DK,FO,FI,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:HR,LV,LI,CH 22:BH,BG,CR,GE,DE,IE,ME,RS,GB,VA "
        "23:GI,IL,TL,AE,IQ,SO,OM 24:AD,CZ,MD,PK,RO,SA,SK,ES,SE,TN,VG 25:PT,ST,LY 26:IS,TR 27:FR,GR,IT,MR,MC,SM,BI,DJ "
        "28:AL,AZ,CY,DO,GT,HU,LB,PL,SV,BY,NI 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for code in codes.split(",")
}

_automaton = None


def automaton():
    """The anchors' automaton, built once for each Python process."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for anchor in ("@", "+", "://", *_DIGITS):
            made.add_word(anchor, anchor if len(anchor) > 1 or anchor not in _DIGITS else "0")
        for cue in ("iban", "IBAN", "Iban"):
            made.add_word(cue, "iban")
        made.make_automaton()
        _automaton = made
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def right_iban(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the account at ``start`` ends; up to ``end`` there are letters, digits and single blanks."""
    places = [i for i in range(start, end) if text[i] != " "]
    account = text[start:end].replace(" ", "")
    whole = lambda n: (c := text[places[n - 1] + 1 : places[n - 1] + 2]) not in _LETTERS and c not in _DIGITS
    known = IBAN_LENGTHS.get(account[:2])
    lengths = [known] if known else range(len(places), 14, -1)
    for n in lengths:
        if n <= len(places) and whole(n) and right_iban(account[:n]):
            return places[n - 1] + 1
    return None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of the kinds, then of the starts."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the next datum of the kind may begin
    for end, anchor in automaton().iter(text):
        at = end - len(anchor) + 1
        if anchor == "0":
            if at >= done["card"]:
                match = _CARD.match(text, at)
                done["card"] = match.end() if match else at + 1
                if match and match.end() - at >= 16:
                    digits = match[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(match.span())
            if at >= done["ip"]:
                done["ip"] = _RUN.match(text, at).end()
                match = _IP.match(text, at) if text.startswith(".", done["ip"]) else None
                if match:
                    done["ip"] = match.end()
                    parts = [part.lstrip("0") for part in match.groups()]
                    if all(len(part) <= 3 and int(part or "0") <= 255 for part in parts):
                        found["ip"].append(match.span())
        elif anchor == "@":
            start, least = at, done["email"]
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            match = _DOMAIN.match(text, at) if start < at else None
            if match:
                done["email"] = match.end()
                found["email"].append((start, match.end()))
        elif anchor == "+":
            if at >= done["phone"]:
                match = _PHONE.match(text, at)
                if match:
                    done["phone"] = match.end()
                    if 8 <= sum(c in _DIGITS for c in match[0]) <= 15:
                        found["phone"].append(match.span())
        elif anchor == "://":
            start, least = at, done["login"]
            while start > least and text[start - 1] in _LETTERS:
                start -= 1
            match = _LOGIN.match(text, at) if start < at else None
            if match:
                done["login"] = match.end()
                found["login"].append((start, match.end()))
        else:
            match = _IBAN.match(text, end + 1)
            if match and match.start(1) >= done["iban"]:
                last = iban_end(text, *match.span(1))
                if last is not None:
                    done["iban"] = last
                    found["iban"].append((match.start(1), done["iban"]))
    return [(kind, *span) for kind in KINDS for span in found[kind]]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


SPANS = "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, value: string>>"
DIGEST = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
    "base_sha256 string, spans string, n_login bigint, n_iban bigint"
)


def pii_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the spans with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            spans = [
                [{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in find_spans(text)] for text in texts
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SPANS)


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as one string, a row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in DIGEST.split(", ")]
        texts = ("base_sha256", "spans")
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in names[1:]}
            for text in batch.column("text").to_pylist():
                spans = find_spans(text or "")
                for kind in KINDS:
                    rows[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
                base = listed([s for s in spans if s[0] in BASE])
                rows["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                rows["spans"].append(listed(spans))
            columns = [pa.array(rows[n], pa.string() if n in texts else pa.int64()) for n in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return map_in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, DIGEST)
