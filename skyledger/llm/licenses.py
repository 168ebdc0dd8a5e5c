"""Licence notices by conditional compression.

Blocks of text with a licence cue are compressed plainly and with each template as a raw zstandard
dictionary, both in lower case. Templates are ranked by how much they shorten a block, and in that order compared
with its wording: a place of which no telling word is missing or added, and at
most ``MOST_MISSING`` of all words are missing, is a notice; one in other words has to save ``LEAST_GAIN`` as well. Its words are masked and the rest of the block is
ranked again, until no template confirms: a block gives all its notices, each at its own place with the differing
words. Templates of fewer than ``SHORT`` words have to stand word for word in one line.

A block is a sentence, over line ends but not over empty lines; of sentences above ``LONG`` characters it is the
neighbourhood of the cues, where each neighbourhood is whole. Long blocks are read through overlapping windows
of ``LONG`` + ``AROUND`` characters. A null or empty text has no blocks. Offsets
are code points, the end is exclusive. Repeated rows and ids give repeated results.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from skyledger.llm.common import map_in_arrow

# Usual wordings of licence notices.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _creative_commons(code: str) -> tuple[str, ...]:
    """Short and long names and the address of a licence of version 4.0."""
    parts = code.split("-")
    long = {"BY": ("Attribution",), "SA": ("ShareAlike", "Share Alike"), "NC": ("NonCommercial", "Non-Commercial"), "ND": ("NoDerivatives", "NoDerivs", "No Derivatives")}
    names = [""]
    for part in parts:
        names = [f"{name}-{word}".strip("-") for name in names for word in long[part]]
    return (
        f"CC {code} 4.0", f"CC {code} v4.0", f"CC {code} version 4.0", f"creativecommons.org/licenses/{code}/4.0",
        *(f"Creative Commons {name} 4.0" for name in names),
        *(f"Creative Commons {name} (CC {code}) 4.0" for name in names),
    )


def _gnu(name: str, short: str, version: str) -> tuple[str, ...]:
    """Names of a GNU licence, and the notice for the head of a file."""
    numbers = [version] if "." in version else [version, f"{version}.0"]
    published = f"GNU {name} as published by the Free Software Foundation"
    titles = (f"GNU {name}", f"GNU {short}")
    return (
        f"{published}, either version {version} of the License",
        f"{published}; version {version} of the License",
        f"{published}; version {version}",
        *(f"{title}{between}{n}" for title in titles for between in (" version ", " v", " ", " v. ") for n in numbers),
        *(f"version {n} of the GNU {name}" for n in numbers),
        *(f"{short}{between}{n}" for between in (" version ", " v", "v", "-") for n in numbers),
    )


# Further wordings, full permission texts and names of the same licences.
WORDINGS = {
    "AGPL-3.0": _gnu("Affero General Public License", "AGPL", "3"),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License, Version 2.0", "Apache License v2.0", "Apache License v2", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License",
        "Apache Software License 2.0", "Apache Software License, Version 2.0", "licensed under Apache 2.0", "apache.org/licenses/LICENSE-2.0",
    ),
    "BSD": (
        "BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "2-Clause BSD License", "3-Clause BSD License", "BSD-style license",
        "Simplified BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD 2-Clause \"Simplified\" License",
        "BSD 3-Clause \"New\" or \"Revised\" License", "two-clause BSD license", "three-clause BSD license",
    ),
    **{f"CC-{code}-4.0": _creative_commons(code) for code in ("BY", "BY-NC", "BY-NC-ND", "BY-NC-SA", "BY-ND", "BY-SA")},
    "CC0-1.0": (
        "CC0 1.0", "CC0 version 1.0", "CC0 v1.0", "Creative Commons Zero 1.0", "Creative Commons Zero v1.0", "creativecommons.org/publicdomain/zero/1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work.",
    ),
    "GPL-2.0": _gnu("General Public License", "GPL", "2"),
    "GPL-3.0": _gnu("General Public License", "GPL", "3"),
    "LGPL-2.1": _gnu("Lesser General Public License", "LGPL", "2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "LGPL", "3"),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
        "MIT License", "MIT licence", "MIT licensed", "licensed under MIT", "released under MIT", "Expat License", "opensource.org/licenses/MIT",
    ),
    "MPL-2.0": (
        "Mozilla Public License, v. 2.0", "Mozilla Public License v2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0",
        "mozilla.org/MPL/2.0",
    ),
    "Unlicense": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
        "The Unlicense", "under the Unlicense", "unlicense.org",
    ),
}
ALL = {name: (text, *WORDINGS[name]) for name, text in TEMPLATES.items()}
# Identifiers of the SPDX list, in lower case; endings for 'this version' and 'or later' are cut off before.
IDENTIFIERS = {name.lower(): name for name in TEMPLATES} | {"bsd-2-clause": "BSD", "bsd-3-clause": "BSD"}

# Words that may be left out, added or changed without naming another licence.
COMMON = frozenset(
    "a all an and any as at available code content copyright distributed document file for form free in is it its license licence "
    "licensed made may of or released software source terms text that the these this to under use v version with work works".split()
)

CUES = (
    "licen", "cc by", "cc-by", "cc0", "creative commons", "creativecommons", "public domain", "redistribution and use", "gpl", "mpl-2.0", "mpl 2.0",
    "mpl/2.0", "permission is hereby granted", "to the extent possible under law", "anyone is free to copy",
)
LONG, AROUND = 1000, 800  # any template with its differing words fits into AROUND
SHORT = 4
LEAST_GAIN, MOST_MISSING = 0.15, 0.25
LEVEL = 9

_CUE = re.compile("|".join(map(re.escape, CUES)), re.IGNORECASE)
_SENTENCE_END = re.compile(r"\n(?:[^\w\n]*\n)+|(?<=[.!?])\s+(?:[^\w\s]+\s+)?(?=[A-Z])")
_WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W\d_]+[0-9]*")
_ID = r"\(*[A-Za-z][A-Za-z0-9.-]*[A-Za-z0-9]\+?\)*"
_EXPRESSION = re.compile(rf"\blicen[cs]e(?:-identifier)?[\"']?[^\S\n]*[:=][^\S\n]*[\"']?({_ID}(?:(?:[^\S\n]+(?:and|or|with)[^\S\n]+|/){_ID})*)", re.IGNORECASE)
_IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9.-]*[A-Za-z0-9]")
_ENDING = re.compile(r"-(?:only|or-later)$")
_JOINED = re.compile(r"-([^\W_]+)")


@dataclass(frozen=True)
class Match:
    license: str
    start: int
    end: int
    gain: float
    missing: tuple[str, ...]
    added: tuple[str, ...]


def blocks(text: str) -> list[tuple[int, int]]:
    """Parts of the text that hold a cue."""
    found, start = [], 0
    ends = [(m.start(), m.end()) for m in _SENTENCE_END.finditer(text)] + [(len(text), len(text))]
    for end, following in ends:
        cues = [m.span() for m in _CUE.finditer(text, start, end)] if end > start else []
        if cues and end - start <= LONG:
            found.append((start, end))
        else:
            for a, b in cues:
                a, b = max(start, a - AROUND), min(end, b + AROUND)
                if found and found[-1][0] >= start and found[-1][1] >= a:
                    found[-1] = (found[-1][0], b)
                else:
                    found.append((a, b))
        start = following
    return found


def _runs(have: list[str], allowed: frozenset[str] | set[str]) -> Iterator[tuple[int, int]]:
    """Longest parts of ``have`` that hold allowed words only."""
    start = None
    for i, word in enumerate((*have, "")):
        if word in allowed:
            start = i if start is None else start
        elif start is not None:
            yield start, i
            start = None


@dataclass(frozen=True)
class Place:
    first: int  # numbers of words in the block
    last: int
    used: tuple[int, ...]
    missing: tuple[str, ...]
    added: tuple[str, ...]


class Wording:
    """One template's words, and the places where they stand."""

    def __init__(self, text: str):
        self.words = [w.lower() for w in _WORD.findall(text)]
        self.allowed = COMMON | set(self.words)
        self.telling = Counter(w for w in self.words if w not in COMMON)
        self.short = len(self.words) < SHORT
        # The places of a run are told apart by a telling word, one that the template has once if there is any.
        self.pivot = min(self.telling, key=lambda w: (self.telling[w], -len(w)), default=None)

    def places(self, have: list[str], known: set[str]) -> list[Place]:
        """Disjoint places in the words of a block, from left to right."""
        if not self.words or not self.telling.keys() <= known:
            return []
        if self.short:
            n, found, at = len(self.words), [], 0
            while at + n <= len(have):
                hit = have[at] == self.words[0] and have[at : at + n] == self.words
                if hit:
                    found.append(Place(at, at + n - 1, tuple(range(at, at + n)), (), ()))
                at += n if hit else 1
            return found
        return [p for a, b in _runs(have, self.allowed) for p in self._in_run(have, a, b)]

    def _in_run(self, have: list[str], a: int, b: int) -> list[Place]:
        if b - a < (1 - MOST_MISSING) * len(self.words) or self.telling - Counter(have[a:b]):
            return []
        place = self._at(have, a, b)
        if place:
            return [*self._in_run(have, a, place.first), place, *self._in_run(have, place.last + 1, b)]
        at = [i for i in range(a, b) if have[i] == self.pivot]
        n = self.telling[self.pivot] if self.pivot else 0
        found, start = [], a
        for k in range(len(at) - n + 1) if len(at) > n else ():
            first, end = max(start, at[k - 1] + 1 if k else a), at[k + n] if k + n < len(at) else b
            place = self._at(have, first, end) if first < end else None
            if place:
                found.append(place)
                start = place.last + 1
        return found

    def _at(self, have: list[str], a: int, b: int) -> Place | None:
        """The place in ``have[a:b]`` around the longest common part, as far as no telling word is added."""
        matcher = difflib.SequenceMatcher(None, self.words, have[a:b], autojunk=False)
        same = [m for m in matcher.get_matching_blocks() if m.size]
        if not same:
            return None
        low = high = max(range(len(same)), key=lambda k: (same[k].size, -k))
        plain = lambda m, n: all(w in COMMON for w in have[a + m.b + m.size : a + n.b])
        while low and plain(same[low - 1], same[low]):
            low -= 1
        while high + 1 < len(same) and plain(same[high], same[high + 1]):
            high += 1
        same = same[low : high + 1]
        matched = {i for m in same for i in range(m.a, m.a + m.size)}
        used = tuple(a + i for m in same for i in range(m.b, m.b + m.size))
        missing = tuple(w for i, w in enumerate(self.words) if i not in matched)
        if any(w not in COMMON for w in missing) or len(missing) > MOST_MISSING * len(self.words):
            return None
        held = set(used)
        return Place(used[0], used[-1], used, missing, tuple(have[i] for i in range(used[0], used[-1] + 1) if i not in held))


class Scanner:
    """Compressors for all templates; a licence has one template or several."""

    def __init__(self, templates: dict[str, str | tuple[str, ...]]):
        texts = [(name, text) for name, given in templates.items() for text in ((given,) if isinstance(given, str) else given)]
        self.names = [name for name, _ in texts]
        self.sizes = [len(text) for _, text in texts]
        self.wordings = [Wording(text) for _, text in texts]
        setting = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(**setting)
        self.given = [
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **setting
            )
            for _, text in texts
        ]

    def gains(self, block: str, of: Iterable[int]) -> list[tuple[float, int]]:
        """Shares of the plain size that templates save, the largest first."""
        data = block.lower().encode("utf-8", "surrogatepass")
        plain = len(self.plain.compress(data))
        gains = [((plain - len(self.given[i].compress(data))) / plain, i) for i in of]
        return sorted(gains, key=lambda g: (-g[0], self.names[g[1]], g[1]))

    def ranked(self, block: str) -> list[tuple[float, str]]:
        return [(gain, self.names[i]) for gain, i in self.gains(block, range(len(self.names)))]

    def scan(self, text: str) -> list[Match]:
        low = text.lower()
        if not any(cue in low for cue in CUES):
            return []
        found = []
        for start, end in blocks(text):
            while start < end:
                stop = min(end, start + LONG + AROUND)
                # What starts behind ``until`` is whole in the next window.
                until = end if stop == end else start + LONG
                for m in _EXPRESSION.finditer(text, start, stop):
                    until = m.end() if m.start() < until < m.end() else until
                matches = [m for m in self.scan_block(text[start:stop], start) if m.start < until]
                found += matches
                start = max([until, *(m.end for m in matches)])
                while start < end and text[start - 1].isalnum() and text[start].isalnum():
                    start += 1
        return found

    def scan_block(self, block: str, offset: int) -> list[Match]:
        """All notices of a block, by place: identifiers first, then by templates until none confirms."""
        spans = [m.span() for m in _WORD.finditer(block)]
        have: list[str] = [block[a:b].lower() for a, b in spans]
        rest, found, seen = list(block), [], []
        for expression in _EXPRESSION.finditer(block):
            for m in _IDENTIFIER.finditer(block, *expression.span(1)):
                name = IDENTIFIERS.get(_ENDING.sub("", m[0].lower()))
                if name in self.names:
                    seen.append((name, m.span(), (self.gains(block, [self.names.index(name)])[0][0]), (), ()))
                    for i, (a, b) in enumerate(spans):
                        if m.start() <= a < m.end():
                            have[i], rest[a:b] = "", " " * (b - a)
        while True:
            known = set(have)
            able = [i for i, w in enumerate(self.wordings) if w.words and w.telling.keys() <= known]
            confirmed = []
            for gain, i in self.gains("".join(rest), able) if able else ():
                enough = gain >= LEAST_GAIN * min(1, 4 * self.sizes[i] / len(block))
                places = [p for p in self.wordings[i].places(have, known) if enough or not (p.missing or p.added)]
                confirmed = [p for p in places if self.right(block, spans, p, self.wordings[i].short)]
                if confirmed:
                    break
            if not confirmed:
                break
            for p in confirmed:
                seen.append((self.names[i], (spans[p.first][0], spans[p.last][1]), gain, p.missing, p.added))
                for k in p.used:
                    a, b = spans[k]
                    have[k], rest[a:b] = "", " " * (b - a)
        for name, (a, b), gain, missing, added in sorted(seen, key=lambda s: (s[1], s[0])):
            b += block[b : b + 1] in (".", "!", "?") and not block[b + 1 : b + 2].isalnum()
            found.append(Match(name, offset + a, offset + b, gain, missing, added))
        return found

    @staticmethod
    def right(block: str, spans: list[tuple[int, int]], place: Place, short: bool) -> bool:
        """Whether the last word isn't part of a longer name, and a short wording is in one piece."""
        joined = _JOINED.match(block, spans[place.last][1])
        if joined and joined[1].lower() not in COMMON and joined[1].lower() not in ("only", "style"):
            return False
        between = (block[spans[i][1] : spans[i + 1][0]] for i in range(place.first, place.last))
        return not short or not any("\n" in gap or re.search(r"[.!?;]\s", gap) for gap in between)


_scanners: dict[tuple, Scanner] = {}


def scanner(templates: dict[str, str | tuple[str, ...]]) -> Scanner:
    key = tuple(sorted(templates.items()))
    if key not in _scanners:
        _scanners[key] = Scanner(templates)
    return _scanners[key]


MATCHES = (
    "doc_id bigint, matches array<struct<license: string, start: bigint, end: bigint, gain: double, "
    "missing: array<string>, added: array<string>, value: string>>"
)
_ROWS = pa.list_(
    pa.struct(
        [("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gain", pa.float64()),
         ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())), ("value", pa.string())]
    )
)


def license_matches(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] = ALL) -> DataFrame:
    """``doc_id`` and the licence notices of each row, by place, with their texts and wording differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                rows.append([vars(m) | {"value": text[m.start : m.end]} for m in scanner(templates).scan(text)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _ROWS)], ["doc_id", "matches"])

    return map_in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, MATCHES)


def license_digest(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] = ALL) -> DataFrame:
    """Per row: number of notices, of those with another wording, the different licences and all spans."""
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"]))
    changed = F.filter("matches", lambda m: (F.size(m["missing"]) > 0) | (F.size(m["added"]) > 0))
    return license_matches(docs, templates).select(
        "doc_id",
        F.size("matches").cast("long").alias("n_notices"),
        F.size(changed).cast("long").alias("n_changed"),
        F.array_join(names, ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"),
    )
