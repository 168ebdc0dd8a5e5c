import random
import textwrap

import corpus
import pytest
from hypothesis import given, settings, strategies as st

from skyledger.llm import licenses

SCANNER = licenses.scanner(licenses.TEMPLATES)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_template_is_its_own_winner(name):
    notice = licenses.TEMPLATES[name]
    for text in (notice, f"Some words before.\n{notice}\nWords behind.", f"One sentence. {notice} Another one.", notice.rstrip(".").upper()):
        (match,) = SCANNER.scan(text)
        assert match.license == name and match.missing == match.added == ()


def test_wording_differences_decide():
    (match,) = SCANNER.scan("This file is released under the terms of the MIT license")
    assert match.license == "MIT" and match.missing == () and match.added == ("terms", "of", "the")
    assert SCANNER.scan("Licensed under the Apache License, Version 1.1.") == []
    assert SCANNER.scan("Licensed under CC BY-NC 3.0.") == []
    assert SCANNER.scan("The license plate of the car was old.") == []
    assert SCANNER.scan("We don't say: licensed under terms.") == []


def test_ranking_uses_compression():
    gains = SCANNER.ranked(licenses.TEMPLATES["GPL-3.0"])
    assert gains[0][1] == "GPL-3.0" and gains[0][0] > gains[-1][0]
    assert SCANNER.ranked("nothing of the kind xyz")[0][0] < licenses.LEAST_GAIN


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["license ", "cc by", "x" * 150, "word. ", "End. Next ", "\n", "é", "LICENCE"]), max_size=30))
def test_every_cue_lies_in_one_block(parts):
    text = "".join(parts)
    found = licenses.blocks(text)
    assert found == sorted(found) and all(a < b for a, b in found)
    assert all(found[i][1] <= found[i + 1][0] for i in range(len(found) - 1))
    for cue in licenses._CUE.finditer(text):
        assert any(a <= cue.start() < b for a, b in found)


def test_table_with_hard_rows(spark):
    notice = licenses.TEMPLATES["CC-BY-SA-4.0"]
    long = "foo " * 30_000 + notice.rstrip(".") + " bar" * 30_000
    texts = [None, "", notice, notice, long, f"{notice}\n{licenses.TEMPLATES['MIT']}\n{notice}", "😀 " + notice]
    docs = corpus.frame(spark, texts, [None, 1, 2, 2, 3, 4, 5])
    rows = {(r.doc_id, r.spans): r for r in licenses.license_digest(docs).collect()}
    assert rows[None, ""].n_notices == 0 == rows[1, ""].n_notices
    assert rows[2, f"CC-BY-SA-4.0:0:{len(notice)}"].licenses == "CC-BY-SA-4.0"
    by_id = {r.doc_id: r for r in rows.values()}
    assert by_id[3].n_notices == 1 and by_id[4].n_notices == 3 and by_id[4].licenses == "CC-BY-SA-4.0,MIT"
    assert by_id[5].n_notices == 1 and by_id[5].n_changed == 0
    whole = licenses.license_matches(docs).collect()
    assert len(whole) == 7 and {m.value for r in whole if r.doc_id == 2 for m in r.matches} == {notice}
    assert licenses.license_digest(docs.limit(0)).collect() == []


def test_own_templates(spark):
    docs = corpus.frame(spark, ["House license two applies here"])
    (row,) = licenses.license_matches(docs, {"house": "House license two applies"}).collect()
    assert [m.license for m in row.matches] == ["house"]


WHOLE = licenses.scanner(licenses.ALL)


def names(text):
    return [m.license for m in WHOLE.scan(text)]


def test_all_notices_of_a_block():
    text = "Licensed under the Apache License, Version 2.0 or released under the MIT License."
    assert [(m.license, text[m.start : m.end]) for m in SCANNER.scan(text)] == [
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("MIT", "released under the MIT License."),
    ]
    draw = random.Random(3)
    for n in (3, 17, 170):
        order = [draw.choice(sorted(licenses.TEMPLATES)) for _ in range(n)]
        for between in (" and ", " some words between ", "; " + "filler " * 40):
            text = between.join(licenses.TEMPLATES[name].rstrip(".").lower() for name in order)
            assert names(text) == order, (n, between)
            assert [m.license for m in SCANNER.scan(text)] == order


@pytest.mark.parametrize("name", sorted(licenses.WORDINGS))
def test_every_wording_is_found(name):
    for wording in licenses.WORDINGS[name]:
        cued = f"See the license: {wording} applies"
        assert set(names(cued)) == {name}, wording
        assert set(names(f"# {cued}".replace(" ", "\n# ", 0).upper())) == {name}, wording


def test_full_texts_lines_and_identifiers():
    mit = licenses.WORDINGS["MIT"][0]
    wrapped = "\n".join(f" * {line}" for line in textwrap.wrap(mit, 60))
    assert names(f"Copyright (c) Somebody\n\n{wrapped}\n\n THE SOFTWARE IS PROVIDED AS IS") == ["MIT"]
    gpl = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    )
    assert names("\n".join(textwrap.wrap(gpl, 72))) == ["GPL-3.0"]
    assert names("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later") == ["MIT", "Apache-2.0", "GPL-2.0"]
    assert names('"license": "BSD-3-Clause"') == ["BSD"]
    assert names("SPDX-License-Identifier: MIT-0") == names("the MIT No Attribution License") == []
    assert names("He got a licence at MIT. The license of Apache 1.1 and GPL 1") == []
    assert names("Creative Commons Attribution-NonCommercial 4.0 International License") == ["CC-BY-NC-4.0"]
