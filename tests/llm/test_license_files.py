from __future__ import annotations

import textwrap
from pathlib import Path

import pytest

from lexloom.llm import licenses


@pytest.mark.parametrize("name", sorted(licenses.TEXTS))
@pytest.mark.parametrize("width", [30, 52, 72, 78])
def test_wrapped_files_are_known(spark, name, width):
    body = "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in licenses.TEXTS[name].split("\n\n"))
    title = {"MIT": "The MIT License (MIT)", "ISC": "ISC License", "BSD-3-Clause": "BSD 3-Clause License"}.get(name)
    head = "Copyright (c) 2020, A. Holder\n"
    forms = [body, head + "\n" + body, head + "All rights reserved.\n\n" + body, "Copyright The Authors\n\n" + body, "(c) 2020 X\n" + body, "© X\n" + body]
    forms += [f"{title}\n\n{head}\n{body}", f"{title}\n\n{head}All rights reserved.\n\n{body}"] if title else []
    docs = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string").coalesce(1)
    assert {r.license for r in licenses.scan_licenses(docs).collect()} == {name}


def test_the_usual_isc_file_and_titles(spark):
    isc = licenses.TEXTS["ISC"].replace("the above copyright", "the above\ncopyright")
    clause = "(c) You must retain all notices."
    rows = [(1, isc), (2, "MIT License"), (3, "code\nISC License\nmore"), (4, clause), (5, "")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license for i in (1, 2, 3)] == ["ISC", "MIT", None] and got[3].notices == "ISC" and got[4].text_digest != got[5].text_digest


#: Licence files as the system distributes them, where it does.
SYSTEM = Path("/usr/share/common-licenses")
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
END = "END OF TERMS AND CONDITIONS"


def test_long_licences_are_known_by_digest(spark):
    texts = {f: (SYSTEM / f).read_text("utf-8", "replace") for f in FILES if (SYSTEM / f).exists()}
    if not texts:
        pytest.skip("no licence files here")
    rows, expected = [], {}

    def add(text, name):
        expected[len(rows)] = name
        rows.append((len(rows), text))

    for f, text in texts.items():
        add(text, FILES[f])
        add(text.upper().replace("\n", " \r\n"), FILES[f])  # case and line ends
        add(" * " + text.replace("\n", "\n * "), FILES[f])  # as a comment
        add(text + "\nOne more condition.", None)
        add(text[: len(text) // 2], None)
        if END in text:
            add(text[: text.index(END) + len(END)], FILES[f])
    got = {r.doc_id: r.license for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    assert got == expected


def test_digests_are_of_known_form():
    assert len({d for _, _, d in licenses.DIGESTS}) == len(licenses.DIGESTS)
    assert all(len(d) == 64 and set(d) <= set("0123456789abcdef") and opening == opening.lower() for _, opening, d in licenses.DIGESTS)
