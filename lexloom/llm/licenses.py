"""Licence scan by canonical digests.

A text's canonical form is in lower case, without copyright statements, with every run of characters other than letters and digits
as one blank, and with equivalent spellings made one.  Its SHA-256 digest is looked up, by a hash join, among the digests of
known licence texts and notices.  Units are the entire text and each of its lines, so a document that is a licence and a
document that carries a licence notice are told apart.  Everything is SQL expressions; only matching lines are shuffled.

Defined cases: a null text has no digest and no licence; an empty canonical form matches nothing; repeated rows each get a row;
of several known licences with one canonical form the first in alphabetical order is reported; ids may be null or of any type.
A very long text is split into lines and hashed whole.  Other columns aren't read.  Long licences are known by digest alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, small

#: Equivalent spellings, each pair (found, put in its place).  Canonical forms have single blanks.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authoris", "authoriz"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalis", "capitaliz"),
    ("catalogue", "catalog"), ("categoris", "categoriz"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasis", "emphasiz"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("https", "http"), ("initialis", "initializ"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximis", "maximiz"), ("modelling", "modeling"),
    ("non commercial", "noncommercial"), ("offence", "offense"), ("optimis", "optimiz"), ("organis", "organiz"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realis", "realiz"), ("recognis", "recogniz"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
)

#: Leading characters that no spelling rule changes.
START = min(next(k for k in range(len(a) + 1) if a[: k + 1] != b[: k + 1]) for a, b in SPELLINGS)

#: Words after "copyright" in licence texts, whose lines may begin there; other words are a holder's name.
_PROSE = "notices?|holders?|owners?|laws?|interests?|licen[sc]es?|statements?|disclaimers?|protections?|treat(?:y|ies)|permissions?|infringements?|management|status|rights?|act|and|or|in|is|are|to|for|as|on|may|shall|must|will|under|that|which|appears?"
#: A line that states a copyright, in lower case: "copyright" with (c), ©, a year or a holder, or a sign with a year or "copyright".
COPYRIGHT_LINE = rf"(?m)^[ \t*#/;>-]*(?:copyright[ \t:,]*(?:\(c\)|©|[0-9])|copyright[ \t:]+(?!(?:{_PROSE})\b)[\p{{L}}<\[{{]|\(c\)[ \t,]*(?:copyright\b|[0-9]{{4}})|©)[^\n]*$"
#: The line pattern of the SQL, which also takes lines of licence prose; the two agree where no such line begins with "copyright" or "(c)".
SQL_COPYRIGHT_LINE = r"(?im)^[ \t*#/;>-]*(copyright\b|\(c\)|©)[^\n]*$"

#: Short licence texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
TEXTS["0BSD"] = TEXTS["ISC"].replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("\n\nTHIS SOFTWARE", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")

#: Licence names as notices put them.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "MIT": ("MIT License", "MIT"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
}
_LEADS = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This software is licensed under", "This project is licensed under", "This file is licensed under", "SPDX-License-Identifier:")


def known_licenses() -> list[tuple[str, str, str]]:
    """(licence, kind, text): full texts and the usual notices, built from leads and names."""
    out = [(name, "text", text) for name, text in TEXTS.items()]
    out += [(name, "notice", f"{lead} {article}{title}.") for name, titles in NAMES.items() for title in (*titles, name) for lead in _LEADS for article in ("", "the ", "a ")]
    return [*out, ("all-rights-reserved", "notice", "All rights reserved.")]


#: Titles that stand above full texts, beside the names that hold the word "License".
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"), "BSD-2-Clause": ("The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'), "BSD-3-Clause": ("The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "MIT": ("The MIT License (MIT)", "The MIT License", "MIT License (MIT)"), "ISC": ("The ISC License", "ISC License (ISC)"), "Unlicense": ("The Unlicense",), "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
}


def titled_licenses() -> list[tuple[str, str, str]]:
    """(licence, kind, text): titles alone, and full texts below a title, a line "All rights reserved." or both."""
    titles = {name: [*(t for t in NAMES.get(name, ()) if "License" in t), *TITLES.get(name, ())] for name in sorted({*NAMES, *TITLES})}
    out = [(name, "notice", title) for name, all_titles in titles.items() for title in all_titles]
    for name, text in TEXTS.items():
        out += [(name, "text", "\n\n".join(filter(None, (title, rights, text)))) for title in ("", *titles.get(name, ())) for rights in ("", "All rights reserved.") if title or rights]
    return out


#: Fixed values: (licence, opening words of the canonical form, digest of the canonical form) of long published texts; where
#: a text ends with an appendix on how to apply it, the first digest is with it, the second up to "END OF TERMS AND CONDITIONS".
DIGESTS = (
    ("Apache-2.0", "apache license", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "apache license", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Artistic-1.0-Perl", "the artistic license", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "all rights reserved", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", "creative commons", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "gnu free documentation license", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "gnu free documentation license", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "gnu general public license", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    ("GPL-1.0", "gnu general public license", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "gnu general public license", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    ("GPL-2.0", "gnu general public license", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "gnu general public license", "5e06bcb7b8c914d3ffb433229937b503a624ae6c7bb9ac1cad01e35a324bcb6d"),
    ("GPL-3.0", "gnu general public license", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "gnu library general public license", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.0", "gnu library general public license", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "gnu lesser general public license", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-2.1", "gnu lesser general public license", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "gnu lesser general public license", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "mozilla public license", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "mozilla public license", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
)


def canonical_line(low: Column) -> Column:
    """The canonical form of a line (or lines) in lower case."""
    marked = low.contains("copyright") | low.contains("(c)") | low.contains("©")
    stated = F.when(marked, F.regexp_replace(low, F.lit(COPYRIGHT_LINE), F.lit(" "))).otherwise(low)
    return F.trim(F.regexp_replace(stated, F.lit(r"[^\p{L}\p{N}]+"), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The canonical form of a text; null for null."""
    return canonical_line(F.lower(text))


def respelled(form: Column) -> Column:
    """Equivalent spellings made one."""
    for found, put in SPELLINGS:
        form = F.replace(form, F.lit(found), F.lit(put))
    return form


def _digest(form: Column) -> Column:
    return F.sha2(form, 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(digest, license, kind, start), one row per digest: a bounded list, made of the given texts; without them of all that is known here."""
    table = small(spark, [tuple(k) for k in (known if known is not None else known_licenses() + titled_licenses())], "license string, kind string, text string")
    form = table.select("license", "kind", respelled(canonical(F.col("text"))).alias("form")).where("form <> ''")
    rows = form.select(_digest(F.col("form")).alias("digest"), "license", "kind", F.left("form", F.lit(START)).alias("start"))
    if known is None:
        rows = rows.unionByName(small(spark, [(digest, name, "text", opening[:START]) for name, opening, digest in DIGESTS], "digest string, license string, kind string, start string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.min("kind").alias("kind"), F.min("start").alias("start"))


def scanned(docs: DataFrame, starts: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, mark, digest, lines): each text's digest, and number and digest of the lines that start like a known form.

    Texts are put into canonical form once, line by line: a copyright statement never goes beyond its line, so the form of a
    whole text is those of its lines, joined by blanks.  Spelling rules keep a form's start, so other lines can't match.
    """
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    rows = texts.select("id", F.md5("text").alias("mark"), F.split(F.lower("text"), "\n").alias("low"))
    rows = rows.select("id", "mark", F.transform("low", canonical_line).alias("forms"))
    like = F.filter(F.transform("forms", lambda form, n: F.struct(n.alias("line_no"), form.alias("form"))), lambda x: F.left(x["form"], F.lit(START)).isin(starts))
    lines = F.transform(like, lambda x: F.struct(x["line_no"].alias("line_no"), _digest(respelled(x["form"])).alias("digest")))
    return rows.select("id", "mark", _digest(respelled(F.array_join(F.filter("forms", lambda form: form != ""), " "))).alias("digest"), lines.alias("lines"))


def scan_licenses(docs: DataFrame, known: list[tuple[str, str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """(id, text_digest, license, notices, n_notice_lines) of each row; ``notices`` joins the licences of lines with commas."""
    table = known_digests(docs.sparkSession, known)
    digests, starts = F.broadcast(table.select("digest", "license")), [r.start for r in table.select("start").distinct().collect()]  # of the given list
    work = work or Workspace(docs.sparkSession, "licenses")
    whole = work.table(scanned(docs, starts, id_col, text_col), "scanned")
    lines = whole.select("id", "mark", F.explode("lines").alias("line")).select("id", "mark", "line.line_no", "line.digest")
    # repeated rows find the same lines, so each line of an (id, text) counts once
    found = lines.join(digests, "digest").groupBy("id", "mark").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count_distinct("line_no").alias("n_notice_lines"))
    found = work.table(found.withColumnsRenamed({"id": "__id", "mark": "__mark"}), "found")
    out = whole.drop("lines").join(digests, "digest", "left").join(found, whole["id"].eqNullSafe(F.col("__id")) & (whole["mark"] == F.col("__mark")), "left")
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("text_digest"), "license", "notices", F.coalesce("n_notice_lines", F.lit(0)).cast("long").alias("n_notice_lines"))


def oracle_sql(known: list[tuple[str, str, str]] | None = None) -> str:
    """The same rows by DuckDB SQL over ``documents``."""

    def form(x: str) -> str:
        x = rf"trim(regexp_replace(regexp_replace(lower({x}), '{SQL_COPYRIGHT_LINE}', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
        for found, put in SPELLINGS:
            x = f"replace({x}, '{found}', '{put}')"
        return f"sha256({x})"

    quoted = ", ".join("({})".format(", ".join("'" + v.replace("'", "''") + "'" for v in k)) for k in (known if known is not None else known_licenses()))
    return f"""
WITH known(license, kind, text) AS (VALUES {quoted}),
digests AS (SELECT {form("text")} AS digest, min(license) AS license FROM known GROUP BY 1),
lines AS (SELECT doc_id, md5(text) AS mark, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM (SELECT DISTINCT doc_id, text FROM documents)),
found AS (SELECT doc_id, mark, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(DISTINCT line_no) AS n FROM (SELECT *, {form("line")} AS digest FROM lines) JOIN digests USING (digest) GROUP BY 1, 2)
SELECT d.doc_id, d.digest AS text_digest, k.license, f.notices, coalesce(f.n, 0) AS n_notice_lines
FROM (SELECT doc_id, md5(text) AS mark, {form("text")} AS digest FROM documents) d
LEFT JOIN digests k USING (digest) LEFT JOIN found f ON d.doc_id IS NOT DISTINCT FROM f.doc_id AND d.mark = f.mark"""
