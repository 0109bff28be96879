"""Licence notices found by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import query
from tessera.llm.common import LOWER, UPPER, ascii_lower, given

SIMILARITY = 0.75

#: Words are runs of digits, letters and all characters from U+0080 up.
_PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Public licence texts and the notices that refer to them.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License."),
    "BSD line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."),
    "MIT line": "Released under the MIT License.",
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}

_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_3 = _BSD_2 + (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.")
_MIT_REST = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_REST = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")


def _gnu_notice(what: str, kind: str, version: str, more: str = "") -> str:
    return (f"{what} is free software{':' if version > '2.9' else ';'} you can redistribute it and/or modify it under the terms of the "
            f"GNU {kind} General Public License as published by the Free Software Foundation, either version {version} of the License, or "
            f"(at your option) any later version. {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
            "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
            f"{kind} General Public License for more details.{more}")


TEMPLATES |= {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "AGPL-3.0 notice": _gnu_notice("This program", "Affero", "3"),
    "BSD-2-Clause": _BSD_2, "BSD-2-Clause text": f"{_BSD_2} {_BSD_REST}",
    "BSD-3-Clause": _BSD_3, "BSD-3-Clause text": f"{_BSD_3} {_BSD_REST}",
    "BSD warranty": _BSD_REST,
    "BSL-1.0 notice": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                       "http://www.boost.org/LICENSE_1_0.txt)"),
    "CC0-1.0 notice": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
                       "to this software to the public domain worldwide. This software is distributed without any warranty."),
    "CC0-1.0 waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0 notice": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
                       "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "GFDL notice": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation "
                    "License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no "
                    "Front-Cover Texts, and no Back-Cover Texts."),
    "GPL-2.0 notice": _gnu_notice("This program", "", "2"),
    "GPL-2.0-only notice": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                            "Public License version 2 as published by the Free Software Foundation."),
    "ISC text": f"{TEMPLATES['ISC']} {_ISC_REST}", "ISC warranty": _ISC_REST,
    "LGPL-2.1 notice": _gnu_notice("This library", "Lesser", "2.1"),
    "LGPL-3.0 notice": _gnu_notice("This program", "Lesser", "3"),
    "MIT text": f"{TEMPLATES['MIT']} {_MIT_REST}", "MIT warranty": _MIT_REST,
    "OFL-1.1 notice": ("This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is "
                       "also available with a FAQ at: https://scripts.sil.org/OFL"),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
    "Unlicense line": "This is free and unencumbered software released into the public domain.",
    "WTFPL notice": ("This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can "
                     "redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as "
                     "published by Sam Hocevar."),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
             "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
             "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    "public domain line": "This work is in the public domain.",
    "public domain release": "This work has been released into the public domain.",
}

#: How lines name a licence.
_NAMES = {
    "0BSD": ("the Zero-Clause BSD License",), "AFL-3.0": ("the Academic Free License version 3.0",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU AGPLv3", "the AGPL-3.0 license"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license"),
    "Artistic-2.0": ("the Artistic License 2.0",),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License"), "BSD": ("the BSD License",),
    "BSL-1.0": ("the Boost Software License, Version 1.0",),
    "CC0-1.0": ("CC0 1.0", "a Creative Commons CC0 1.0 Universal License", "CC0 1.0 Universal"),
    "CDDL-1.0": ("the Common Development and Distribution License 1.0",),
    "EPL-2.0": ("the Eclipse Public License 2.0",), "EUPL-1.2": ("the European Union Public Licence 1.2",),
    "GFDL": ("the GNU Free Documentation License",),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GPLv2", "the GPL-2.0 license"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GPLv3", "the GPL-3.0 license"),
    "GPL": ("the GNU General Public License", "the GNU GPL"),
    "ISC": ("the ISC License",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "the LGPLv2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "the LGPLv3"),
    "MIT": ("the MIT License",), "MPL-2.0": ("the Mozilla Public License 2.0", "the MPL 2.0"),
    "ODbL-1.0": ("the Open Database License (ODbL) 1.0",), "OFL-1.1": ("the SIL Open Font License, Version 1.1",),
    "Unlicense": ("the Unlicense",), "WTFPL": ("the WTFPL",), "Zlib": ("the zlib License",),
}
_LINES = ("Licensed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.",
          "This project is licensed under {} - see the LICENSE file for details.")
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _add_lines() -> None:
    """Adds each licence's lines that ``TEMPLATES`` has not word by word, as ``<licence> line <number>``."""
    there = {" ".join(_words(text)) for text in TEMPLATES.values()}

    def add(licence: str, lines) -> None:
        for line in lines:
            said, n = " ".join(_words(line)), 1
            if said not in there:
                there.add(said)
                while f"{licence} line {n}" in TEMPLATES:
                    n += 1
                TEMPLATES[f"{licence} line {n}"] = line

    for licence, names in _NAMES.items():
        add(licence, (line.format(name) for name in names for line in _LINES))
        add(licence, (f"SPDX-License-Identifier: {licence}",))
    for licence in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
        add(licence, (f"SPDX-License-Identifier: {licence}-only", f"SPDX-License-Identifier: {licence}-or-later"))
    for kind, name in _CC.items():
        for version, port in _CC_VERSIONS.items():
            said = name if version == "4.0" else name.replace("NoDerivatives", "NoDerivs")
            long = f"Creative Commons {said} {version}"
            add(f"CC-{kind}-{version}", (
                f"Licensed under CC {kind} {version}.", f"This work is licensed under CC {kind} {version}.",
                f"Licensed under {long} {port}.", f"This work is licensed under a {long} {port} License.",
                f"Licensed under the {long} License.", f"SPDX-License-Identifier: CC-{kind}-{version}"))


def _words(text: str) -> list[str]:
    return [w for w in re.split(_PARTING, text.translate(str.maketrans(UPPER, LOWER))) if w]



_add_lines()

#: Words that most texts have.
_FREQUENT = frozenset("a an and any are as at be been by for from has have in is it its not of on or other see that the this to was which "
                      "with without you 0 1 2 3 4".split())


def marks_of(templates: dict[str, str], similarity: float) -> list[str]:
    """Words of which every text that matches a template has one.

    A match has at least ``d / (2 - d)`` of the template's bigrams. The words are chosen so that in each template fewer
    bigrams than that lie between words not chosen; frequent words come last.
    """
    open_: list[list[set[str]]] = []
    spare: list[int] = []
    for text in templates.values():
        words = _words(text)
        pairs = [set(p) for p in sorted(set(zip(words, words[1:])))]
        if pairs:
            open_.append(pairs)
            spare.append(math.ceil(len(pairs) * similarity / (2 - similarity) - 1e-9) - 1)
    marks: list[str] = []
    while True:
        left = [pairs for pairs, n in zip(open_, spare) if len(pairs) > max(n, 0)]
        if not left:
            return marks
        gain = Counter(w for pairs in left for w in set().union(*pairs))
        marks.append(min(gain, key=lambda w: (w in _FREQUENT, -gain[w], w)))
        open_ = [[p for p in pairs if marks[-1] not in p] for pairs in open_]


def split_words(text):
    """Words of a lowered text, as an array column."""
    return F.array_remove(F.split(text, _PARTING, -1), "")


def with_bigrams(df: DataFrame, into: str) -> DataFrame:
    """``df`` with ``words`` replaced by ``into``, its distinct pairs of neighbouring words."""
    rest = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, rest), F.slice("words", 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))
    return df.withColumn(into, F.array_distinct(pairs)).drop("words")


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, similarity: float = SIMILARITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``n_hits``, the best ``license``, its ``dice``, and all ``licenses`` found, sorted.

    Compared with each template are every line, every paragraph of two or more lines (between blank lines) and the
    whole text. Units without any of the words that every match has (:func:`marks_of`) go first. With Dice d, a bigram set of size a can only match a template of size b if
    ``d / (2 - d) * b <= a <= (2 - d) / d * b``; other templates are pruned before any words are compared: each
    template is listed under the sizes it can match, and units join that list by size. The list is broadcast; it is as
    large as the templates, a parameter and not data that grows. Nothing but found hits and ids is shuffled.

    One row per distinct id (repeated rows are one document). NULL or empty text, or no bigram: no hits, NULL licence.
    NULL id: a document of its own. Equal scores: the licence first by name. Empty table: no rows.
    """
    spark = docs.sparkSession
    names = TEMPLATES if templates is None else templates
    rows = spark.createDataFrame([(n, t) for n, t in sorted(names.items())], "name string, text string")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    low, high = similarity / (2 - similarity), (2 - similarity) / similarity
    known = with_bigrams(rows.select(F.col("name").alias("license"), split_words(ascii_lower(F.col("text"))).alias("words")), "known")
    known = known.where(F.size("known") > 0).select("license", "known", F.explode(F.sequence(
        F.ceil(F.size("known") * low - 1e-9).cast("int"), F.floor(F.size("known") * high + 1e-9).cast("int"))).alias("size"))
    least, most = known.agg(F.min("size"), F.max("size")).first()
    plain = base.where(F.length("text") > 0).select("id", ascii_lower(F.col("text")).alias("text"))
    paragraphs = F.filter(F.split("text", "\n[ \t\r]*\n\\s*", -1), lambda p: p.contains("\n"))
    units = F.concat(F.split("text", "\n", -1), paragraphs,
                     F.when(F.col("text").contains("\n"), F.array("text")).otherwise(F.array().cast("array<string>")))
    # words are made inside the generator, so that the filters below don't split a text again
    units = plain.select("id", F.explode(F.transform(units, split_words)).alias("words"))
    # d distinct words make d - 1 distinct bigrams at least, n words n - 1 at most: other units match no template's size
    units = units.where((F.size("words") > (least or 1)) & (F.size(F.array_distinct("words")) <= (most or 0) + 1))
    marks = marks_of(names, similarity)
    units = units.where(F.arrays_overlap("words", F.array(*map(F.lit, marks)).cast("array<string>")))
    units = with_bigrams(units, "grams").withColumn("size", F.size("grams"))
    dice = F.size(F.array_intersect("grams", "known")) * 2.0 / (F.size("grams") + F.size("known"))
    found = units.join(F.broadcast(known), "size").select("id", "license", dice.alias("dice")).where(F.col("dice") >= similarity)
    none = base.select("id", F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"))
    hits = none.unionByName(found)
    best = F.min(F.when(F.col("license").isNotNull(), F.struct((-F.col("dice")).alias("d"), F.col("license").alias("name"))))
    out = hits.groupBy("id").agg(F.count("license").alias("n_hits"), best.alias("best"),
                                 F.collect_set("license").alias("names"))
    return out.select(F.col("id").alias(id_col), "n_hits", F.col("best.name").alias("license"),
                      (-F.col("best.d")).alias("dice"), F.array_join(F.array_sort("names"), "; ").alias("licenses"))


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))

    def grams(text: str) -> str:
        words = (f"list_filter(regexp_split_to_array(translate({text}, '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), "
                 "lambda w: w <> '')")
        return (f"(SELECT list_distinct(list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) "
                f"FROM (SELECT {words} AS ws))")

    return f"""
WITH t AS (SELECT name, {grams('body')} AS g FROM (VALUES {values}) v(name, body)),
u AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, p FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n\\s*')) AS p FROM documents WHERE text <> '')
  WHERE contains(p, chr(10))
  UNION ALL
  SELECT doc_id, text FROM documents WHERE contains(text, chr(10))
),
g AS (SELECT doc_id, {grams('unit')} AS g FROM u),
h AS (
  SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice FROM g, t WHERE len(g.g) > 0
),
f AS (SELECT * FROM h WHERE dice >= {SIMILARITY}),
a AS (
  SELECT doc_id, count(*) AS n_hits, arg_min(name, (-dice, name)) AS license, max(dice) AS dice,
    array_to_string(list_sort(list_distinct(list(name))), '; ') AS licenses
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_hits, 0) AS n_hits, license, dice, coalesce(licenses, '') AS licenses
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN a ON a.doc_id IS NOT DISTINCT FROM d.doc_id
"""


@query("op4_licenses", _sql())
def op4_licenses(spark, sf_dir):
    return license_scan(given(spark, sf_dir, "documents"))
