"""Licence lines and texts as they are met in the wild, written without a look at the templates."""

from tessera.llm import licenses

SAID = [
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("licensed under cc by-nc-sa 4.0", "CC-BY-NC-SA-4.0"),
    ("This article is licensed under CC-BY-ND 3.0.", "CC-BY-ND-3.0"), ("Released under CC BY-SA 3.0", "CC-BY-SA-3.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ("Licensed under a Creative Commons Attribution 2.5 Generic License", "CC-BY-2.5"),
    ("This work is licensed under the Creative Commons Attribution-NoDerivs 3.0 Unported License.", "CC-BY-ND-3.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("# SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("Released under the BSD 3-Clause License.", "BSD-3-Clause"), ("Distributed under the ISC License.", "ISC"),
    ("This project is licensed under the MIT License - see the LICENSE.md file for details", "MIT"),
    ("This software is released under the GNU General Public License v2.0.", "GPL-2.0"),
    ("This program is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("The above is licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work.", "CC0-1.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "0BSD"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following "
     "conditions are met:\n1. Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the "
     "following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright\nnotice, this list of conditions and "
     "the following disclaimer in the\ndocumentation and/or other materials provided with the distribution.", "BSD-2-Clause"),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
     "OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE "
     "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN "
     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.", "MIT"),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as "
     "published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\nThis program is "
     "distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or "
     "FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.", "GPL-2.0"),
]
PLAIN = ["This work is under way and we are in no hurry.", "She was licensed to drive under a new law of 2004.", "by nc 4 0", "under the license"]


def test_common_licences_are_found(spark):
    rows = [(i, f"some prose before it\n\n{said}\n\nand after") for i, (said, _) in enumerate(SAID)] + [(100 + i, t) for i, t in enumerate(PLAIN)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [(said, name, got[i].license) for i, (said, name) in enumerate(SAID) if not (got[i].license or "").startswith(name)]
    assert missed == []
    assert [got[100 + i].n_hits for i in range(len(PLAIN))] == [0] * len(PLAIN)


def test_words_that_every_match_has():
    templates = {"a": "one two three four five six", "b": "the of", "c": "word", "d": ""}
    for similarity in (0.5, 0.75, 1.0):
        marks = set(licenses.marks_of(templates, similarity))
        least = similarity / (2 - similarity)
        for text in templates.values():
            words = text.split()
            pairs = list(zip(words, words[1:]))
            assert not pairs or sum(not marks & set(p) for p in pairs) < least * len(pairs)
