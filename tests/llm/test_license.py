from pagelode.llm import license

SCHEMA = "doc_id long, text string, sequence string, found int"


def scan(spark, rows):
    return {x["doc_id"]: x for x in license.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_every_rule(spark):
    sentence = {}
    for i, s in license.SENTENCES:
        sentence.setdefault(i, s)
    rows = [(k, "Some text here.\n" + ".\n".join(sentence[i].capitalize() for i in ids) + ".", "x", 1) for k, (_, ids) in enumerate(license.RULES)]
    got = scan(spark, rows)
    for k, (name, ids) in enumerate(license.RULES):
        assert got[k]["sequence"] == ",".join(ids) and got[k]["licenses"] == name and got[k]["unmatched"] == ""


def test_cases(spark):
    wrapped = "Licensed under the Apache License,\nversion 2.0. Then more.\nReleased under the MIT License. Licensed under CC BY-NC 4.0.\nSee the GNU General Public License for more details."
    rows = [(1, wrapped, "x", 1), (2, None, "x", 1), (3, "", None, None), (4, "my license is none of these", "x", 1), (5, "Released under the MIT License.\n" * 3000, "x", 1), (None, "Released under the MIT License", "x", 1)]
    got = scan(spark, rows)
    assert got[1]["licenses"] == "Apache-2.0,CC-BY-NC-4.0,MIT" and got[1]["unmatched"] == "gpl-details" and got[1]["n_sentences"] == 4
    assert [got[i]["licenses"] for i in (2, 3, 4)] == ["", "", ""]
    assert got[5]["licenses"] == "MIT" and got[5]["n_sentences"] == 3000 and got[5]["unmatched"] == ""
    assert got[None]["licenses"] == "MIT"
    assert license.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


MIT = """MIT License

Copyright (c) 2025 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""


def test_wrapped_texts_tags_and_mixtures(spark):
    """Wrapped licence texts, tags, names inside sentences, and licences that stand inside each other."""
    s = dict((i, x) for i, x in license.SENTENCES)
    interleaved = ["mit-grant", "bsd-use", "mit-notice", "bsd-source", "mit-warranty", "bsd-binary"]
    nested = ["gpl3-later", "mpl-subject", "mpl-obtain", "gpl-hope", "gpl-details"]
    rows = [
        (1, MIT, "x", 1),
        (2, GPL, "x", 1),
        (3, "// SPDX-License-Identifier: MIT\nint main() {}", "x", 1),
        (4, "# SPDX-License-Identifier: Apache-2.0", "x", 1),
        (5, "Note that this file is released under the MIT license, like the rest.", "x", 1),
        (6, ". ".join(s[i] for i in interleaved), "x", 1),
        (7, ". ".join(s[i] for i in nested), "x", 1),
        (8, "the software is provided as is. without warranty of any kind", "x", 1),
    ]
    got = scan(spark, rows)
    assert got[1]["licenses"] == "MIT" and got[1]["unmatched"] == "" and got[1]["sequence"] == "mit-grant,mit-notice,mit-warranty,mit-liability"
    assert got[2]["licenses"] == "GPL-3.0-or-later"
    assert [got[k]["licenses"] for k in (3, 4, 5)] == ["MIT", "Apache-2.0", "MIT"]
    assert got[6]["licenses"] == "BSD-2-Clause,MIT" and got[6]["unmatched"] == ""
    assert got[7]["licenses"].split(",") == ["GPL-3.0-or-later", "MPL-2.0"] and got[7]["unmatched"] == ""
    assert got[8]["sequence"] == ""


def test_tables():
    import re

    assert len(license.TEXTS) + len(license._references()) >= 100
    assert all(re.search(license.NEEDED, s) for _, s in license.SENTENCES)
    assert all(s == re.sub("[^a-z0-9]+", " ", s).strip() for _, s in license.SENTENCES)
    known = {i for i, _ in license.SENTENCES}
    assert all(set(ids) <= known for _, ids in license.RULES)
    assert len({s for _, s in license.SENTENCES}) == len({(i, s) for i, s in license.SENTENCES})


# Headers as they stand in public source files, unaltered.
HEADERS = {
    "GPL-2.0-or-later": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.""",
    "GPL-2.0-only": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License version 2 as
 * published by the Free Software Foundation.""",
    "LGPL-2.1-or-later": """# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.
#
# This library is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
# Lesser General Public License for more details.""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-3.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported",
    "GPL-2.0-only ": "// SPDX-License-Identifier: GPL-2.0-only",
    "LGPL-2.1-or-later ": "/* SPDX-License-Identifier: LGPL-2.1-or-later */",
    "GPL-2.0": "// SPDX-License-Identifier: GPL-2.0",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.""",
    "Apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.""",
}


def test_unaltered_headers(spark):
    got = scan(spark, [(k, text, "x", 1) for k, text in enumerate(HEADERS.values())])
    assert {name: got[k]["licenses"] for k, name in enumerate(HEADERS)} == {name: name.strip() for name in HEADERS}
    assert [got[k]["unmatched"] for k in range(len(HEADERS))] == [""] * len(HEADERS)
