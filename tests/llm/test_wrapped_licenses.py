"""Licence texts as they are published: wrapped, with headings, list numbers and comment signs."""

import pytest

from loanweave.llm import licenses

APACHE = """   Copyright [yyyy] [name of copyright owner]

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

   http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) [year] [fullname]

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
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = f"""{BSD2}
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
TEXTS = {
    "apache": (APACHE, 4, "Apache-2.0"),
    "asf": (ASF, 4, "Apache-2.0"),
    "mit": (MIT, 4, "MIT"),
    "gpl3": (GPL3, 3, "GPL-3.0-or-later"),
    "gpl2": (GPL2, 3, "GPL-2.0-or-later"),
    "bsd2": (BSD2, 3, "BSD-2-Clause"),
    "bsd3": (BSD3, 4, "BSD-3-Clause"),
    "bsd3-named": (BSD3.replace("the copyright holder", "Example Inc."), 4, "BSD-3-Clause"),
    "bsd3-lettered": (BSD3.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "(c) "), 4, "BSD-3-Clause"),
    "isc": (ISC, 1, "ISC"),
    "mpl": (MPL, 2, "MPL-2.0"),
}


def variants(text):
    lines = text.splitlines()
    yield text
    yield text.replace("\n", "\r\n")
    yield "int x;\n" + "\n".join(f"// {x}".rstrip() for x in lines) + "\nint y;"
    yield "\n".join(f"# {x}".rstrip() for x in lines)
    yield "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */"


@pytest.fixture(scope="module")
def scanned(documents):
    rows = [(i * 100 + j, v) for i, (text, _, _) in enumerate(TEXTS.values()) for j, v in enumerate(variants(text))]
    return {r["doc_id"]: r for r in licenses.scan(documents(rows)).collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)), ids=list(TEXTS))
def test_published_texts(scanned, i):
    _, n, name = list(TEXTS.values())[i]
    for j in range(5):
        row = scanned[i * 100 + j]
        assert (len(row["sentence_ids"]), row["licenses"]) == (n, [name])


def test_a_mark_ends_a_sentence_and_part_of_one_is_none(documents):
    rows = [
        (1, "Released under the. MIT License terms"), (2, "we talk of the MIT License\nand more"),
        (3, "Released under\nthe MIT License\n"), (4, "Released under the MIT License.\nReleased under the MIT License"),
        (5, "Licensed under the Apache License, Version 2.0\nMIT License\nLicensed under CC BY 4.0"),
    ]
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan(documents(rows)).collect()}
    assert got == {1: [], 2: [], 3: ["mit-notice"], 4: ["mit-notice"] * 2, 5: ["apache-notice", "mit-name", "cc-by"]}


def test_short_names_and_more_families(documents):
    rows = [
        (1, "// SPDX-License-Identifier: Apache-2.0\nint main;"),
        (2, "/* SPDX-License-Identifier: GPL-2.0-only */"),
        (3, "# SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: MIT-0"),
        (4, "SPDX-License-Identifier: MIT-1"),
        (5, "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
            "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
        (6, "    GNU AFFERO GENERAL PUBLIC LICENSE\n    Version 3, 19 November 2007\n"),
        (7, "        GNU GENERAL PUBLIC LICENSE\n           Version 2, June 1991\n"),
        (8, "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable\n"
            "for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
            "purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n"),
        (9, "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)"),
        (10, "                Apache License\n          Version 2.0, January 2004\n       http://www.apache.org/licenses/"),
        (11, "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ]
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(documents(rows)).collect()}
    assert found == {
        1: ["Apache-2.0"], 2: ["GPL-2.0-only"], 3: ["MIT", "MIT-0"], 4: [], 5: ["LGPL-2.1-or-later"], 6: ["AGPL-3.0-only"],
        7: ["GPL-2.0-only"], 8: ["Zlib"], 9: ["BSL-1.0"], 10: ["Apache-2.0"], 11: ["CC-BY-NC-SA-4.0"],
    }


def test_every_sentence_has_a_rule_of_its_own():
    used = {i for _, ids in licenses.RULES + licenses.MORE_RULES for i in ids}
    assert set(licenses.SENTENCES) <= used | {"zlib-as-is", "mpl-copy"}
    assert len(licenses.all_sentences()) >= 100
