"""Licence recognition by sentence rules.

A text is cut into sentences, each is normalised (lower case, anything but letters and digits to one space) and looked
up among known licence sentences; the identifiers found, in text order, are matched against the rules in their order.
A rule consumes what it matches, so a longer rule that comes first wins over the shorter ones inside it.

A mark ends a sentence, a line break may or may not: at each place the longest known sentence is taken that begins and
ends at a mark or line break, with any line breaks, blank lines, comment signs (``*``, ``#``, ``//``) inside it. So one
that stands on a line of its own is found, and so is one that is wrapped over several. A list number may precede it.
``SENTENCES``, ``RULES`` and ``ENDS`` are the part that SQL compares, line by line; ``WORDINGS`` and ``MORE_RULES``
come on top.

Edge cases: a null or empty text has no sentence and no licence; repeated rows are scanned one by one; a null
``doc_id`` is reported like any other; further columns are kept untouched. All of it is one projection, without a
shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences of public licences and licence notices.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License "
    'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-name": "The MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "bsd-notice": "Released under the BSD License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at "
    "http://mozilla.org/MPL/2.0/",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
    "License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
    "this work",
    "cc-by-nd": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-nd-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-sa-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
    "International License",
    "cc-by-nc-nd-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
    "International License",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
    "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
    "(at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
    "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-any": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
    "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
    'software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, '
    "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
    "third-parties to whom the Software is furnished to do so, all subject to the following",
    "apache-title": "Version 2.0, January 2004",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "fsf-v2": "Version 2, June 1991",
    "fsf-v21": "Version 2.1, February 1999",
    "fsf-v3": "Version 3, 29 June 2007",
    "agpl-v3": "Version 3, 19 November 2007",
    "mpl-title": "Mozilla Public License Version 2.0",
}

# Short identifiers of public licences, as they stand behind "SPDX-License-Identifier:".
SHORT_NAMES = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause",
    "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL",
    "X11", "Zlib",
)
SENTENCES |= {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in SHORT_NAMES}

# Rules in order: a name and the sentence identifiers that make it, next to each other in the text's sequence.
RULES = (
    ("Apache-2.0", ("apache-head", "apache-copy", "apache-as-is", "apache-see")),
    ("MIT", ("mit-name", "mit-grant", "mit-keep", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl-notice", "mpl-copy")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-head",)),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-name",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("BSD-3-Clause", ("bsd-notice",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-long",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-long",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-long",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-see")),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("Unlicense", ("unlicense-free", "unlicense-any")),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("BSL-1.0", ("boost-notice",)),
    ("BSL-1.0", ("boost-grant",)),
    ("Apache-2.0", ("apache-title",)),
    ("GPL-2.0-only", ("gpl-title", "fsf-v2")),
    ("GPL-3.0-only", ("gpl-title", "fsf-v3")),
    ("LGPL-2.1-only", ("lgpl-title", "fsf-v21")),
    ("LGPL-3.0-only", ("lgpl-title", "fsf-v3")),
    ("AGPL-3.0-only", ("agpl-title", "agpl-v3")),
    ("MPL-2.0", ("mpl-title",)),
    *((name, (f"spdx-{name.lower()}",)) for name in SHORT_NAMES),
)

# Further wordings of sentences above, and sentences of ``MORE_RULES``.
WORDINGS = (
    ("apache-head", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not '
    "use this file except in compliance with the License"),
    ("apache-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.html"),
    ("apache-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0.html"),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.txt"),
    ("apache-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0.txt"),
    ("mit-name", "MIT License"),
    ("mit-name", "The MIT License (MIT)"),
    ("mit-name", "MIT License (MIT)"),
    ("mit-keep", "The above copyright notice and this permission notice (including the next paragraph) shall be included "
    "in all copies or substantial portions of the Software"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at "
    "https://mozilla.org/MPL/2.0/"),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
    "option) any later version"),
)

MORE_RULES = (
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
)

# The BSD sentence names an organisation or a person in place of the copyright holder.
NAMED = ("neither the name of ", "the copyright holder", " nor the names of its contributors ")

# A sentence ends at a line break, or at a mark followed by white space or the end.
ENDS = r"[.!?]+([ \t\r]+|$)|[.!?]*[ \t\r]*\n"
OTHER = "[^a-z0-9]+"


def normal(sentence: str) -> str:
    return re.sub(OTHER, " ", sentence.lower()).strip(" ")


def known_sentences() -> dict[str, str]:
    """Normal form -> identifier."""
    return {normal(text): name for name, text in SENTENCES.items()}


def all_sentences() -> dict[str, str]:
    """Normal form -> identifier, with the further wordings."""
    return known_sentences() | {normal(text): name for name, text in WORDINGS}


SHORT = normal("SPDX-License-Identifier:") + " "

# In lower case no capital is left, so M stands for a mark and N for a line break.
MARK = r"[.!?]+(?:[ \t\r]+|$)|[.!?]+[ \t\r]*\n"
LIST_NUMBER = "(?:(?:[0-9]{1,2}|[a-z]) )?"


def sentence_pattern() -> str:
    """Any known sentence between marks or line breaks, the longest first, with line breaks inside."""
    wrapped = lambda s: s.replace(" ", "[ N]")
    before, holder, after = map(wrapped, NAMED)
    named = f"{before}(?:[a-z0-9]+[ MN]){{0,15}}?[a-z0-9]+{after.replace('names', 'names?')}".replace("[ N]nor", "[ MN]nor")
    known = sorted(all_sentences(), key=len, reverse=True)
    options = [wrapped(s).replace(before + holder + after, named) for s in known if not s.startswith(SHORT)]
    # One branch for all short names: most lines fail at its first letters.
    names = "|".join(wrapped(s.removeprefix(SHORT)) for s in known if s.startswith(SHORT))
    options.append(f"{wrapped(SHORT)}(?:{names})")
    return f"(?<=[MN]){LIST_NUMBER}({'|'.join(options)})(?=[MN])"


def code(name: str) -> str:
    return f"<{name}>"


def scan(docs: DataFrame) -> DataFrame:
    """Append ``sentence_ids`` (identifiers in text order), ``licenses`` (one per match, in rule order)."""
    table = F.create_map(*[F.lit(v) for pair in all_sentences().items() for v in pair])
    marked = F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), MARK, "M")
    words = F.concat(F.lit("M"), F.regexp_replace(F.replace(marked, F.lit("\n"), F.lit("N")), "[^a-z0-9MN]+", " "), F.lit("M"))
    tidy = F.regexp_replace(F.regexp_replace(words, "[ N]*M[ MN]*", "M"), " ?N[ N]*", "N")
    before, holder, after = NAMED
    any_name = f"^{before}.*{after.replace('names', 'names?')}"

    def identify(sentence: Column) -> Column:
        plain = F.translate(sentence, "MN", "  ")
        return F.try_element_at(table, F.regexp_replace(plain, any_name, before + holder + after))

    found = F.transform(F.regexp_extract_all(tidy, F.lit(sentence_pattern()), F.lit(1)), identify)
    rules = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit("".join(map(code, ids))).alias("ids")) for n, ids in RULES + MORE_RULES]
    )
    sequence = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("names"))

    def apply(acc: Column, rule: Column) -> Column:
        rest = F.replace(acc["rest"], rule["ids"], F.lit("|"))
        hits = F.floor((F.length(acc["rest"]) - F.length(rest)) / (F.length(rule["ids"]) - 1)).cast("int")
        return F.struct(rest.alias("rest"), F.concat(acc["names"], F.array_repeat(rule["name"], hits)).alias("names"))

    with_ids = docs.withColumn("sentence_ids", found)
    licences = F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, apply)["names"])
    return with_ids.withColumn("licenses", F.coalesce(licences, F.array().cast("array<string>")))
