"""Licence recognition by sentences and ordered rules.

Known licence sentences are sequences of normalised words (lower case, letters
and digits only) with identifiers.  A text is read as normalised words too, so
line breaks at any width, comment marks before the lines, quotes and case play
no part.  Wherever the first words of a known sentence stand, the longest known
sentence that goes on from there is looked up word by word; ``*`` in a sentence
stands for a name of 1 to 40 words, as where a holder is named.  The identifiers found, in text order, are matched against the rules:
a rule is an ordered list of identifiers, longer rules come first, and
identifiers that a rule has used are not used again.

Defined results: null and empty texts have no sentences and no licences; rows
are kept one for one, null ids and repeated rows as well; a sentence may occur
any number of times, licences are named once, in the order of their first
sentence; an empty table gives an empty one; other columns are ignored, whatever
their names.  Texts are scanned whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from lexigrain.llm.common import id_text

# Sentences of public licences and usual notices, by identifier.
SENTENCES: dict[str, list[str]] = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License",
                   "SPDX-License-Identifier: MIT"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "apache-2-notice": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")",
                        "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0"],
    "apache-2-compliance": ["you may not use this file except in compliance with the License"],
    "apache-2-copy": ["You may obtain a copy of the License at"],
    "gpl-3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3",
                     "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl-free-software": ["This program is free software"],
    "gpl-redistribute-3": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                           "Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-redistribute-2": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                           "Software Foundation, either version 2 of the License, or (at your option) any later version"],
    "gpl-2-notice": ["Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only",
                     "SPDX-License-Identifier: GPL-2.0-or-later"],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                           "following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                   "in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of * nor the names of its contributors may be used to endorse or promote products derived "
                    "from this software without specific prior written permission"],
    "bsd-2-notice": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License"],
    "bsd-3-notice": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License"],
    "mpl-2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-4-notice": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4-notice": ["Licensed under CC BY-SA 4.0",
                          "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4-notice": ["Licensed under CC BY-NC 4.0",
                          "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-4-notice": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa-4-notice": ["Licensed under CC BY-NC-SA 4.0",
                             "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nc-nd-4-notice": ["Licensed under CC BY-NC-ND 4.0",
                             "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc0-notice": ["SPDX-License-Identifier: CC0-1.0", "Licensed under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0"],
    "lgpl-redistribute-21": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
                             "Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl-redistribute-3": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
                            "Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-redistribute-3": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
                            "Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "library-free-software": ["This library is free software"],
    "lgpl-21-notice": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later",
                       "Licensed under the GNU Lesser General Public License, version 2.1"],
    "lgpl-3-notice": ["SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later",
                      "Licensed under the GNU Lesser General Public License, version 3"],
    "agpl-3-notice": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
                      "Licensed under the GNU Affero General Public License, version 3"],
    "isc-notice": ["SPDX-License-Identifier: ISC", "Licensed under the ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
                  "the above copyright notice and this permission notice appear in all copies",
                  "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that "
                  "the above copyright notice and this permission notice appear in all copies"],
    "unlicense-notice": ["SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain"],
    "zlib-notice": ["SPDX-License-Identifier: Zlib", "Licensed under the zlib License"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
                   "redistribute it freely, subject to the following restrictions"],
    "boost-notice": ["SPDX-License-Identifier: BSL-1.0", "Distributed under the Boost Software License, Version 1.0"],
    "epl-2-notice": ["SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse "
                     "Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"],
    "warranty-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
                       "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
}

# Fixed values: (licence, identifiers in order); matched from the longest rule down.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("MIT", ("mit-grant", "mit-condition", "warranty-as-is")),
    ("Apache-2.0", ("apache-2-notice", "apache-2-compliance", "apache-2-copy")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("GPL-3.0-or-later", ("gpl-free-software", "gpl-redistribute-3")),
    ("GPL-2.0-or-later", ("gpl-free-software", "gpl-redistribute-2")),
    ("LGPL-3.0-or-later", ("gpl-free-software", "lgpl-redistribute-3")),
    ("LGPL-3.0-or-later", ("library-free-software", "lgpl-redistribute-3")),
    ("LGPL-2.1-or-later", ("library-free-software", "lgpl-redistribute-21")),
    ("AGPL-3.0-or-later", ("gpl-free-software", "agpl-redistribute-3")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache-2-notice",)),
    ("GPL-3.0", ("gpl-3-notice",)),
    ("GPL-2.0", ("gpl-2-notice",)),
    ("BSD-2-Clause", ("bsd-2-notice",)),
    ("BSD-3-Clause", ("bsd-3-notice",)),
    ("MPL-2.0", ("mpl-2-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-notice",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-notice",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("LGPL-2.1", ("lgpl-21-notice",)),
    ("LGPL-3.0", ("lgpl-3-notice",)),
    ("AGPL-3.0", ("agpl-3-notice",)),
    ("ISC", ("isc-notice",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-notice",)),
    ("Zlib", ("zlib-notice",)),
    ("BSL-1.0", ("boost-notice",)),
    ("EPL-2.0", ("epl-2-notice",)),
]

_WORD = re.compile(r"[0-9a-z]+")
ANY, END, NAME_WORDS = "*", "", 40


def normalise(sentence: str) -> list[str]:
    return re.findall(r"[0-9a-z]+|\*", sentence.lower())


class Scanner:
    """Recognises the sentences and rules given."""

    def __init__(self, sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES):
        self.rules = sorted(rules, key=lambda r: -len(r[1]))
        self.tree: dict = {}  # known sentences by their words
        begins = set()
        for name, forms in sentences.items():
            for words in map(normalise, forms):
                at = self.tree
                for w in words:
                    at = at.setdefault(w, {})
                at[END] = name
                begins.add(tuple(words[: 3 if ANY not in words[:3] else words.index(ANY)]))
        begin = "|".join("[^0-9a-z]+".join(b) for b in sorted(begins, key=lambda b: (-len(b), b)))
        self.begin = re.compile(rf"(?<![0-9a-z])(?:{begin})(?![0-9a-z])")

    def longest(self, low: str, start: int) -> tuple[str, int] | None:
        """(identifier, end) of the longest known sentence that begins at ``start``."""
        found = None
        states = [(self.tree, 0)]  # where in the tree the words so far may stand, and how many words more a name there may have
        for m in _WORD.finditer(low, start):
            following = []
            for at, more in states:
                if (n := at.get(m[0])) is not None:
                    following.append((n, 0))
                if (n := at.get(ANY)) is not None:
                    following.append((n, NAME_WORDS - 1))
                if more:
                    following.append((at, more - 1))
            for at, _ in following:
                if END in at:
                    found = at[END], m.end()
            states = following
            if not states:
                break
        return found

    def sentences(self, text: str) -> list[str]:
        """Identifiers of the licence sentences of a text, in order."""
        low = text.lower()
        out, done = [], 0
        while (m := self.begin.search(low, done)) is not None:
            known = self.longest(low, m.start())
            if known:
                out.append(known[0])
            done = known[1] if known else m.start() + 1
        return out

    def licences(self, ids: list[str]) -> list[str]:
        """Names of the licences whose rules the identifiers fulfil."""
        free, found = list(range(len(ids))), []
        for name, rule in self.rules:
            while True:
                used, need = [], iter(rule)
                want = next(need)
                for i in free:
                    if ids[i] == want:
                        used.append(i)
                        want = next(need, None)
                        if want is None:
                            break
                if want is not None:
                    break
                found.append((used[0], name))
                free = [i for i in free if i not in set(used)]
        return list(dict.fromkeys(name for _, name in sorted(found)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licences) for each row of ``docs``."""

    def run(batches):
        scanner = Scanner()
        for b in batches:
            ids = [scanner.sentences(t) for t in b.column(1).to_pylist()]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, kind), pa.array([scanner.licences(i) for i in ids], kind)],
                names=["doc_id", "sentence_ids", "licences"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, sentence_ids array<string>, licences array<string>")
