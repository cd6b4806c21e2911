"""License scans: known sentences become identifiers, ordered rules match the sequence of identifiers.

A text is cut into sentences behind ``.``, ``!``, ``?``, ``:`` and ``;`` before white space, and at lines
without a word, so that a single line end inside a sentence is a space and wrapped or commented notices are found;
one-line notices and headings are found too, since each line is also cut by itself, and at dashes.  A sentence is normalised (lower case,
runs of other signs than a-z and 0-9 become one space, the number of a list item goes) and looked up among
the known sentences.  The identifiers found in a document, in order, are matched against the rules: a rule
matches where its identifiers stand next to each other in that sequence.  Rules are ordered: a match gives
way to a match of an earlier rule with which it shares a sentence.

Places are counted in words (runs of a-z and 0-9) from the start of the text.

Defined results: null and empty texts, and texts without a known sentence, yield no row; a licence that
a document states twice yields two rows; repeated rows and rows with equal ids repeat their results; texts
of any length are read whole; columns besides id and text are left out, so that their names can't clash; an
empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import map_rows, text_of

#: Notices (fixed values): rule, licence, text.  Rules are in order of precedence.
NOTICES = [
    ("mit-text", "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("isc-text", "ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("0bsd-text", "0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("bsd3-text", "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd2-text", "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsl-text", "BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("zlib-text", "Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("apache-header", "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("apache-use", "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("agpl3-header", "AGPL-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl3-header", "LGPL-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl21-header", "LGPL-2.1-or-later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("gpl3-header", "GPL-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl3-only-header", "GPL-3.0-only", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("gpl2-header", "GPL-2.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl2-only-header", "GPL-2.0-only", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("mpl2-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("epl2-header", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl1-header", "EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("unlicense-text", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0-text", "CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("ofl-text", "OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("artistic2-text", "Artistic-2.0", "This program is free software, you can redistribute it and/or modify it under the terms of the Artistic License version 2.0."),
]

#: Names by which one line states a licence (fixed values): rule, licence, names.
NAMES = [
    ("mit-line", "MIT", ["the MIT License", "MIT License", "the MIT license terms"]),
    ("apache-line", "Apache-2.0", ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache 2.0"]),
    ("agpl3-line", "AGPL-3.0-only", ["the GNU Affero General Public License, version 3", "the GNU AGPL v3", "the AGPL-3.0 License"]),
    ("lgpl3-line", "LGPL-3.0-only", ["the GNU Lesser General Public License, version 3", "the GNU LGPL v3", "the LGPL-3.0 License"]),
    ("lgpl21-line", "LGPL-2.1-only", ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1"]),
    ("gpl3-line", "GPL-3.0-only", ["the GNU General Public License, version 3", "the GNU GPL v3", "the GPL-3.0 License"]),
    ("gpl2-line", "GPL-2.0-only", ["the GNU General Public License, version 2", "the GNU GPL v2", "the GPL-2.0 License"]),
    ("bsd3-line", "BSD-3-Clause", ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"]),
    ("bsd2-line", "BSD-2-Clause", ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"]),
    ("mpl2-line", "MPL-2.0", ["the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "MPL 2.0"]),
    ("epl2-line", "EPL-2.0", ["the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0"]),
    ("isc-line", "ISC", ["the ISC License"]),
    ("zlib-line", "Zlib", ["the zlib License"]),
    ("bsl-line", "BSL-1.0", ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"]),
    ("unlicense-line", "Unlicense", ["the Unlicense"]),
    ("cc0-line", "CC0-1.0", ["CC0 1.0", "CC0 1.0 Universal", "a Creative Commons Zero 1.0 License"]),
    *[
        (f"cc{part.replace('-', '')}-line", f"CC-{part.upper()}-4.0", [f"CC {part} 4.0", f"a Creative Commons {words} 4.0 International License", f"the Creative Commons {words} 4.0 International License"])
        for part, words in [
            ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
            ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
        ]
    ],
]
#: What stands before the name (fixed values).
LEADS = ["Released under", "Licensed under", "Distributed under", "Available under", "Published under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This file is licensed under", "This document is licensed under"]

#: Behind the sign that ends a sentence, and lines without a word; the same with every line end and dash.
_CUT, _CUT_LINES = r"[.!?:;]+[ \t\r\n]+|\n[^a-z0-9\n]*\n", r"[.!?:;]+[ \t\r\n]+|\n|[ \t]+-+[ \t\r\n]+"
_CUTS = (re.compile(_CUT), re.compile(_CUT_LINES))
_ITEM, _WORD, _OTHER = re.compile("^(?:[0-9]{1,2}|[a-z]|ii|iii|iv) "), re.compile("[a-z0-9]+"), re.compile("[^a-z0-9]+")


def normalise(sentence: str) -> str:
    return _ITEM.sub("", _OTHER.sub(" ", _lower(sentence)).strip(" "))


def _lower(text: str) -> str:
    """ASCII letters alone, so that no sign of another script becomes a letter."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _known() -> tuple[dict[str, str], list[tuple[str, str, tuple[str, ...]]]]:
    """Identifiers of the known sentences, and the rules by identifiers."""
    known: dict[str, str] = {}
    rules = []
    for rule, licence, text in NOTICES:
        parts = [n for s in _CUTS[0].split(text) if len(n := normalise(s)) > 12]
        rules.append((rule, licence, tuple(known.setdefault(n, f"{rule}.{k}") for k, n in enumerate(parts))))
    for rule, licence, names in NAMES:
        known |= {n: rule for lead in LEADS for name in names if (n := normalise(f"{lead} {name}")) not in known}
        rules.append((rule, licence, (rule,)))
    for rule, licence, names in NAMES:  # the name alone on a line is a heading
        own = rule.replace("-line", "-heading")
        known |= {n: own for name in names if (n := normalise(name.removeprefix("the "))) not in known and ("license" in n or "unlicense" in n)}
        if own in known.values():
            rules.append((own, licence, (own,)))
    known[normalise("SPDX-License-Identifier")] = "spdx"
    tags = list(dict.fromkeys(r[1] for r in [*NOTICES, *NAMES]))
    for licence in [*tags, *(f"{a} {word} {b}" for word in ("OR", "AND") for a in tags for b in tags if a != b)]:
        known.setdefault(normalise(licence), f"spdx.{licence}")
        rules.append((f"spdx-{licence.lower()}", licence, ("spdx", known[normalise(licence)])))
    return known, rules


KNOWN, RULES = _known()
_BY_FIRST: dict[str, list[int]] = {}
for _r, _rule in enumerate(RULES):
    _BY_FIRST.setdefault(_rule[2][0], []).append(_r)
#: Every rule has a sentence with such a word, whatever stands between its words; most texts are passed over by
#: this test alone.
HINTS = "licen|permission|redistribution|unencumbered|extent|apache|gnu|mpl|(?:^|[^a-z0-9])cc(?:0|[^a-z0-9]+(?:by|0))"
_HINT = re.compile(HINTS)


def identifiers(text: str) -> list[tuple[int, int, str]]:
    """(first word, words, identifier) of the known sentences, in order; what lies in a longer one is left out."""
    text = _lower(text)
    if not _HINT.search(text):
        return []
    found = set()
    for cut in _CUTS:
        at = 0
        for s in cut.split(text):
            n = len(_WORD.findall(s))
            if name := KNOWN.get(normalise(s)):
                found.add((at, n, name))
            at += n
    kept, end = [], 0
    for f in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
        if f[0] + f[1] > end:
            kept.append(f)
            end = f[0] + f[1]
    return kept


def matches(found: list[tuple[int, int, str]]) -> list[tuple[str, str, int, int]]:
    """(rule, licence, first word, word after the last) of every place where a rule matches."""
    names = tuple(n for _, _, n in found)
    places = [(r, k, RULES[r][2]) for k, n in enumerate(names) for r in _BY_FIRST.get(n, ()) if names[k : k + len(RULES[r][2])] == RULES[r][2]]
    earliest: dict[int, int] = {}
    for r, k, ids in places:
        for at in range(k, k + len(ids)):
            earliest[at] = min(r, earliest.get(at, r))
    kept = [(r, k, k + len(ids) - 1) for r, k, ids in places if all(earliest[at] == r for at in range(k, k + len(ids)))]
    return [(RULES[r][0], RULES[r][1], found[a][0], found[b][0] + found[b][1]) for r, a, b in kept]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, licence, rule, first_word, end_word)``; one pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        for b in batches:
            hits = [(i, *m) for i, t in zip(b["id"], b["text"]) for m in matches(identifiers(t))]
            yield {n: [h[k] for h in hits] for k, n in enumerate(("id", "rule", "licence", "first_word", "end_word"))}

    out = map_rows(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), rows, f"id {kind}, licence string, rule string, first_word long, end_word long")
    return out.withColumnRenamed("id", id_col)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same scan in DuckDB SQL; capital letters of ASCII are lowered one by one."""
    known = ", ".join(f"({_quoted(n)}, {_quoted(k)})" for n, k in KNOWN.items())
    rules = ", ".join(f"({k}, {_quoted(r)}, {_quoted(li)}, {pos}, {_quoted(i)}, {len(ids)})" for k, (r, li, ids) in enumerate(RULES) for pos, i in enumerate(ids))
    return f"""
WITH known(s, id) AS (VALUES {known}), rules(o, rule, licence, pos, id, n) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS d, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
near AS (SELECT * FROM docs WHERE regexp_matches(t, {_quoted(HINTS)})),
cut AS (SELECT d, doc_id, 0 AS way, regexp_split_to_array(t, {_quoted(_CUT)}) AS parts FROM near UNION ALL SELECT d, doc_id, 1, regexp_split_to_array(t, {_quoted(_CUT_LINES)}) FROM near),
sentences AS (SELECT d, doc_id, way, unnest(parts) AS s, unnest(range(len(parts))) AS k FROM cut),
counted AS (SELECT *, len(regexp_extract_all(s, '[a-z0-9]+')) AS words FROM sentences),
placed AS (SELECT *, sum(words) OVER (PARTITION BY d, way ORDER BY k) - words AS place FROM counted),
every AS (SELECT DISTINCT d, doc_id, place, words, id FROM placed JOIN known ON known.s = regexp_replace(trim(regexp_replace(placed.s, '[^a-z0-9]+', ' ', 'g')), '^(?:[0-9]{{1,2}}|[a-z]|ii|iii|iv) ', '')),
hits AS (SELECT * FROM every QUALIFY place + words > coalesce(max(place + words) OVER (PARTITION BY d ORDER BY place, words DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY place, words DESC, id) AS r FROM hits),
joined AS (SELECT ranked.*, o, rule, licence, n, r - pos AS start FROM ranked JOIN rules USING (id)),
found AS (SELECT d, doc_id, o, rule, licence, start, n, min(place) AS first_word, max(place + words) AS end_word FROM joined GROUP BY ALL HAVING count(*) = n),
covers AS (SELECT d, o, start, unnest(range(start, start + n)) AS r FROM found),
best AS (SELECT d, r, min(o) AS o FROM covers GROUP BY ALL),
lost AS (SELECT DISTINCT covers.d, covers.o, covers.start FROM covers JOIN best ON covers.d = best.d AND covers.r = best.r AND covers.o > best.o)
SELECT doc_id, licence, rule, CAST(first_word AS BIGINT) AS first_word, CAST(end_word AS BIGINT) AS end_word FROM found ANTI JOIN lost USING (d, o, start)
"""
