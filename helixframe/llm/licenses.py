"""Licence scans by sentence rules.

A text is cut into units at line ends and sentence ends.  Each unit, or a run of adjacent units
where a sentence is wrapped over lines, is normalised to its lower-case words and looked up among
known licence sentences; what is found forms the text's sequence of sentence identifiers.  Ordered
rules are then matched against that sequence, longest first: a rule names a licence and the
identifiers that must follow one another with at most `gap` unknown units between two.  A
SPDX-License-Identifier line names its licences itself.

Edge cases: null and empty texts have no sentences and no licences; repeated sentences are reported
each time; identifiers used by one rule are not used again by a shorter one, and those that no
rule takes are still listed as sentences.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, ascii_words, kept_rows, utf8

# Public licence sentences by identifier.
SENTENCES = {
    "mit-short": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "apache2-short": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl2-short": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "cc-by-nc4-short": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "cc-by4-short": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "cc-by-sa4-short": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-warranty": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "apache2-use": ["you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "apache2-asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl-free": ["This program is free software", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "gpl3-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "either version 3 of the License, or (at your option) any later version."],
    "gpl2-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "either version 2 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

# A licence, and the ordered sentences that state it.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-short"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache2-short", "apache2-use", "apache2-copy", "apache2-asis", "apache2-see"]),
    ("Apache-2.0", ["apache2-short", "apache2-use", "apache2-copy"]),
    ("Apache-2.0", ["apache2-short"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-2.0", ["gpl2-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-short"]),
    ("CC-BY-4.0", ["cc-by4-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-short"]),
    ("Unlicense", ["unlicense"]),
]

# Licences that short notices name, by SPDX identifier, and the notices.
NAMES = {
    "0BSD": ["Zero-Clause BSD License", "0BSD License"], "AFL-3.0": ["Academic Free License v3.0", "Academic Free License 3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0 License"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License 1.1"], "Apache-2.0": ["Apache License 2.0", "Apache License Version 2.0", "Apache-2.0 License", "Apache 2.0 License"],
    "Artistic-2.0": ["Artistic License 2.0"], "BlueOak-1.0.0": ["Blue Oak Model License 1.0.0"], "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause License"], "BSD-3-Clause-Clear": ["BSD 3-Clause Clear License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "Original BSD License"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"], "BUSL-1.1": ["Business Source License 1.1"],
    "CC-BY-3.0": ["Creative Commons Attribution 3.0 License", "Creative Commons Attribution 3.0 Unported License", "CC BY 3.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License"], "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"], "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"],
    "CC-BY-SA-3.0": ["Creative Commons Attribution-ShareAlike 3.0 License", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 3.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"], "CC0-1.0": ["Creative Commons Zero v1.0 Universal License", "CC0 1.0 Universal", "CC0 1.0"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "CDDL 1.0"], "CECILL-2.1": ["CeCILL Free Software License Agreement v2.1", "CeCILL 2.1"], "CPL-1.0": ["Common Public License 1.0"],
    "ECL-2.0": ["Educational Community License v2.0"], "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License - v 1.0"], "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License - v 2.0"],
    "EUPL-1.1": ["European Union Public License 1.1", "European Union Public Licence 1.1"], "EUPL-1.2": ["European Union Public License 1.2", "European Union Public Licence 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, version 1.3", "GNU Free Documentation License v1.3"], "GPL-2.0": ["GNU General Public License v2.0", "GNU GPL version 2", "GPL-2.0 License", "GPLv2 License"],
    "GPL-3.0": ["GNU General Public License v3.0", "GNU GPL version 3", "GPL-3.0 License", "GPLv3 License"], "HPND": ["Historical Permission Notice and Disclaimer"], "ISC": ["ISC License"], "JSON": ["JSON License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1 License"], "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0 License"],
    "LPL-1.02": ["Lucent Public License v1.02"], "LPPL-1.3c": ["LaTeX Project Public License v1.3c"], "MIT": ["The MIT License", "MIT license (MIT)"], "MIT-0": ["MIT No Attribution License", "MIT-0 License"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, version 1.1"], "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0 License"],
    "MS-PL": ["Microsoft Public License"], "MS-RL": ["Microsoft Reciprocal License"], "MulanPSL-2.0": ["Mulan Permissive Software License, Version 2", "Mulan PSL v2"], "NCSA": ["University of Illinois/NCSA Open Source License"],
    "ODbL-1.0": ["Open Database License v1.0", "Open Data Commons Open Database License v1.0"], "OFL-1.1": ["SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"], "OSL-3.0": ["Open Software License 3.0"],
    "PDDL-1.0": ["Open Data Commons Public Domain Dedication and License 1.0"], "PHP-3.01": ["PHP License v3.01"], "PostgreSQL": ["PostgreSQL License"], "PSF-2.0": ["Python Software Foundation License 2.0"],
    "QPL-1.0": ["Q Public License 1.0"], "Ruby": ["Ruby License"], "SSPL-1.0": ["Server Side Public License v1"], "Unlicense": ["Unlicense", "The Unlicense"], "UPL-1.0": ["Universal Permissive License v1.0"], "Vim": ["Vim License"],
    "W3C": ["W3C Software Notice and License"], "WTFPL": ["Do What The F*ck You Want To Public License"], "X11": ["X11 License"], "Zlib": ["zlib License"], "ZPL-2.1": ["Zope Public License 2.1"],
}
NOTICES = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.", "Available under the {}.", "This project is licensed under the {}.",
    "This work is licensed under the {}.", "This work is licensed under {}.", "This work is licensed under a {}.", "This software is licensed under the {}.", "This code is released under the {}.",
    "This file is licensed under the {}.", "This program is licensed under the {}.", "The code is licensed under the {}.", "This software is distributed under the {}.",
]

#: Every known sentence holds one of these, so a text without them has none.
ANCHORS = (b"licen", b"copyright", b"software", b"warrant", b"redistribut")

FIELDS = T.StructType(
    [
        T.StructField("n_sentences", T.LongType()),
        T.StructField("sentence_ids", T.StringType()),
        T.StructField("licenses", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)

_UNIT = re.compile(r"(?:[^\n.!?;:]|[.!?;:](?=\S))+[.!?;:]?")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]*[A-Za-z0-9.+)])")
_SPDX_WORDS = {"AND", "OR", "WITH"}


def catalogue() -> tuple[dict[str, list[str]], list[tuple[str, list[str]]]]:
    """The sentences and rules above, and for each licence's names the notices that have an anchor, as one sentence and rule."""
    short = {f"{name}-named".lower(): [n.format(x) for x in names for n in NOTICES if any(a.decode() in n.format(x).lower() for a in ANCHORS)] for name, names in NAMES.items()}
    return SENTENCES | short, RULES + [(name, [f"{name}-named".lower()]) for name in NAMES]


def _normal(text: str) -> str:
    return b" ".join(ascii_words(text.encode("utf-8", "replace"))).decode("utf-8", "replace")


class _Places:
    """The places of each identifier in a sequence, and which of them are free."""

    def __init__(self, idents: list[str]):
        self.of: dict[str, list[int]] = {}
        self.rank = []
        for i, ident in enumerate(idents):
            own = self.of.setdefault(ident, [])
            self.rank.append((ident, len(own)))
            own.append(i)
        self.jump = {ident: list(range(len(own) + 1)) for ident, own in self.of.items()}

    def free(self, ident: str, after: int) -> int | None:
        """The first free place of the identifier from `after` on."""
        own, jump = self.of[ident], self.jump[ident]
        k = end = bisect_left(own, after)
        while jump[end] != end:
            end = jump[end]
        while jump[k] != end and k != end:
            jump[k], k = end, jump[k]
        return own[end] if end < len(own) else None

    def take(self, place: int) -> None:
        ident, k = self.rank[place]
        self.jump[ident][k] = k + 1


class Recogniser:
    """Known sentences by normalised text, the beginnings of them, and the rules, longest first."""

    def __init__(self, sentences: dict[str, list[str]] | None = None, rules: list | None = None, gap: int = 2):
        """Tables of one's own replace both of the module's."""
        if sentences is None:
            sentences, rules = catalogue()
        self.known = {_normal(s): ident for ident, ss in reversed(sentences.items()) for s in ss}
        self.starts = {" ".join(ws[:k]) for s in self.known for ws in [s.split(" ")] for k in range(1, len(ws))}
        self.rules = sorted(rules, key=lambda r: -len(r[1]))
        self.gap = gap
        if lost := [s for s in self.known if not any(a.decode() in s for a in ANCHORS)]:
            raise ValueError(f"no anchor is part of {lost[0]!r}")

    def sentences(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """(first unit, last unit, start, end, identifier) of each known sentence, longest from each unit."""
        units = [(m.start(), m.end(), w) for m in _UNIT.finditer(text) if (w := _normal(m[0]))]
        found, i = [], 0
        while i < len(units):
            words, last, j = "", None, i
            while j < len(units):
                words = f"{words} {units[j][2]}" if words else units[j][2]
                if words in self.known:
                    last = (i, j, units[i][0], units[j][1], self.known[words])
                if words not in self.starts:
                    break
                j += 1
            if last:
                found.append(last)
                i = last[1]
            i += 1
        return found

    def licences(self, found: list[tuple[int, int, int, int, str]]) -> list[tuple[int, int, str]]:
        """(start, end, licence) of each rule match; a sentence serves one match.

        The next free sentence of an identifier is looked up among its places, so a text takes time in
        proportion to its sentences however often they repeat.
        """
        places = _Places([f[4] for f in found])
        # Unknown units before each sentence: the difference between two is what lies between them.
        unknown, known = [], 0
        for first, last, *_ in found:
            unknown.append(first - known)
            known += last - first + 1
        out = []
        for name, rule in self.rules:
            if not all(ident in places.of for ident in rule):
                continue
            at = places.free(rule[0], 0)
            while at is not None:
                taken = [at]
                for ident in rule[1:]:
                    after = places.free(ident, taken[-1] + 1)
                    if after is None or unknown[after] - unknown[taken[-1]] > self.gap:
                        break
                    taken.append(after)
                if len(taken) == len(rule):
                    for k in taken:
                        places.take(k)
                    out.append((found[taken[0]][2], found[taken[-1]][3], name))
                at = places.free(rule[0], at + 1)
        return sorted(out)

    def row(self, data: bytes) -> tuple[int, str, str, str]:
        low = data.lower()
        if not any(a in low for a in ANCHORS):
            return 0, "", "", ""
        text = data.decode("utf-8", "replace")
        found = self.sentences(text)
        matches = self.licences(found)
        for m in _SPDX.finditer(text):
            for name in re.split(r"[\s()]+", m[1]):
                if name and name not in _SPDX_WORDS:
                    matches.append((m.start(), m.end(), name))
        matches.sort()
        return (
            len(found), ",".join(x[4] for x in found), ",".join(sorted({x[2] for x in matches})),
            ",".join(f"{name}:{a}:{b}" for a, b, name in matches),
        )


def _scanner(gap: int, sentences: dict | None, rules: list | None) -> Callable:
    known = Recogniser(sentences, rules, gap)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]

    def score(column: pa.Array) -> list[pa.Array]:
        rows = [known.row(t or b"") for t in utf8(column)]
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    return score


def scan(docs: DataFrame, text_col: str = "text", gap: int = 2, sentences: dict[str, list[str]] | None = None, rules: list | None = None) -> DataFrame:
    """docs with n_sentences, sentence_ids, licenses and spans (licence:start:end), in one pass without a shuffle.

    sentences: identifier -> the texts that have it; rules: (licence, identifiers in order).
    """
    return append_columns(docs, text_col, FIELDS, lambda: _scanner(gap, sentences, rules))


def licensed(docs: DataFrame, allowed: list[str], text_col: str = "text") -> DataFrame:
    """docs of which every recognised licence is allowed; documents without one stay."""
    names = F.filter(F.split("licenses", ","), lambda x: x != "")
    return kept_rows(docs, text_col, scan, F.size(F.array_except(names, F.array(*map(F.lit, allowed)))) == 0)
