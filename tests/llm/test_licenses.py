from __future__ import annotations

import random
import time

import pytest

from helixframe.llm import licenses, queries
from helixframe.llm.common import table

APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def mit() -> str:
    return "\n".join(licenses.SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability"))


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Released under the MIT License.", "MIT"), ("words before. Licensed under CC BY-NC 4.0. words after", "CC-BY-NC-4.0"),
        ("the Released under the MIT License.", ""), (APACHE, "Apache-2.0"), (mit(), "MIT"), ("", ""), ("No licence here, only software.", ""),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", "Apache-2.0,MIT"),
        ("Licensed under the\n  * Apache License, Version 2.0.\nReleased under the MIT License.", "Apache-2.0,MIT"),
        (licenses.SENTENCES["mit-grant"][0], ""),  # one sentence of a rule of several is no licence
    ],
)
def test_rules(text, names):
    assert licenses.Recogniser().row(text.encode())[2] == names


def test_order_and_gap():
    known = licenses.Recogniser()
    parts = [licenses.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
    assert known.row("\n".join(parts).encode())[2] == "BSD-2-Clause"
    assert known.row("\n".join(reversed(parts)).encode())[2] == ""
    far = f"{parts[0]}\none. two. three. four.\n{parts[1]}\n{parts[2]}"
    assert known.row(far.encode())[2] == ""


def test_longest_rule_takes_its_sentences():
    row = licenses.Recogniser().row(APACHE.encode())
    assert row[0] == 5 and row[3].count("Apache-2.0") == 1
    start, end = map(int, row[3].split(":")[1:])
    assert APACHE[start:end].startswith("# Licensed") and APACHE[start:end].endswith("under the License.")


def test_planted_lines_are_all_found(spark, medium):
    """The tables' licence lines against a plain search for them."""
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    texts = {r.doc_id: r.text for r in table(spark, medium, "documents").collect()}
    for r in queries.op3_license_scans(spark, medium).collect():
        assert r.licenses == ",".join(sorted({v for k, v in lines.items() if k in texts[r.doc_id]}))


def brute(text: str, sentences: dict, rules: list, gap: int = 2):
    """sentence_ids, licences and spans by trying every run of units and every sequence of sentences."""
    units = [(m.start(), m.end(), w) for m in licenses._UNIT.finditer(text) if (w := licenses._normal(m[0]))]
    known = {}
    for ident, texts in sentences.items():
        for t in texts:
            known.setdefault(licenses._normal(t), ident)
    found, i = [], 0
    while i < len(units):
        runs = [j for j in range(i, min(len(units), i + 12)) if " ".join(u[2] for u in units[i : j + 1]) in known]
        if runs:
            found.append((i, runs[-1], known[" ".join(u[2] for u in units[i : runs[-1] + 1])]))
            i = runs[-1]
        i += 1
    named = {k for a, b, _ in found for k in range(a, b + 1)}
    used, out = set(), []
    for name, rule in sorted(rules, key=lambda r: -len(r[1])):
        for start in range(len(found)):
            chosen = []
            for ident in rule:
                at = next((k for k in range(chosen[-1] + 1 if chosen else start, len(found)) if k not in used and found[k][2] == ident), None)
                if at is None or (not chosen and at != start) or (chosen and sum(u not in named for u in range(found[chosen[-1]][1] + 1, found[at][0])) > gap):
                    break
                chosen.append(at)
            if len(chosen) == len(rule):
                used |= set(chosen)
                out.append((units[found[chosen[0]][0]][0], units[found[chosen[-1]][1]][1], name))
    return ",".join(f[2] for f in found), ",".join(sorted({x[2] for x in out})), ",".join(f"{n}:{a}:{b}" for a, b, n in sorted(out))


def test_sequences_against_trying_all(spark):
    """Random sequences of known sentences, whole and wrapped, with other words between them, under the real rules and small ones."""
    rng = random.Random(5)
    sentences, rules = licenses.catalogue()
    small = {"a": ["licence one"], "b": ["licence two"], "c": ["licence one two three"]}
    few = [("X", ["a", "b", "a"]), ("Y", ["a", "b"]), ("Z", ["b"]), ("W", ["c", "a"])]
    for k in range(300):
        table_, rule = (sentences, rules) if k % 2 else (small, few)
        idents = [rng.choice([i for _, r in licenses.RULES[:12] for i in r]) if k % 2 else rng.choice("abc") for _ in range(rng.randrange(1, 14))]
        parts = []
        for ident in idents:
            text = rng.choice(table_[ident])
            parts.append(text.replace(" ", "\n * ", 1) if rng.random() < 0.2 else text)
            parts += ["some other words."] * rng.choice([0, 0, 0, 1, 2, 3])
        text = "\n".join(parts)
        got = licenses.Recogniser(table_, rule).row(text.encode())
        assert got[1:] == brute(text, table_, rule), text


def test_documents_against_trying_all(spark, medium):
    sentences, rules = licenses.catalogue()
    texts = {r.doc_id: r.text or "" for r in table(spark, medium, "documents").collect()}
    for r in queries.op3_license_scans(spark, medium).filter("n_sentences > 0").collect():
        assert (r.sentence_ids, r.licenses, r.spans) == brute(texts[r.doc_id], sentences, rules)


def test_many_repeats_take_linear_time():
    known, line = licenses.Recogniser(), licenses.SENTENCES["mit-grant"][0] + "\n"
    times = []
    for n in (1000, 8000):
        began = time.perf_counter()
        assert known.row((line * n).encode())[0] == n
        times.append(time.perf_counter() - began)
    assert times[1] < 30 * times[0]


def test_notices_of_many_licences():
    known = licenses.Recogniser()
    assert len(licenses.NAMES) >= 60
    for text, name in (("This project is licensed under the BSD 3-Clause License.", "BSD-3-Clause"), ("// Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
                       ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("This file is licensed under the Mozilla Public License, v. 2.0.", "MPL-2.0")):
        assert known.row(text.encode())[2] == name
    own = licenses.Recogniser({"x": ["house licence one"]}, [("House", ["x"])])
    assert own.row(b"House Licence One")[2] == "House" and own.row(b"Released under the MIT License.")[2] == ""


def test_edges(spark, edges, no_docs):
    rows = licenses.scan(edges).collect()
    assert len(rows) == edges.count() and all(r.n_sentences == 0 for r in rows)
    assert licenses.scan(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "Licensed under CC BY-NC 4.0."), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in licenses.licensed(docs, ["MIT"]).orderBy("doc_id").collect()] == [1, 3]
