from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np

from helixframe.llm import decontaminate, queries
from tests.oracle import same


def brute(text, items, n=10):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hit, found = set(), set()
    for ident, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if t else []
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == w[i : i + size]:
                    hit.update(range(p, p + size))
                    found.add(str(ident))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_query_matches_sql(spark, medium):
    same(queries.op10_decontamination(spark, medium), queries.SQL["op10_decontamination"], medium)


ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "Short Item"), (10, "short item"), (3, ""), (4, None), (None, "no id here"), (5, "café"),
]
TEXTS = [
    "x alpha beta gamma delta epsilon zeta eta theta iota kappa lambda y short, ITEM",
    "alpha beta gamma delta epsilon zeta eta theta iota", "CAFÉ café.short item item", "", None,
    "beta gamma delta epsilon zeta eta theta iota kappa lambda mu beta gamma delta epsilon zeta eta theta iota kappa lambda mu",
]


def test_brute_force_and_parts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = {i: brute(t, [x for x in ITEMS if x[0] is not None]) for i, t in enumerate(TEXTS)}
    for part_bytes in (decontaminate.PART_BYTES, 30):  # one broadcast, and several passes
        got = decontaminate.scan(docs, bench, part_bytes=part_bytes).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want


def test_repeated_windows_and_random_texts(spark):
    """Windows that many items and many places of a text share, and items shorter than a window."""
    rng = np.random.default_rng(6)
    words = ["aa", "b", "ccc", "dd", "é"]
    items = [(i, " ".join(rng.choice(words, rng.integers(0, 25)))) for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 120))) for _ in range(30)]
    windows = decontaminate.Windows(items, 4)
    scan = decontaminate.Scanner([windows])
    for t in texts:
        hit, found = scan(decontaminate.ascii_words(t.encode()))
        want = brute(t, items, 4)
        assert (int(hit.sum()), len(found)) == want[1:3]


def test_memory_of_a_part():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(50_000)]
    items = [(i, " ".join(rng.choice(words, 200))) for i in range(2000)]
    w = decontaminate.Windows(items, 10)
    assert len(pickle.dumps(w)) < 6 * sum(len(t) for _, t in items)


def test_removal(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, mode="spans").collect()}
    assert cut[0] == "x  y " and cut[1] == TEXTS[1] and cut[4] is None and cut[2] == "CAFÉ  item"  # adjacent hit words go with what is between them


def test_edges(spark, edges, no_docs):
    bench = spark.createDataFrame([(1, "same words here")], "item_id long, text string")
    rows = decontaminate.scan(edges, bench).collect()
    assert len(rows) == edges.count() and sum(r.contaminated for r in rows) == 3
    assert all(r.n_words == 0 for r in rows if not r.text)
    assert decontaminate.scan(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.scan(edges, bench.limit(0)).collect())
