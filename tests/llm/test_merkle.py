"""The manifest against a plain tree, SQL, and the laws of the monoid."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import merkle, queries
from helixframe.llm.common import table
from tests.oracle import same


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root and each leaf's siblings before and after it, by definition."""
    paths: list[list] = [[] for _ in nodes]
    owner = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, owners = [], []
        for lo in range(0, len(nodes), arity):
            run = nodes[lo : lo + arity]
            for k, leaves in enumerate(owner[lo : lo + arity]):
                for i in leaves:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            owners.append([i for x in owner[lo : lo + arity] for i in x])
        nodes, owner = up, owners
    return nodes[0], paths


def brute(rows, arity=2):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of rows doc_id, source, lang, n_chars, text."""
    groups = defaultdict(list)
    for doc, source, lang, n, text in rows:
        own = leaf(doc, source, lang, n, text)
        bad = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n is not None
        groups[(lang is not None, (lang or "").encode())].append(((doc is not None, doc or 0), own, leaf(doc, source, lang, n + 1, text) if bad else own))
    made = {k: (sorted(v), tree([x[1] for x in sorted(v)], arity)) for k, v in groups.items()}
    keys = sorted(made)
    root, tops = tree([made[k][1][0] for k in keys], arity) if keys else (None, [])
    out = []
    for k, top in zip(keys, tops):
        leaves, (subroot, paths) = made[k]
        for ((there, doc), own, claimed), path in zip(leaves, paths):
            end = claimed
            for a, b in path + top:
                end = h(a, end, b)
            out.append((doc if there else None, own, subroot, root, h(*[a + b for a, b in path + top]), end, end == root))
    return out


def shown(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_against_sql(spark, medium):
    got = queries.op11_merkle_manifest(spark, medium)
    same(got, queries.SQL["op11_merkle_manifest"], medium)
    assert 0 < got.filter("not verified").count() < got.count() / 4


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_against_a_plain_tree(spark, small, arity, monkeypatch):
    """Spans of a few nodes, so that trees take several rounds, and other arities."""
    monkeypatch.setattr(merkle, "SPAN", arity**2)
    docs = table(spark, small, "documents")
    changed = [merkle.F.col(c) + 1 if c == "n_chars" else merkle.F.col(c) for c in merkle.DOCUMENT_FIELDS]
    claimed = merkle.F.when(merkle.F.crc32(merkle.F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf_of(changed))
    made = merkle.build(docs, claimed=claimed, arity=arity)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert shown(made.rows()) == sorted(map(str, brute(rows, arity)))


def test_a_large_tree(spark):
    """More leaves than a span of 1,024 holds twice over, over many partitions, in one group."""
    docs = spark.range(2500).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "id % 50 AS n_chars", "concat('text ', id) AS text").repartition(7)
    made = merkle.documents_manifest(docs)
    assert shown(made.rows()) == sorted(map(str, brute([tuple(r) for r in docs.collect()])))
    assert made.subroots.collect()[0].size == 2500
    for r in made.proofs().filter("doc_id % 500 = 3").collect():
        assert merkle.folded(r.leaf, r.path) == made.root and len(r.path) == 12


def test_edges(spark, edges, no_docs):
    made = merkle.documents_manifest(edges)
    rows = [tuple(r) for r in edges.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert shown(made.rows()) == sorted(map(str, brute(rows)))
    empty = merkle.documents_manifest(no_docs)
    assert empty.root is None and empty.rows().count() == 0 and empty.subroots.count() == 0
    one = merkle.documents_manifest(edges.filter("doc_id = 8"))
    assert [r.leaf for r in one.rows().collect()] == [one.root]


def test_groups_of_other_scripts_and_repeats(spark):
    """Groups ordered by bytes, null first, and a third of all rows equal throughout."""
    rows = [(i, "s", g, 1, "t") for i, g in enumerate(["", "é", "z", "Z", "=", "-", None, "\U0001f600", "￿"])] + [(50, "s", "en", 3, "same")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert shown(merkle.documents_manifest(docs).rows()) == sorted(map(str, brute(rows)))


def test_a_changed_field_changes_the_root(spark):
    def root(text):
        return merkle.documents_manifest(spark.createDataFrame([(1, "s", "en", 2, "ab"), (2, None, "en", 1, text)], "doc_id long, source string, lang string, n_chars long, text string")).root

    assert len({root("c"), root("d"), root(""), root(None)}) == 4
    assert leaf(1, "23:", None) != leaf(1, "23", ":") and leaf("-") != leaf(None)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(2, 4), st.integers(1, 6), st.randoms(use_true_random=False))
def test_the_sum_of_fragments_does_not_depend_on_its_order(n, arity, parts, rng):
    leaves = [h(str(i)) for i in range(n)]
    where = [rng.randrange(parts) for _ in leaves]
    fragments = []
    for p in range(parts):
        f = merkle.Fragment(arity)
        for i, x in enumerate(leaves):
            if where[i] == p:
                f.add("t", n, 0, i, x)
        fragments.append(f.settle(99))
    while len(fragments) > 1:
        a = fragments.pop(rng.randrange(len(fragments)))
        fragments[rng.randrange(len(fragments))].merge(a, 99)
    assert [x[4] for x in fragments[0].nodes()] == [tree(leaves, arity)[0]]


def test_contiguous_fragments_stay_small():
    f = merkle.Fragment()
    for i in range(1000, 9000):
        f.add("t", 20_000, 0, i, "x")
    assert len(list(f.settle(99).nodes())) <= 2 * 15
    with pytest.raises(ValueError):
        f.add("t", 20_000, 0, 1, "y")
        f.add("t", 20_000, 0, 1, "z")
