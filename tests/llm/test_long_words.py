"""Texts that are one very long word go through every text operator."""

from __future__ import annotations

import pytest

from helixframe.llm import decontaminate, jaccard, language_id, licenses, mixing, secrets, toxicity

LONG = "abcdefghij" * 30_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en"), (2, LONG, "en"), (3, "é" * 150_001, "fr"), (4, "the cat and the dog", "en"), (5, "=" * 200_000, None), (6, "a:" * 100_000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(docs):
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(rows) == 6 and rows[5].lang_pred == "und"
    words = language_id.words_of(("é" * 150_001).encode())
    assert max(len(w.decode()) for w in words) == language_id.MAX_WORD_CHARS == 100 and b"".join(words).decode() == "é" * 150_001


def test_near_copies(docs):
    rows = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()}
    assert rows[1] == rows[2] == (1, 1) and rows[3] == (3, 0) and rows[5] == (5, 0)


def test_scans(spark, docs):
    assert secrets.scan(docs).count() == licenses.scan(docs).count() == 6
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    hit = {r.doc_id: r.contaminated for r in decontaminate.scan(docs, bench).collect()}
    assert [k for k, v in hit.items() if v] == [1, 2]


def test_classifiers(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    assert toxicity.judge(docs, labels).count() == 6
    domains = spark.createDataFrame([(1, "x"), (2, "y"), (4, "x")], "doc_id long, domain string")
    assert mixing.mix(docs, domains, {"x": 0.5, "y": 0.5}).count() == 6
