from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = "der lange text mit vielen worten und noch mehr " * 4000

EDGE_ROWS = [
    (1, None, "en", "s", None),
    (2, "", None, None, 0),
    (3, "12345 --- !!! \n\t 0", "de", "s", 20),
    (4, LONG, "de", "s", len(LONG)),
    (5, "same words here again and again", "en", "s", 31),
    (5, "same words here again and again", "en", "s", 31),
    (6, "same words here again and again", "en", "s", 31),
    (None, "a row without an id", "en", "s", 19),
    (7, "İstanbul Été 中文 \U0001f600 naïve", "fr", "s", 30),
    (8, "one", "en", None, 3),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with nulls, empty and long texts, ties and repeats, and columns named like results and work columns."""
    docs = spark.createDataFrame(EDGE_ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "held_out", "lang_pred", "spans", "n_words", "class_id", "rate", "posterior", "key", "node", "path", "t", "l", "i"):
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(edges):
    return edges.limit(0)
