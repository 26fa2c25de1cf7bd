from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.llm import ann, queries
from helixframe.llm.common import table
from tests.oracle import same


def brute(ids, x, every=20, k=20):
    rows = []
    for i, q in zip(ids, x):
        if i % every == 0:
            scored = sorted((-float(ann.exact(q, c[None])[0]), j) for j, c in zip(ids, x) if j != i)
            rows += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return rows


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")


def test_query_matches_sql(spark, medium):
    same(queries.op5_nearest(spark, medium), queries.SQL["op5_nearest"], medium)


@pytest.mark.parametrize("cells", [(ann.CANDIDATE_CELLS, ann.QUERY_CELLS, ann.ESTIMATES), (64 * 64, 3 * 64, 100)])
def test_recall_against_brute_force(spark, small, monkeypatch, cells):
    for name, value in zip(("CANDIDATE_CELLS", "QUERY_CELLS", "ESTIMATES"), cells):
        monkeypatch.setattr(ann, name, value)
    e = table(spark, small, "embeddings").toPandas()
    x = np.stack(e.embedding.values).astype(float)
    truth = pd.DataFrame(brute(e.vec_id, x), columns=["query_id", "rank", "vec_id", "score"])
    got = ann.nearest(table(spark, small, "embeddings")).toPandas()
    assert ann.recall(got, truth) >= 0.99
    assert len(got) == len(truth) and (got.groupby("query_id").size() == 20).all()


def test_estimate_is_within_its_bound():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((500, 64)), rng.standard_normal(64)
    rot = ann.rotation(64)
    code, norm, own = ann.encode(x, rot)
    signs = np.unpackbits(code, axis=1) * 2.0 - 1
    bits = rot.shape[1]
    guess = signs @ (q @ rot) * norm / (own * math.sqrt(bits))
    spread = norm * np.sqrt(1 - own**2) / own / math.sqrt(bits - 1) * np.linalg.norm(q)
    off = np.abs(guess - x @ q) / spread
    assert (off <= ann.EPSILON).all() and abs(np.mean((guess - x @ q) / spread)) < 0.2


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
        (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (20, [0.0, 2.0]), (2, [0.5, 0.5]), (40, None), (10, [-1.0, -1.0]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.nearest(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == {
        0: [(1, 1, 0.5), (2, 2, 0.5), (3, 2, 0.5), (4, 20, 0.0), (5, 10, -1.0)],
        20: [(1, 1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 0, 0.0), (5, 10, -2.0)],
    }
    assert ann.nearest(vectors.limit(0)).count() == 0
    assert ann.nearest(vectors.filter("vec_id = 0")).count() == 0


def test_many_equal_vectors(spark):
    x = np.concatenate([np.ones((300, 8)), np.eye(8)])
    got = ann.nearest(frame(spark, range(308), x)).filter("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21))


def test_repeated_ids_are_candidates_each(spark):
    """Every row but those of the query's own id is a candidate; one query an id."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [1.0, 3.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (3, [0.0, -1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    asked = max(np.array(v).tobytes() for i, v in rows if i == 0)
    q = np.frombuffer(asked)
    want = sorted(((-float(q @ np.array(v)), i) for i, v in rows if i != 0))
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, k, i, -s) for k, (s, i) in enumerate(want, 1)]


def test_one_id_on_a_third_of_the_rows_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_CELLS", 8 * 16)
    rng = np.random.default_rng(5)
    ids, x = [5] * 100 + list(range(100, 300)), rng.standard_normal((300, 8))
    index = ann.build_index(frame(spark, ids, x)).cache()
    blocks = index.filter("vec_id = 5").select(ann.block_of(1, 19).alias("b")).groupBy("b").count().collect()
    assert len(blocks) == 19 and max(r["count"] for r in blocks) < 20
    got = ann.search(index, F.col("vec_id") == 100, 20).toPandas()
    x = x.astype(np.float32).astype(float)
    want = sorted((-float(x[100] @ v), i) for i, v in zip(ids, x) if i != 100)[:20]
    assert list(got.sort_values("rank").vec_id) == [i for _, i in want]
