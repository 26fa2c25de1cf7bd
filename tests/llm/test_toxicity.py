from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import queries, toxicity
from helixframe.llm.common import table


def test_marginals_match_enumeration():
    """Forward-backward against the sum over all labellings, for chains of several lengths in two documents."""
    rng = np.random.default_rng(1)
    ids = np.array([2, 3, 1, 4, 5, 6, 7, 0, 8, 1, 1, 9, 2, 3])
    docs = np.array([0] * 10 + [1] * 4)
    chains = toxicity.Chains(ids, docs)
    emission, start, move = rng.normal(size=10), rng.normal(size=2), rng.normal(size=(2, 2))
    got, fwd, bwd = chains.marginals(emission, start, move)
    pairs = np.zeros((2, 2))
    want = np.zeros(10)
    for a, n in zip(chains.starts, chains.lengths):
        weights, total = {}, 0.0
        for y in itertools.product((0, 1), repeat=int(n)):
            s = start[y[0]] + sum(emission[a + i] * v for i, v in enumerate(y)) + sum(move[p, q] for p, q in zip(y, y[1:]))
            weights[y] = math.exp(s)
            total += weights[y]
        for y, w in weights.items():
            want[a : a + n] += np.array(y) * w / total
            for p, q in zip(y, y[1:]):
                pairs[p, q] += w / total
    assert np.allclose(got, want)
    assert np.allclose(chains.moves(emission, move, fwd, bwd), pairs)
    assert sorted(chains.lengths) == [2, 3, 5]


def test_chains_break_at_sentences_documents_and_length():
    assert list(toxicity.Chains(np.full(300, 5), np.zeros(300, int)).lengths) == [128, 128, 44]
    assert list(toxicity.Chains(np.array([5, 1, 5, 5, 5]), np.array([0, 0, 0, 0, 1])).lengths) == [2, 1, 1]
    assert len(toxicity.Chains(np.zeros(3, int), np.zeros(3, int)).starts) == 0


def planted(n=400):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(5, 60)))
        bad = i % 4 == 0
        if bad:
            for w in rng.choice(["scumbag", "vileone", "grubber"], 2):
                text.insert(int(rng.integers(0, len(text))), f"{w}{rng.choice(['', 's', 'ly'])}")
        rows.append((i, " ".join(text) + ".", int(bad)))
    return rows


def test_held_out_documents_and_spans(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    truth = {i: (t, y) for i, t, y in rows}
    got = toxicity.judge(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and 40 < len(held) < 130
    assert all(r.predicted == truth[r.doc_id][1] for r in held)
    for r in held:
        text = truth[r.doc_id][0]
        found = {text[a:b][:5] for a, b in r.spans}
        assert found <= {"scumb", "vileo", "grubb"} and bool(found) == bool(truth[r.doc_id][1])


def test_english_words_of_the_tables_are_found(spark, medium):
    got = queries.op6_toxicity(spark, medium)
    labels = table(spark, medium, "labels")
    docs = table(spark, medium, "documents").filter("lang = 'en'").select("doc_id")
    en = got.join(labels, "doc_id").join(docs, "doc_id").filter("held_out")
    assert en.filter("predicted = toxic").count() >= 0.95 * en.count()


def test_labels_of_held_out_documents_are_not_used(spark):
    rows = planted(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda frame: [(r.doc_id, r.score) for r in frame.orderBy("doc_id").collect()]
    assert key(toxicity.judge(docs, labels)) == key(toxicity.judge(docs, flipped))


@pytest.mark.parametrize("kind", ["none", "one class", "nulls"])
def test_nothing_to_learn(spark, edges, no_docs, kind):
    rows = {"none": [], "one class": [(4, 1), (5, 1)], "nulls": [(4, None), (None, 1)]}[kind]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = toxicity.judge(edges, labels).collect()
    assert len(got) == edges.count() and all((r.score, r.predicted) == (0.0, 0) for r in got)
    assert toxicity.judge(no_docs, labels).count() == 0


def test_edges_with_a_model(spark, edges):
    model = toxicity.fit([(t.encode(), y) for _, t, y in planted()], set(map(toxicity.feature_key, (b"pscumba", b"pvileon", b"pgrubbe"))))
    got = {r.doc_id: r for r in toxicity.score_documents(edges, model).collect()}
    assert all(0 <= r.score < 0.5 and r.predicted == 0 for r in got.values())
    assert got[1].score == got[2].score  # no words at all


def test_recall_of_each_language(spark):
    """A language with 2 % of the toxic documents, too few of which are sampled to show its words."""
    rng = np.random.default_rng(8)
    words = {"en": [f"word{i}" for i in range(300)], "xx": [f"palabra{i}" for i in range(300)]}
    bad = {"en": ["scumbag", "vileone", "grubber"], "xx": ["zopenco", "mugroso", "canalla"]}
    rows = []
    for i in range(9000):
        toxic, lang = int(i % 3 == 0), "xx" if i % 150 < 3 else "en"
        text = list(rng.choice(words[lang], 12)) + (list(rng.choice(bad[lang], 2)) if toxic else [])
        rows.append((i, " ".join(rng.permutation(text)), toxic, lang))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    got = toxicity.judge(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).join(frame.drop("text"), "doc_id")
    held = got.filter("held_out").groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("marked")).collect()
    assert len(held) == 4
    for r in held:
        assert r.n >= 5 and r.marked == (r.n if r.toxic else 0), r


def plain_seeds(rows):
    """Seeds by sets: near copies by their least triple of words, features of each document, evidence and ratio."""
    import zlib

    def words(t):
        return [w for w in re.split(r"[^a-z0-9\u0080-\uffff]+", t.lower()) if w]

    def named(w):
        return {"w" + w} | {"p" + w[:k] for k in (3, 4, 5, 6) if len(w) > k}

    toxic, other = {}, []
    for t, y in rows:
        ws = words(t)
        found = set().union(*map(named, ws)) if ws else set()
        if y:
            key = min((zlib.crc32(" ".join(ws[i : i + 3]).encode()) for i in range(max(1, len(ws) - 2))), default=0)
            toxic.setdefault(key, set()).update(found)
        else:
            other.append(found)
    features = set().union(*toxic.values())
    hits = {f: sum(f in d for d in toxic.values()) for f in features}
    misses = {f: sum(f in d for d in other) for f in features}
    good = {f: h for f, h in hits.items() if h / len(toxic) >= 20 * (misses[f] + 0.5) / len(other)}
    least = min((math.log(len(features)) + 4) / math.log((len(toxic) + len(other)) / len(toxic)), max(good.values(), default=0))
    return {toxicity.feature_key(f.encode()) for f, h in good.items() if h >= least and h > 1}


@pytest.mark.parametrize("n", [40, 400])
def test_seeds_against_sets(spark, n):
    rows = [(t, y) for _, t, y in planted(n)] + [("", 0), ("scumbag", 1), ("scumbag", 1)]
    frame = spark.createDataFrame([(t, y) for t, y in rows], "__t string, __y int")
    want = plain_seeds(rows)
    assert toxicity.count_seeds(frame) == want and want


def test_few_labels_teach_unmistakable_words(spark):
    """12 labelled toxic documents of 60, each with the same word, are enough for that word."""
    rng = np.random.default_rng(9)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join([*rng.choice(words, 15), *(["scumbag"] if i % 5 == 0 else [])]), int(i % 5 == 0)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = toxicity.judge(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()
    assert all(r.predicted == rows[r.doc_id][2] for r in got)


def test_gradient_is_that_of_the_likelihood():
    """What fit() descends along, against differences of the chains' log likelihood."""
    rng = np.random.default_rng(2)
    chains = toxicity.Chains(rng.integers(2, 9, 12), np.repeat([0, 1, 2], [5, 1, 6]))
    gold, emission, start, move = rng.integers(0, 2, 12), rng.normal(size=12), rng.normal(size=2), rng.normal(size=(2, 2))

    def loss(e, s, m):
        total = 0.0
        for a, n in zip(chains.starts, chains.lengths):
            score = lambda y: s[y[0]] + sum(e[a + i] * v for i, v in enumerate(y)) + sum(m[p, q] for p, q in zip(y, y[1:]))
            total += math.log(sum(math.exp(score(y)) for y in itertools.product((0, 1), repeat=int(n)))) - score(tuple(gold[a : a + n]))
        return total

    marginal, fwd, bwd = chains.marginals(emission, start, move)
    step = 1e-6
    slope = [(loss(emission + step * np.eye(12)[i], start, move) - loss(emission, start, move)) / step for i in range(12)]
    assert np.allclose(marginal - gold, slope, atol=1e-4)
    pairs = chains.moves(emission, move, fwd, bwd)
    for p, q in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[p, q] = step
        inner = np.flatnonzero(~chains.first)
        had = sum(gold[i - 1] == p and gold[i] == q for i in inner)
        assert abs((loss(emission, start, move + d) - loss(emission, start, move)) / step - (pairs[p, q] - had)) < 1e-4


def test_many_words_and_spans_of_a_long_text(spark):
    model = toxicity.fit([(t.encode(), y) for _, t, y in planted()], set(map(toxicity.feature_key, (b"pscumba", b"pvileon", b"pgrubbe"))))
    text = "word1 word2 word3. " * 30_000 + "scumbag"
    row = toxicity.score_documents(spark.createDataFrame([(text,)], "text string"), model).first()
    assert row.predicted == 1 and [text[a:b] for a, b in row.spans] == ["scumbag"]


def test_repeated_ids_are_learned_from_once(spark):
    """One labelled id on many rows adds one text to the sample."""
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(3000)] + [(2, "x y z")], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, 1), (2, 0)], "__id long, __y int")
    from helixframe.llm.common import texts_of

    assert sorted(tuple(r) for r in texts_of(docs, chosen, "doc_id", "text", "__y").collect()) == [(1, 1, "text number 0"), (2, 0, "x y z")]
