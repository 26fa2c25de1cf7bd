from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import mixing, queries
from helixframe.llm.common import table


def plain_fit(tokens, post, targets, steps=mixing.MAX_STEPS, tolerance=mixing.TOLERANCE):
    """The same descent on whole arrays: rates, steps and the error that is shown to remain."""
    total = tokens.sum()
    inverse = lambda used: np.linalg.pinv((post[used] * tokens[used, None]).T @ post[used] / total, rcond=1e-12, hermitian=True)
    whole = inverse(tokens >= 0)
    rate, n, least, plain, squares, errors = np.ones(len(tokens)), 0, 0.0, False, [], []
    while True:
        residual = (tokens * rate) @ post / total - targets
        errors.append(np.abs(residual).max())
        best, stalled = np.inf, 0
        for e in errors:
            best, stalled = (e, 0) if e < 0.9 * best else (best, stalled + 1)
        if errors[-1] < tolerance or n >= steps or (plain and stalled >= mixing.STALL):
            return rate, n, least
        squares.append(residual @ whole @ residual)
        near = squares[:-1][-mixing.REMEMBERED :]
        move = (inverse(rate > 0) if not plain and (not near or squares[-1] <= max(near)) else whole) @ residual
        rate, n = np.maximum(0, rate - post @ move), n + 1
        raised = move - (post[tokens > 0] @ move).min()
        least = max(least, -(targets @ raised) / np.abs(raised).sum())
        if least > tolerance and not plain:
            plain, rate, errors = True, np.ones(len(tokens)), []


@pytest.mark.parametrize("targets", [[0.2, 0.3, 0.5], [0.9, 0.1, 0.0], [0.0, 0.0, 1.0]])
def test_rates_match_arrays_and_targets(spark, targets):
    rng = np.random.default_rng(2)
    post = rng.dirichlet([0.3, 0.3, 0.3], 300)
    tokens = rng.integers(0, 500, 300).astype(float)
    rows = spark.createDataFrame([(i, int(t), *map(float, p)) for i, (t, p) in enumerate(zip(tokens, post))], "i long, n_tokens long, p0 double, p1 double, p2 double")
    rated, report = mixing.fit_rates(rows, np.array(targets))
    got = np.array([r.rate for r in rated.orderBy("i").collect()])
    want, steps, least = plain_fit(tokens, post, np.array(targets))
    assert report["steps"] == steps and np.allclose(got, want, rtol=1e-4, atol=1e-6) and (got >= 0).all()
    assert report["least_error"] == pytest.approx(least, abs=1e-9) and report["met"] == (least <= mixing.TOLERANCE)
    if report["met"]:
        assert np.abs((tokens * got) @ post / tokens.sum() - targets).max() < mixing.TOLERANCE


@pytest.mark.parametrize("low, high, target", [(0.45, 0.55, 0.52), (0.48, 0.52, 0.505), (0.45, 0.55, 0.54), (0.45, 0.55, 0.549)])
def test_soft_posteriors_reach_their_targets(spark, low, high, target):
    """Posteriors that hardly differ, up to targets near the largest of them."""
    rows = spark.range(20_000, numPartitions=4).selectExpr("id", "1 + id % 500 AS n_tokens", f"{low} + {high - low} * (xxhash64(id) % 1000003 + 1000003) / 2000006 AS p0").withColumn("p1", 1 - F.col("p0"))
    rated, report = mixing.fit_rates(rows, np.array([target, 1 - target]))
    share = rated.agg(F.sum(F.col("n_tokens") * F.col("rate") * F.col("p0")) / F.sum("n_tokens"), F.min("rate")).first()
    assert report["met"] and report["error"] < 1e-4 and abs(share[0] - target) < 1e-4 and share[1] >= 0 and report["steps"] <= 20


def test_targets_out_of_reach_are_shown_to_be(spark):
    """No mix of posteriors of at most 0.55 has a share of 0.6; the error that remains is at least 0.05."""
    rows = spark.range(2000, numPartitions=4).selectExpr("id", "10L AS n_tokens", "0.45 + 0.1 * id / 1999 AS p0").withColumn("p1", 1 - F.col("p0"))
    _, report = mixing.fit_rates(rows, np.array([0.6, 0.4]))
    assert not report["met"] and 0.0499 < report["least_error"] <= 0.0501 and report["steps"] < mixing.MAX_STEPS
    _, report = mixing.fit_rates(rows, np.array([0.549, 0.451]))
    assert report["met"] and report["least_error"] == 0


def test_hundreds_of_domains(spark):
    rng = np.random.default_rng(1)
    k, post = 150, rng.dirichlet([0.05] * 150, 600)
    rows = spark.createDataFrame([(10, *map(float, p)) for p in post], ", ".join(["n_tokens long", *[f"p{j} double" for j in range(k)]]))
    goal = 0.5 * post.mean(axis=0) + 0.5 * post[:300].mean(axis=0)
    rated, report = mixing.fit_rates(rows, goal)
    assert report["met"] and rated.count() == 600


def test_query_meets_its_targets(spark, medium):
    rows = queries.op4_mixing(spark, medium).toPandas()
    post, expected = np.stack(rows.posterior.values), rows.expected_tokens.values
    model = sorted(queries.MIX_TARGETS)
    share = dict(zip(model, expected @ post / rows.n_tokens.sum()))
    assert len(rows) == table(spark, medium, "documents").count()
    assert all(abs(share[k] - v) < 0.002 for k, v in queries.MIX_TARGETS.items())


def test_domains_on_held_out_documents(spark, medium):
    docs = table(spark, medium, "documents")
    labelled = mixing.language_quality(docs, table(spark, medium, "labels"))
    model = mixing.train(docs, labelled)
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    got = mixing.posteriors(docs, model).withColumn("guess", F.element_at(F.array(*map(F.lit, model.domains)), best))
    held = got.join(labelled, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert held.filter("guess = domain").count() >= 0.8 * held.count()


def test_edges(spark, edges, no_docs):
    labelled = spark.createDataFrame([(4, "a"), (5, "b"), (6, "b"), (7, None), (None, "a"), (8, "a")], "doc_id long, domain string")
    got = mixing.mix(edges, labelled, {"a": 1.0, "b": 1.0, "absent": 2.0}).collect()
    assert len(got) == edges.count()
    assert all(r.n_tokens == 0 and r.expected_tokens == 0 for r in got if r.doc_id in (1, 2))
    assert len({r.rate for r in got if r.doc_id in (5, 6)}) == 1
    nothing = mixing.mix(edges, labelled.limit(0), {"a": 1.0}).collect()
    assert all(r.rate == 1.0 and r.domain is None and r.posterior == [] for r in nothing)
    assert mixing.mix(no_docs, labelled, {"a": 1.0}).count() == 0


def test_domains_without_a_target_keep_their_share(spark, caplog):
    rows = spark.createDataFrame([(i, 10, float(i % 4 == 0), float(i % 4 == 1), float(i % 4 > 1)) for i in range(40)], "i long, n_tokens long, p0 double, p1 double, p2 double")
    rated, report = mixing.fit_rates(rows, np.array([0.9, 0.1, np.nan]))
    got = {r.i % 4: r.rate for r in rated.collect()}
    assert report["met"] and np.allclose([got[k] for k in range(4)], [1.8, 0.2, 1, 1], atol=1e-3)


def test_a_rare_domain_reaches_its_target(spark):
    """One document of 20,000, a share of 5e-5, is raised to a tenth."""
    rows = spark.range(20_000).selectExpr("id", "10L n_tokens", "if(id = 7, 1D, 0D) p0", "if(id = 7, 0D, 1D) p1")
    _, report = mixing.fit_rates(rows, np.array([0.1, 0.9]))
    assert report["met"] and report["steps"] < 20


def test_missed_targets_are_told(spark, edges, caplog):
    """A warning if, and only if, the shares of the result miss the targets."""
    labelled = spark.createDataFrame([(i, d) for i, d in ((3, "a"), (4, "a"), (5, "b"), (6, "b"), (7, "b"), (8, "a"))], "doc_id long, domain string")
    rows = mixing.mix(edges, labelled, {"a": 0.0, "b": 1.0}).collect()
    total = sum(r.n_tokens for r in rows)
    share = [sum(r.expected_tokens * r.posterior[k] for r in rows) / total for k in (0, 1)]
    assert ("targets are not met" in caplog.text) == (max(share[0], abs(share[1] - 1)) > 1.1 * mixing.TOLERANCE)


def test_targets_of_texts_that_are_all_alike(spark, caplog):
    """Equal texts have equal posteriors: no rates tell their domains apart."""
    docs = spark.createDataFrame([(i, "the very same words") for i in range(20)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "doc_id long, domain string")
    rows = mixing.mix(docs, labelled, {"a": 0.9, "b": 0.1}).collect()
    assert "targets are not met" in caplog.text and len({r.rate for r in rows}) == 1 and rows[0].rate == pytest.approx(1, abs=1e-3)


def test_posteriors_against_plain_code(spark):
    """Features and softmax of each text, one by one with dictionaries, against the operator's arrays."""
    import zlib

    rows = [("Ein Haus, ein Baum! 42", "a"), ("ein ein haus", "a"), ("THE tree is green", "b"), ("tree tree 7?", "b"), ("naïve ÉTÉ", "b")]
    model = mixing.fit_domains([(t.encode(), d) for t, d in rows])

    def shape(t):
        core = t.strip(".,;:!?")
        marks = len(t) - len(t.rstrip("!?*$%&#"))
        case = 0 if not any(map(str.isalpha, core)) else 1 if core.islower() else 2 if core.isupper() and len(core) > 1 else 3
        return (case * 3 + min(marks, 2)) * 2 + any(map(str.isdigit, core))

    def plain(text):
        x, words = np.zeros(mixing.Features.width), text.split()
        for w in words:
            low = "".join(c if c.isalnum() else " " for c in w.lower()).strip()
            x[zlib.crc32(low.encode()) % mixing.LEXICAL] += 1 / len(words)
            x[mixing.LEXICAL + shape(w)] += 1 / len(words)
        x, n = np.sqrt(x), max(1, len(words))
        same = sum(a == b for a, b in zip(words, words[1:]))
        x[-mixing.DENSE:] = [same / n, len(set(words)) / n, np.log1p(len(words)) / 8, len(text.encode()) / n / 10, text.count("\n") / n]
        z = (x - model.centre) / model.scale @ model.weights + model.bias
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    texts = [t for t, _ in rows] + ["", "Haus\nBaum 3", "unbekannt!!"]
    got = mixing.posteriors(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    for r in got:
        assert np.allclose(r.posterior, plain(r.text), atol=1e-4) and r.n_tokens == len(r.text.split()), r.text


def test_copies_keep_the_mean(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "1.3D as rate")
    got = mixing.copies(rows).agg(F.avg("copies"), F.min("copies"), F.max("copies")).first()
    assert abs(got[0] - 1.3) < 0.03 and (got[1], got[2]) == (1, 2)
