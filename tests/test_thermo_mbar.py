from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.lcg import CLUSTER_SEED, Lcg
from helixframe.operators import mbar, thermo
from helixframe.sources.umbrella import window_table
from tests.builders import values


def test_generator_wraps_at_64_bits():
    g = Lcg(CLUSTER_SEED)
    state = CLUSTER_SEED
    for _ in range(5):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        assert g.unit() == (state >> 11) / 2**53


def points(spark, seed=0, n=90):
    rng = np.random.default_rng(seed)
    at = np.concatenate([rng.normal(c, 0.2, (n // 3, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    order = rng.permutation(len(at))
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at[order])], "t long, pc1 double, pc2 double"), at[order]


def plain_seeds(at, k):
    draw, centers = Lcg(CLUSTER_SEED), [at[0]]
    for _ in range(1, k):
        d = np.min([((at - c) ** 2).sum(axis=1) for c in centers], axis=0)
        target = draw.unit() * d.sum()
        centers.append(at[int(np.argmax(np.cumsum(d) >= target))])
    return np.array(centers)


def test_seeding_and_lloyd_against_arrays(spark):
    frame, at = points(spark)
    seeds = plain_seeds(at, 3)
    assert np.array(thermo.seed_centers(frame, 3, bucket=16)) == pytest.approx(seeds)
    centers = seeds
    for _ in range(200):
        near = ((at[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([at[near == k].mean(axis=0) if (near == k).any() else centers[k] for k in range(3)])
        if np.allclose(moved, centers):
            break
        centers = moved
    found = thermo.kmeans(frame, 3)
    assert np.array(found) == pytest.approx(centers)
    assigned = thermo.assign(frame, found)
    assert values(assigned, "t", "cluster") == near.tolist()
    assert sum(values(thermo.populations(assigned, 3), "cluster", "population")) == pytest.approx(1)


def test_empty_clusters_stay(spark):
    frame, _ = points(spark)
    centers = [(0.0, 0.0), (100.0, 100.0)]
    assert thermo.lloyd_step(frame, centers)[1] == (100.0, 100.0)
    assert values(thermo.populations(thermo.assign(frame, centers), 2), "cluster", "population") == [1, 0]


def test_ties_go_to_the_first_centre(spark):
    frame = spark.createDataFrame([(0, 0.0, 0.0)], "t long, pc1 double, pc2 double")
    assert thermo.assign(frame, [(1.0, 0.0), (-1.0, 0.0)]).first().cluster == 0


def test_steps_compile_nothing_anew(spark):
    """Centres that move are no part of a step's code: of two hundred steps, compiling each was most of the time."""
    frame, at = points(spark, n=3000)
    compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME()
    start = [(0.0, 0.0), (0.1, 0.0), (0.2, 0.0)]
    thermo.kmeans(frame, 3, steps=1, centers=start)
    before = compiled.getCount()
    found = thermo.kmeans(frame, 3, centers=start)
    assert compiled.getCount() == before
    centers, steps = np.array(start), 0
    while steps == 0 or not np.array_equal(near, was):
        was = near if steps else None
        near, steps = ((at[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1), steps + 1
        centers = np.array([at[near == k].mean(axis=0) for k in range(3)])
    assert steps > 2 and np.array(found) == pytest.approx(centers)


def test_steps_choose_centres_as_columns_do(spark):
    """Ties, and coordinates that are no numbers."""
    at = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.5, 0.0), (3, float("nan"), 0.0), (4, float("inf"), 0.0), (5, 0.5, 0.7)]
    frame, centers = spark.createDataFrame(at, "t long, pc1 double, pc2 double"), [(1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]
    want = values(thermo.assign(frame, centers), "t", "cluster")
    assert thermo._nearest_of(centers, *np.array([p[1:] for p in at]).T).tolist() == want


def test_points_are_spread_over_files(spark, monkeypatch):
    """A few bytes a frame would make one file, and all steps one task's work."""
    monkeypatch.setattr(thermo, "STEP_FRAMES", 20)
    frame, _ = points(spark)
    found = thermo.points_of(frame.select(F.col("t").alias("frame"), "pc1", "pc2").coalesce(1))
    assert values(found, "t", "t") == list(range(90)) and len(found.inputFiles()) >= 5


def states(spark, path):
    return spark.createDataFrame(list(enumerate(path)), "t long, state int")


def test_two_state_counts(spark):
    counts = thermo.lag_counts(states(spark, [0, 0, 1, 1, 0, 0, 1, 1]), 1)
    assert {(r.i, r.j): r.n for r in counts.collect()} == {(0, 0): 2, (0, 1): 2, (1, 0): 1, (1, 1): 2}
    t = {(r.i, r.j): r.p for r in thermo.transition_matrix(counts, 3).collect()}
    assert t[0, 0] == pytest.approx(2 / 3.5) and t[0, 1] == pytest.approx(1.5 / 3.5) and t[2, 2] == 1 and t[2, 0] == 0


def test_spectrum_is_that_of_the_matrix():
    c = np.array([[8.0, 2, 1], [2, 6, 1], [1, 1, 4]])
    t = c / c.sum(axis=1, keepdims=True)
    values_, vectors = thermo.spectrum(t)
    assert values_ == pytest.approx(np.sort(np.linalg.eigvals(t).real)[::-1])
    for k in range(3):
        assert t @ vectors[:, k] == pytest.approx(values_[k] * vectors[:, k])
    assert (thermo.implied_timescales(values_, 2, 3) > 0).all() and (thermo.implied_timescales(values_, 2, 3, compat=True) < 0).all()


def test_memberships(spark):
    frame, _ = points(spark)
    assigned = thermo.assign(frame, [(0.0, 0.0), (5.0, 0.0), (0.0, 5.0)])
    model = thermo.MarkovModel(assigned, 3, lag=1)
    rows = model.membership().collect()
    assert all(sum(r.membership) == pytest.approx(1) and r.membership[-1] == 0 for r in rows)
    assert model.its().count() == 2


def test_free_energy_surface(spark):
    frame, _ = points(spark)
    f = thermo.free_energy_surface(frame, "pc1", "pc2", 10).collect()
    assert len(f) == 100 and min(r.energy for r in f) == 0
    top = max(r.energy for r in f)
    assert top <= np.log(90) and sum(r.energy == pytest.approx(top) for r in f) > 50
    one = frame.limit(1)
    assert thermo.free_energy_surface(one, "pc1", "pc2", 4).filter("energy <> 0").count() == 0  # no range at all


# -- umbrella windows


def windows(spark, k=6):
    return window_table(spark, k, 0.0, 5.0)


def samples(spark, k=6, n=60, seed=3, fc=5.0):
    """Harmonic windows on a flat profile."""
    rng = np.random.default_rng(seed)
    sigma = 1 / np.sqrt(mbar.beta() * fc)
    rows = [(w, i, float(w + rng.normal(0, sigma))) for w in range(k) for i in range(n + w)]
    return spark.createDataFrame(rows, "window_idx int, sample_idx long, x double"), rows


def plain_solve(x, n, centers, fc, sweeps=20000):
    u = mbar.beta() * 0.5 * fc * (x[None] - centers[:, None]) ** 2
    f = np.zeros(len(centers))
    lse = lambda a, axis: a.max(axis=axis) + np.log(np.exp(a - a.max(axis=axis, keepdims=True)).sum(axis=axis))
    some = n > 0
    for _ in range(sweeps):
        d = lse(np.log(n[some])[:, None] + f[some][:, None] - u[some], 0)
        new = -lse(-u - d[None], 1)
        new -= new[0]
        if np.abs(new - f).max() < 1e-10:
            break
        f = new
    return f, lse(np.log(n[some])[:, None] + f[some][:, None] - u[some], 0)


def test_converged_free_energies_and_profile(spark):
    frame, rows = samples(spark)
    model = mbar.Mbar(frame, windows(spark), 5.0, n_bins=8, n_boot=0)
    x, n = np.array([r[2] for r in rows]), np.array([60.0 + w for w in range(6)])
    f, d = plain_solve(x, n, np.arange(6.0), 5.0)
    assert values(model.free_energies(), "window_idx", "f") == pytest.approx(f, abs=1e-6)
    inside = (x >= 0) & (x <= 5)
    at = np.minimum((x[inside] / 5 * 8).astype(int), 7)
    raw = np.array([-np.log(np.exp(-d[inside][at == b]).sum()) for b in range(8)])
    got = model.profile().orderBy("bin").collect()
    assert [r.pmf_kt for r in got] == pytest.approx(raw - raw[:4].min(), abs=1e-6)
    assert all(r.pmf_kcal == pytest.approx(r.pmf_kt / mbar.beta()) and r.err_kt == 0 for r in got)
    top = mbar.barrier(model.profile()).first()
    assert top.delta_g_kt == pytest.approx(max(r.pmf_kt for r in got))


def test_bootstrap_is_that_of_repeated_blocks(spark):
    """Weights of blocks give the free energies of the samples drawn by the replicate's generator."""
    frame, rows = samples(spark)
    model = mbar.Mbar(frame, windows(spark), 5.0, n_bins=8, n_boot=3)
    by = [np.array([r[2] for r in rows if r[0] == w]) for w in range(6)]
    for rep in range(3):
        draw, x, n = Lcg.for_replicate(rep), [], []
        for s in by:
            size = max(1, len(s) // 10)
            picked = [s[p * size : min(len(s), (p + 1) * size)] for p in (draw.word() % 10 for _ in range(10))]
            x += picked
            n.append(float(sum(map(len, picked))))
        f, _ = plain_solve(np.concatenate(x), np.array(n), np.arange(6.0), 5.0)
        assert model.f[rep + 1] == pytest.approx(f, abs=1e-6)
    assert any(r.err_kt > 0 for r in model.profile().collect())


def test_few_windows_and_empty_bins(spark):
    frame, _ = samples(spark)
    with pytest.raises(ValueError, match="two windows"):
        mbar.Mbar(frame, window_table(spark, 1, 0.0, 1.0), 5.0)
    model = mbar.Mbar(frame.filter("x < 2.4 or x > 2.6"), windows(spark), 5.0, n_bins=50, n_boot=0)
    assert model.profile().filter("pmf_kt is null").count() >= 1


def test_density_integrates_to_one(spark):
    frame, _ = samples(spark)
    d = mbar.window_density(frame.filter("window_idx = 2"), 0.0, 5.0).orderBy("point").collect()
    assert len(d) == 60 and sum(r.density for r in d) * (d[1].x - d[0].x) == pytest.approx(1, abs=0.02)


def replicates(reps, seed=8):
    """Biases of samples, weights, and the replicates' free energies and counts, some of them unlike the first one's."""
    rng = np.random.default_rng(seed)
    centers = np.linspace(0, 3, 7)
    u = 40 * (rng.uniform(-0.2, 3.2, 500)[:, None] - centers) ** 2
    f, n = rng.normal(0, 3, (reps, 7)), rng.integers(50, 90, (reps, 7)).astype(float)
    n[:, 5] = 0  # a window without samples
    if reps > 3:
        n[2, 1] = 0  # one that this replicate drew nothing of
        f[3] += np.linspace(-400, 400, 7)  # far from all others
    return u, rng.integers(0, 3, (500, reps)).astype(float), f, n


def test_sums_of_replicates_are_those_of_each_by_itself():
    u, mass, f, n = replicates(6)
    assert mbar._alike(f, n).tolist() == [True, True, False, False, True, True]
    first, second = mbar.replicate_sums(u, mass, f, n)
    logs = mbar.replicate_weights(u, mass, f, n)
    for r in range(6):
        some = n[r] > 0
        t = np.log(n[r][some]) + f[r][some] - u[:, some]
        d = t.max(axis=1) + np.log(np.exp(t - t.max(axis=1, keepdims=True)).sum(axis=1))
        single, share = np.exp(f[r] - u - d[:, None]), np.zeros(u.shape)
        share[:, some] = np.exp(t - d[:, None])
        assert first[r] == pytest.approx(mass[:, r] @ single, rel=1e-10)
        assert second[r] == pytest.approx((share * mass[:, r, None]).T @ share, rel=1e-10, abs=1e-250)
        assert logs[:, r] == pytest.approx(mass[:, r] * np.exp(-d), rel=1e-10)


def test_replicates_share_the_exponentials_of_a_sample(monkeypatch):
    """What a pass exponentiates does not grow with the replicates, which are most of a profile's work."""
    taken, exp = [], np.exp
    monkeypatch.setattr(mbar.np, "exp", lambda x, *a, **k: taken.append(np.size(x)) or exp(x, *a, **k))

    def cost(reps):
        taken.clear()
        mbar.replicate_sums(*replicates(reps)[:2], *(np.repeat(v[:1], reps, axis=0) for v in replicates(1)[2:]))
        return sum(taken)

    assert cost(51) < 1.5 * cost(1)
