"""N19. Free energies of umbrella windows by the multistate Bennett acceptance ratio.

Samples stay on the executors.  A pass gives, for each set of weights of the samples, the sums over
samples of each window's share and of the products of shares; the driver solves for the windows'
free energies from these by Newton steps.  A step that does not improve is replaced by the
self-consistent one, which has the same fixed point.  Bootstrap replicates are sets of weights,
since drawing blocks again only repeats samples, and all replicates are solved in the same passes.
They share a sample's exponentials, so what a pass does for each replicate is matrix products.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.expr import bin_index
from helixframe.functions.lcg import Lcg
from helixframe.plans.primitives import dense_index
from helixframe.plans.tables import materialise

# The gas constant in kcal/(mol K), the solver's tolerance and sweeps, bootstrap blocks, density points.
GAS = 1.987204258e-3
TOLERANCE, MAX_SWEEPS, BLOCKS, KDE_POINTS = 1e-8, 500, 10, 60
#: The largest change of a free energy, in kT, that a Newton step makes.
MAX_STEP = 4.0
#: How far, in kT, a replicate's free energies may spread about the first one's for the two to share exponentials.
MAX_SPREAD = 200.0
#: Products of exponentials that a task holds at once (8 MB).
MAX_PRODUCTS = 1_000_000


def beta(temperature: float = 300.0) -> float:
    return 1.0 / (GAS * temperature)


def bias(x: Column, center: Column | float, fc: float, b: float) -> Column:
    """The reduced harmonic bias beta x fc / 2 x (x - x0)^2."""
    gap = x - (center if isinstance(center, Column) else F.lit(float(center)))
    return F.lit(b * 0.5 * fc) * gap * gap


def bias_matrix(samples: DataFrame, windows: DataFrame, fc: float, temperature: float = 300.0) -> DataFrame:
    """J12. window_idx, sample_idx, k, u: each sample's bias in each window, made within the sample's row."""
    centers = F.array(*[F.struct(F.lit(r.window_idx).alias("k"), F.lit(r.val0).alias("c")) for r in _centers(windows)])
    rows = samples.select("window_idx", "sample_idx", "x", F.explode(centers).alias("w"))
    return rows.select("window_idx", "sample_idx", F.col("w.k").alias("k"), bias(F.col("x"), F.col("w.c"), fc, beta(temperature)).alias("u"))


def _centers(windows: DataFrame) -> list:
    return windows.select("window_idx", "val0").orderBy("window_idx").collect()  # a row a window


def counts_of(samples: DataFrame, n_windows: int) -> np.ndarray:
    n = np.zeros(n_windows)
    for r in samples.groupBy("window_idx").count().collect():
        n[r.window_idx] = r["count"]
    return n


def _with_denominator(samples: DataFrame, n: np.ndarray, f: list[float], centers: list[float], fc: float, b: float) -> DataFrame:
    """samples with D, the log of the sum over windows of n_k exp(f_k - u_k), and each window's g_k = f_k - u_k.

    Every window is a column of its own, so the whole sum is compiled code.
    """
    shown = samples.select("*", *[(F.lit(g) - bias(F.col("x"), c, fc, b)).alias(f"g{k}") for k, (g, c) in enumerate(zip(f, centers))])
    some = [k for k in range(len(centers)) if n[k] > 0]
    terms = [F.lit(float(np.log(n[k]))) + F.col(f"g{k}") for k in some]
    topped = shown.withColumn("top", F.greatest(*terms) if len(terms) > 1 else terms[0])
    total = reduce(lambda a, t: a + t, [F.exp(t - F.col("top")) for t in terms])
    return topped.withColumn("D", F.col("top") + F.ln(total))


def one_sweep(samples: DataFrame, windows: DataFrame, fc: float, temperature: float = 300.0, f: list[float] | None = None) -> DataFrame:
    """k, f after one self-consistent sweep from f (zeros), shifted to f_0 = 0; in expressions only.

    Written as f_k - ln sum_n exp(f_k - u_kn - D_n): no term exceeds one over the window's samples,
    so the sum needs no shift of its own.
    """
    centers = [r.val0 for r in _centers(windows)]
    n = counts_of(samples, len(centers))
    f = f or [0.0] * len(centers)
    b = beta(temperature)
    rows = _with_denominator(samples.select("x"), n, f, centers, fc, b)
    shares = rows.agg(*[F.sum(F.exp(F.col(f"g{k}") - F.col("D"))).alias(f"s{k}") for k in range(len(centers))])
    new = shares.select(F.posexplode(F.array(*[F.lit(g) - F.ln(F.col(f"s{k}")) for k, g in enumerate(f)])).alias("k", "f"))
    base = shares.select((F.lit(f[0]) - F.ln(F.col("s0"))).alias("f0"))
    return new.crossJoin(F.broadcast(base)).select("k", (F.col("f") - F.col("f0")).alias("f"))  # one row


def _alike(f: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The replicates that can share exponentials with the first: of samples in the same windows, and of free energies near its own.

    Within MAX_SPREAD what underflows of a shared exponential is less than e^-300 of any replicate's sum.
    """
    return ((n > 0) == (n[0] > 0)).all(axis=1) & (np.ptp(f - f[0], axis=1) <= MAX_SPREAD)


def _together(u: np.ndarray, f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """exp(f_k - u_k) of each sample by the first replicate's f, over the largest; each replicate's factors of these; its sums; and their logs' shift.

    Replicates differ by f and n, which no sample has a part in, so exponentials are taken once and summed by one matrix product.
    """
    base = f[0] - u
    top = base[:, n[0] > 0].max(axis=1)
    gap = f - f[0]
    middle = (gap.max(axis=1) + gap.min(axis=1)) / 2
    e, factor = np.exp(base - top[:, None]), np.exp(gap - middle[:, None])
    return e, factor, e @ (n * factor).T, top[:, None] + middle


def _apart(u: np.ndarray, f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One replicate's n_k exp(f_k - u_k) of each sample over their sum, and the sum's log."""
    t = np.where(n > 0, np.log(np.where(n > 0, n, 1)) + f - u, -np.inf)
    top = t.max(axis=1)
    e = np.exp(t - top[:, None])
    total = e.sum(axis=1)
    return e / total[:, None], top + np.log(total)


def replicate_sums(u: np.ndarray, mass: np.ndarray, f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each replicate the sums of exp(f_k - u_k - D) and of the products of shares, over samples of reduced biases u and weights mass (sample x replicate)."""
    reps, k = n.shape
    first, second = np.zeros((reps, k)), np.zeros((reps, k, k))
    same = _alike(f, n)
    if same.any():
        e, factor, total, _ = _together(u, f[same], n[same])
        per = mass[:, same] / total
        first[same] = factor * (per.T @ e)
        each, products = np.ascontiguousarray(e.T), np.empty((k * (k + 1) // 2, len(u)))
        i, j = np.triu_indices(k)
        starts = np.searchsorted(i, np.arange(k))
        for a, lo in enumerate(starts):
            np.multiply(each[a], each[a:], out=products[lo : lo + k - a])
        own = n[same] * factor
        upper = (products @ (per / total)).T * own[:, i] * own[:, j]
        whole = np.zeros((len(own), k, k))
        whole[:, i, j] = whole[:, j, i] = upper
        second[same] = whole
    for r in np.flatnonzero(~same):
        share, log_total = _apart(u, f[r], n[r])
        first[r] = mass[:, r] @ np.exp(f[r] - u - log_total[:, None])
        second[r] = share.T @ (share * mass[:, r, None])
    return first, second


def replicate_weights(u: np.ndarray, mass: np.ndarray, f: np.ndarray, n: np.ndarray) -> np.ndarray:
    """mass x exp(-D), sample x replicate."""
    out = np.empty(mass.shape)
    same = _alike(f, n)
    if same.any():
        _, _, total, shift = _together(u, f[same], n[same])
        out[:, same] = mass[:, same] * np.exp(-(shift + np.log(total)))
    for r in np.flatnonzero(~same):
        out[:, r] = mass[:, r] * np.exp(-_apart(u, f[r], n[r])[1])
    return out


class Mbar:
    """The converged model of windows (window_idx 0..K-1, val0) and samples (window_idx, sample_idx, x)."""

    def __init__(self, samples: DataFrame, windows: DataFrame, fc: float, temperature: float = 300.0, n_bins: int | None = None, n_boot: int = 50):
        self.spark, self.samples = samples.sparkSession, samples
        self.centers = np.array([r.val0 for r in _centers(windows)])
        k = len(self.centers)
        if k < 2:
            raise ValueError("at least two windows are needed")
        self.n = counts_of(samples, k)
        self.fc, self.beta = fc, beta(temperature)
        self.bins = max(2, n_bins if n_bins is not None else k - 1)
        self.low, self.high = float(self.centers.min()), float(self.centers.max())
        self.blocked = self._blocked() if n_boot else samples.select("window_idx", "x", F.lit(0).alias("block"))
        draws = [np.ones((k, BLOCKS + 1))] + [self._draw(r) for r in range(n_boot)]
        self.weights = np.array(draws)  # replicate x window x block; the last block is what draws leave out
        self.f = self._solve()

    def _blocked(self) -> DataFrame:
        """window_idx, x, block: ten blocks of consecutive samples of a window, and a last one of the rest."""
        numbered = dense_index(self.samples.select("window_idx", "x", "sample_idx"), "sample_idx", "at", by=("window_idx",))
        size = F.element_at(F.array(*[F.lit(max(1, int(m) // BLOCKS)) for m in self.n]), F.col("window_idx") + 1)
        block = F.least(F.lit(BLOCKS), F.floor(F.col("at") / size))
        # Every pass of the solver reads these; without the table each would number the samples again.
        return materialise(numbered.select("window_idx", "x", block.cast("int").alias("block")), "mbar-blocks")

    def _draw(self, replicate: int) -> np.ndarray:
        """How often each block of each window is drawn, ten draws a window by the replicate's generator."""
        draw = Lcg.for_replicate(replicate)
        out = np.zeros((len(self.centers), BLOCKS + 1))
        for k in range(len(self.centers)):
            for _ in range(BLOCKS):
                out[k, draw.word() % BLOCKS] += 1
        return out

    def _counts(self) -> np.ndarray:
        """Each replicate's number of samples of each window."""
        k = len(self.centers)
        size = np.zeros((k, BLOCKS + 1))
        for r in self.blocked.groupBy("window_idx", "block").count().collect():
            size[r.window_idx, r.block] = r["count"]
        return (self.weights * size).sum(axis=2)

    def _pass(self, f: np.ndarray, n: np.ndarray, log: bool) -> list[np.ndarray]:
        """Sums over samples for each replicate: shares and products of shares, or (log) each bin's weight."""
        centers, scale, weights, bins, low, high = self.centers, self.beta * 0.5 * self.fc, self.weights, self.bins, self.low, self.high
        k, reps = len(centers), len(f)
        table = np.ascontiguousarray(weights.transpose(1, 2, 0)).reshape(-1, reps)
        step = max(1, MAX_PRODUCTS // (k * (k + 1) // 2))

        def run(batches):
            first, second = np.zeros((reps, k)), np.zeros((reps, k, k))
            heap = np.zeros((reps, bins))
            for whole in batches:
                for b in (whole.slice(lo, step) for lo in range(0, whole.num_rows, step)):
                    w, x, block = (b.column(i).to_numpy() for i in range(3))
                    if log:
                        inside = (x >= low) & (x <= high)
                        w, x, block = w[inside], x[inside], block[inside]
                    u = scale * (x[:, None] - centers[None, :]) ** 2
                    mass = table[w * (BLOCKS + 1) + block]
                    if log:
                        at = np.clip(((x - low) / ((high - low) / bins)).astype(int), 0, bins - 1)
                        cell = at[:, None] + np.arange(reps) * bins
                        heap += np.bincount(cell.ravel(), replicate_weights(u, mass, f, n).ravel(), reps * bins).reshape(reps, bins)
                    else:
                        shares, products = replicate_sums(u, mass, f, n)
                        first += shares
                        second += products
            out = heap if log else np.concatenate([first, second.reshape(reps, -1)], axis=1)
            width = out.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(reps + 1, dtype=np.int32) * width), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), lists], names=["r", "v"])

        def add(t: pa.Table) -> pa.Table:
            rows = pa.concat_arrays(t["v"].chunks)
            total = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(axis=0)
            return pa.table({"r": t["r"][:1], "v": pa.array([total], pa.list_(pa.float64()))})

        parts = self.blocked.select("window_idx", "x", "block").mapInArrow(run, "r long, v array<double>")
        found = parts.groupBy("r").applyInArrow(add, "r long, v array<double>").collect()  # replicates x windows^2
        total = np.array([r.v for r in sorted(found, key=lambda r: r.r)])
        return [total] if log else [total[:, :k], total[:, k:].reshape(reps, k, k)]

    def _solve(self) -> np.ndarray:
        n = self._counts()
        reps, k = n.shape
        f = np.zeros((reps, k))
        last = np.full(reps, np.inf)
        for _ in range(MAX_SWEEPS):
            shares, products = self._pass(f, n, log=False)
            swept = f - np.log(np.maximum(shares, 1e-300))
            swept -= swept[:, :1]
            gap = np.abs(swept - f).max(axis=1)
            if (gap < TOLERANCE).all():
                return swept
            new = swept.copy()
            for r in np.flatnonzero((gap < last) | np.isinf(last)):
                # Gradient and Hessian of the convex objective, f_0 held at zero.
                grad = (n[r] * shares[r] - n[r])[1:]
                hess = (np.diag(n[r] * shares[r]) - products[r])[1:, 1:]
                try:
                    step = np.linalg.solve(hess + 1e-12 * np.eye(k - 1), grad)
                except np.linalg.LinAlgError:
                    continue
                if np.isfinite(step).all():  # far from the minimum a step is shortened
                    new[r, 1:] = f[r, 1:] - step * min(1.0, MAX_STEP / max(1e-300, np.abs(step).max()))
            last, f = gap, new
        return f

    def profile(self) -> DataFrame:
        """bin, bin_center, pmf_kt, pmf_kcal, err_kt: empty bins are null; zero is the least of the first half."""
        n = self._counts()
        heap = self._pass(self.f, n, log=True)[0]
        with np.errstate(divide="ignore"):
            raw = np.where(heap > 0, -np.log(heap), np.nan)
        zeroed = np.array([p - self._zero(p) for p in raw])
        main, boots = zeroed[0], zeroed[1:]
        rows = []
        for b in range(self.bins):
            seen = boots[:, b][np.isfinite(boots[:, b])] if len(boots) else np.zeros(0)
            err = float(seen.std(ddof=1)) if len(seen) > 1 else 0.0
            value = float(main[b]) if np.isfinite(main[b]) else None
            center = self.low + (b + 0.5) * (self.high - self.low) / self.bins
            rows.append((b, center, value, None if value is None else value / self.beta, err))
        return self.spark.createDataFrame(rows, "bin int, bin_center double, pmf_kt double, pmf_kcal double, err_kt double")

    def _zero(self, p: np.ndarray) -> float:
        half = p[: max(1, self.bins // 2)]
        for part in (half, p):
            if np.isfinite(part).any():
                return float(np.nanmin(part))
        return 0.0

    def free_energies(self) -> DataFrame:
        rows = [(k, float(v)) for k, v in enumerate(self.f[0])]
        return self.spark.createDataFrame(rows, "window_idx int, f double")


def barrier(profile: DataFrame) -> DataFrame:
    """delta_g_kt, err_kt, bin of the highest defined bin, the last of equal ones."""
    top = profile.filter("pmf_kt is not null").agg(F.max(F.struct("pmf_kt", "bin", "err_kt")).alias("m"))
    return top.select(F.col("m.pmf_kt").alias("delta_g_kt"), F.col("m.err_kt").alias("err_kt"), F.col("m.bin").alias("bin"))


def pmf_at(samples: DataFrame, windows: DataFrame, fc: float, f: list[float], n_bins: int, temperature: float = 300.0) -> DataFrame:
    """bin, n, pmf_kt of given free energies, in expressions only."""
    centers = [r.val0 for r in _centers(windows)]
    n = counts_of(samples, len(centers))
    b = beta(temperature)
    low, high = min(centers), max(centers)
    inside = samples.select("x").filter(F.col("x").between(low, high))
    rows = _with_denominator(inside, n, f, centers, fc, b).select(bin_index(F.col("x"), low, high - low, n_bins).alias("bin"), "D")
    return rows.groupBy("bin").agg(F.count("*").alias("n"), (-F.ln(F.sum(F.exp(-F.col("D"))))).alias("pmf_kt"))


def window_density(samples: DataFrame, low: float, high: float, points: int = KDE_POINTS) -> DataFrame:
    """J13. window_idx, point, x, density: Gaussian kernels of width sigma n^(-1/5) on a margin of 5 %.

    The grid is made within each sample's row and summed by window and point before the shuffle.
    """
    margin = (high - low) * 0.05
    start, width = low - margin, (high - low) + 2 * margin
    stats = samples.groupBy("window_idx").agg(F.count("*").alias("n"), F.greatest(F.stddev_pop("x"), F.lit(1e-12)).alias("sigma"))
    shaped = stats.select("window_idx", "n", (F.col("sigma") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    rows = samples.select("window_idx", F.col("x").alias("s"), grid.alias("point")).join(F.broadcast(shaped), "window_idx")
    x = F.lit(start) + F.lit(width) * F.col("point") / F.lit(float(points - 1))
    z = (x - F.col("s")) / F.col("bw")
    norm = F.col("n") * F.col("bw") * F.lit(float(np.sqrt(2 * np.pi)))
    summed = rows.groupBy("window_idx", "point", "n", "bw").agg(F.sum(F.exp(-0.5 * z * z)).alias("k"))
    return summed.select("window_idx", "point", x.alias("x"), (F.col("k") / norm).alias("density"))


def window_stats(samples: DataFrame) -> DataFrame:
    """window_idx, n, mean, std (population)."""
    return samples.groupBy("window_idx").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def nearest_window(centers: DataFrame, windows: DataFrame, value: str = "bin_center") -> DataFrame:
    """J15. Each row with the window of the nearest val0, the first of equal ones."""
    each = [F.struct(F.abs(F.col(value) - F.lit(r.val0)).alias("d"), F.lit(r.window_idx).alias("k")) for r in _centers(windows)]
    return centers.withColumn("window_idx", F.array_min(F.array(*each))["k"])
