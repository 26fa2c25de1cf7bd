"""Free-energy surfaces, clustering and Markov models of projected frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.expr import bin_index
from helixframe.functions.lcg import CLUSTER_SEED, Lcg
from helixframe.plans.primitives import dense_index
from helixframe.plans.tables import materialise

MAX_LLOYD = 200
#: Frames of a file of projected frames, and so of a task of each of the many steps that read them.
STEP_FRAMES = 65_536


def free_energy_surface(points: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """N13. y_bin, x_bin, energy in kT: -ln of each bin's share, shifted to a least of zero.

    The bins span 1.05 times the range; an empty one has the energy of a single count.
    """
    ends = points.agg(*[f(c).alias(n + c) for c in (x, y) for f, n in ((F.min, "lo_"), (F.max, "hi_"))], F.count("*").alias("total"))
    placed = points.crossJoin(F.broadcast(ends))  # one row
    at = lambda c: bin_index(F.col(c), F.col("lo_" + c), (F.col("hi_" + c) - F.col("lo_" + c)) * 1.05, bins)
    counts = placed.groupBy(at(y).alias("y_bin"), at(x).alias("x_bin")).agg(F.count("*").alias("n"))
    spark = points.sparkSession
    grid = spark.range(bins * bins).select((F.col("id") / bins).cast("int").alias("y_bin"), (F.col("id") % bins).cast("int").alias("x_bin"))
    full = grid.join(counts, ["y_bin", "x_bin"], "left").crossJoin(F.broadcast(ends.select("total")))
    raw = full.select("y_bin", "x_bin", (-F.ln(F.coalesce("n", F.lit(1)) / F.col("total"))).alias("e"))
    return raw.crossJoin(F.broadcast(raw.agg(F.min("e").alias("least")))).select("y_bin", "x_bin", (F.col("e") - F.col("least")).alias("energy"))


# ----------------------------------------------------------------------------------------------
# Clustering


def square_distance(center: tuple[float, float], x: str = "pc1", y: str = "pc2") -> Column:
    dx, dy = F.col(x) - F.lit(float(center[0])), F.col(y) - F.lit(float(center[1]))
    return dx * dx + dy * dy


def nearest(centers: list[tuple[float, float]], x: str = "pc1", y: str = "pc2") -> Column:
    """J15. The number of the nearest centre, the first of equal ones."""
    each = [F.struct(square_distance(c, x, y).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centers)]
    return F.array_min(F.array(*each))["k"]


def seed_centers(points: DataFrame, k: int, bucket: int = 65_536) -> list[tuple[float, float]]:
    """The first frame, then frames drawn by squared distance with the fixed generator.

    The frame at which the running sum of squared distances reaches the drawn share is found in
    two steps, the range of frames and then the frame in it, so no task sums all frames.
    """
    draw = Lcg(CLUSTER_SEED)
    first = points.orderBy("t").limit(1).collect()[0]
    centers = [(first.pc1, first.pc2)]
    for _ in range(1, k):
        d = F.array_min(F.array(*[square_distance(c) for c in centers]))
        rows = points.select("t", "pc1", "pc2", d.alias("d"), F.floor(F.col("t") / bucket).alias("b"))
        sums = rows.groupBy("b").agg(F.sum("d").alias("s"))
        total = sums.agg(F.sum("s")).first()[0]
        target = draw.unit() * total
        upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        hit = sums.withColumn("c", F.sum("s").over(upto)).filter(F.col("c") >= target).orderBy("b").limit(1).collect()
        pick = (first.pc1, first.pc2)
        if hit:
            within = Window.partitionBy("b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
            rest = target - (hit[0].c - hit[0].s)
            chosen = rows.filter(F.col("b") == hit[0].b).withColumn("c", F.sum("d").over(within)).filter(F.col("c") >= rest)
            got = chosen.orderBy("t").limit(1).collect()
            pick = (got[0].pc1, got[0].pc2) if got else pick
        centers.append(pick)
    return centers


def lloyd_step(points: DataFrame, centers: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The means of the points nearest to each centre; a centre without points stays."""
    rows = points.groupBy(nearest(centers).alias("k")).agg(F.avg("pc1").alias("x"), F.avg("pc2").alias("y")).collect()
    moved = list(centers)
    for r in rows:
        moved[r.k] = (r.x, r.y)
    return moved


def _nearest_of(centers: list[tuple[float, float]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """nearest() of arrays, by the same arithmetic; a distance that is no number is the farthest."""
    d = np.stack([(x - cx) * (x - cx) + (y - cy) * (y - cy) for cx, cy in centers])
    return np.where(np.isnan(d), np.inf, d).argmin(axis=0)


def _step_sums(points: DataFrame, now: list[tuple[float, float]], before: list[tuple[float, float]] | None) -> np.ndarray:
    """Of the points nearest to each centre: their number, the sums of their coordinates, and how many had another one before (the first, if None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(now)))
        for b in batches:
            x, y = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            near = _nearest_of(now, x, y)
            old = 0 if before is None else _nearest_of(before, x, y)
            for row, weights in zip(total, (None, x, y, near != old)):
                row += np.bincount(near, weights, len(now))
        yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "v": [total.ravel()]}, pa.schema([("task", pa.int32()), ("v", pa.list_(pa.float64()))]))

    rows = points.select("pc1", "pc2").mapInArrow(run, "task int, v array<double>").collect()  # a row a task
    found = [np.reshape(r.v, (4, -1)) for r in sorted(rows, key=lambda r: r.task)]
    return np.sum(found, axis=0) if found else np.zeros((4, len(now)))


def kmeans(points: DataFrame, k: int, steps: int = MAX_LLOYD, centers: list | None = None) -> list[tuple[float, float]]:
    """N18. Centres after Lloyd's steps, up to no change of any assignment.

    points: t (0, 1, ...), pc1, pc2.  One pass a step: it counts the points whose nearest centre
    changed and sums up the new centres.  The centres go to the tasks as numbers and not as literals of a
    plan, which every task would compile anew in every step.
    """
    before: list | None = None
    now = centers or seed_centers(points, k)
    for _ in range(steps):
        n, x, y, changed = _step_sums(points, now, before)
        before, now = now, [(float(x[i] / n[i]), float(y[i] / n[i])) if n[i] else c for i, c in enumerate(now)]
        if not changed.sum():
            break
    # Assignments belong to the centres before the last move, as the loop's did; at rest they agree.
    return now


def assign(points: DataFrame, centers: list[tuple[float, float]]) -> DataFrame:
    return points.select("t", nearest(centers).alias("cluster"))


def populations(assigned: DataFrame, k: int) -> DataFrame:
    """cluster, population (share); empty clusters are zero."""
    spark: SparkSession = assigned.sparkSession
    counts = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))
    every = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    return every.join(counts, "cluster", "left").crossJoin(total).select("cluster", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("population"))


# ----------------------------------------------------------------------------------------------
# Markov models


def lag_counts(states: DataFrame, lag: int) -> DataFrame:
    """J8. i, j, n of pairs of states lag steps apart, by an equi-join on the shifted step."""
    later = states.select((F.col("t") - lag).alias("t"), F.col("state").alias("j"))
    return states.select("t", F.col("state").alias("i")).join(later, "t").groupBy("i", "j").agg(F.count("*").alias("n"))


def transition_matrix(counts: DataFrame, k: int) -> DataFrame:
    """G17. i, j, p: symmetrised counts over their row sums; the identity where a row is empty."""
    spark = counts.sparkSession
    half = counts.select("i", "j", (F.col("n") / 2.0).alias("n"))
    both = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy("i", "j").agg(F.sum("n").alias("n"))
    grid = spark.range(k * k).select((F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j"))
    full = grid.join(both, ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    total = F.sum("n").over(Window.partitionBy("i"))
    own = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return full.select("i", "j", F.when(total > 0, F.try_divide(F.col("n"), total)).otherwise(own).alias("p"))


def spectrum(t: np.ndarray, compat: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order with right eigenvectors as columns.

    A reversible T is similar to a symmetric matrix by its stationary weights, which gives its true
    spectrum.  compat decomposes T's upper triangle mirrored, as if T were symmetric itself.
    """
    if compat:
        values, vectors = np.linalg.eigh(np.triu(t) + np.triu(t, 1).T)
        return values[::-1], vectors[:, ::-1]
    w = np.linalg.matrix_power(t, 1 << 20)
    pi = np.maximum(w.mean(axis=0), 1e-300)
    root = np.sqrt(pi)
    s = root[:, None] * t / root[None, :]
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    return values[::-1], (vectors / root[:, None])[:, ::-1]


def implied_timescales(values: np.ndarray, lag: int, n: int, compat: bool = False) -> np.ndarray:
    """-lag / ln |lambda| of the n-1 slowest processes after the stationary one.

    compat: with a negative sign, and from the second smallest eigenvalue upwards.
    """
    if compat:
        some = values[::-1][1:n]
        return -lag / np.abs(np.log(np.clip(np.abs(some), 1e-10, 1 - 1e-10)))
    return -lag / np.log(np.clip(np.abs(values[1:n]), 1e-10, 1 - 1e-10))


class MarkovModel:
    """N18, msm. A transition matrix of clusters, its timescales and soft memberships."""

    def __init__(self, assigned: DataFrame, k: int, lag: int = 1, n_macro: int | None = None, compat: bool = False):
        self.spark, self.k, self.lag = assigned.sparkSession, k, max(1, lag)
        self.n_macro = min(max(2, n_macro or k), k)
        states = assigned.select("t", F.col("cluster").alias("state"))
        self.assigned, self.matrix = assigned, np.eye(k)
        for r in transition_matrix(lag_counts(states, self.lag), k).collect():  # k x k
            self.matrix[r.i, r.j] = r.p
        self.values, self.vectors = spectrum(self.matrix, compat)
        self.timescales = implied_timescales(self.values, self.lag, self.n_macro, compat)

    def its(self) -> DataFrame:
        rows = [(i + 1, float(v)) for i, v in enumerate(self.timescales)]
        return self.spark.createDataFrame(rows, "k int, timescale double")

    def membership(self) -> DataFrame:
        """t, membership: weights of a frame's cluster in the n_macro slowest eigenvectors.

        With as many macrostates as clusters there is one eigenvector too few; the last weight is 0.
        """
        used = np.abs(self.vectors[:, 1 : 1 + min(self.n_macro, self.k - 1)]) + 1e-12
        share = used / used.sum(axis=1, keepdims=True)
        share = np.pad(share, ((0, 0), (0, self.n_macro - share.shape[1])))
        table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in share])
        return self.assigned.select("t", F.get(table, F.col("cluster")).alias("membership"))


def points_of(projection: DataFrame) -> DataFrame:
    """t, frame, pc1, pc2 of a projection, with t counting the frames in order; written out, since steps read it often."""
    return materialise(dense_index(projection, "frame", "t").select("t", "frame", "pc1", "pc2"), "points", per_file=STEP_FRAMES)
