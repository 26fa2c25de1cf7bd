"""Shapes that several analyses share: matrices of frames, Gram sums, pairs within a cutoff, dense numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.model import Trajectory

#: Atoms up to which all pairs of a frame are looked at within its row; beyond, a cell grid is joined.
MAX_INROW_ATOMS = 512
#: Rows of a square matrix that the driver holds (1.2 GB of doubles); checked before any frame is read.
MAX_ROWS = 12_000
#: Side of the square blocks that a large Gram matrix is summed in.
GRAM_BLOCK = 1536


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths as one matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def map_frames(traj: Trajectory, schema: str, make: Callable[[np.ndarray, np.ndarray], dict]) -> DataFrame:
    """Columns computed from batches of (frame numbers, coordinates as frames x 3N)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(make(b.column(0).to_numpy(), matrix(b.column(1))))

    return traj.whole_frames.mapInArrow(run, schema)


def summed_vectors(traj: Trajectory, make: Callable[[np.ndarray], np.ndarray], rows: int) -> np.ndarray:
    """The sum over all frames of a rows x width matrix of statistics of a batch.

    A task adds its batches up and emits one matrix; the tasks' matrices are added row by row on
    the executors, and only the total comes to the driver.
    """

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = make(matrix(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            packed = pa.array([row.tobytes() for row in np.ascontiguousarray(total, float)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), packed], names=["i", "v"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, float) for v in t["v"].to_pylist())
        return pa.table({"i": t["i"][:1], "v": pa.array([total.tobytes()], pa.binary())})

    parts = traj.whole_frames.select("xyz").mapInArrow(run, "i long, v binary")
    found = parts.groupBy("i").applyInArrow(add, "i long, v binary").collect()
    if not found:
        return np.zeros((rows, 0))
    return np.array([np.frombuffer(r.v, float) for r in sorted(found, key=lambda r: r.i)])


def mean_vector(traj: Trajectory) -> np.ndarray:
    """The mean of each of the 3N coordinates."""
    total = summed_vectors(traj, lambda x: np.concatenate([x.sum(axis=0), [len(x)]])[None, :], 1)[0]
    return total[:-1] / total[-1] if len(total) and total[-1] else np.zeros(3 * traj.n_atoms)


def _gram_rows(traj: Trajectory, part: Callable[[np.ndarray, int, int], np.ndarray], n: int) -> np.ndarray:
    """Rows of an n x n sum, gathered a band of GRAM_BLOCK rows at a time, so that a task never holds more than a band."""
    if n > MAX_ROWS:
        raise ValueError(f"a matrix of {n} rows; at most {MAX_ROWS} are held, analyse a selection")
    bands = []
    for lo in range(0, n, GRAM_BLOCK):
        hi = min(n, lo + GRAM_BLOCK)
        bands.append(summed_vectors(traj, lambda x, lo=lo, hi=hi: part(x, lo, hi), hi - lo))
    return np.concatenate(bands) if bands else np.zeros((0, 0))


def covariance(traj: Trajectory) -> np.ndarray:
    """The population covariance of the 3N coordinates, centred before it is squared."""
    mean = traj.mean
    return _gram_rows(traj, lambda x, lo, hi: (x - mean)[:, lo:hi].T @ (x - mean), len(mean)) / max(1, traj.n_frames)


def displacement_products(traj: Trajectory) -> np.ndarray:
    """For each pair of atoms, the sum over frames of the inner product of their displacements."""
    mean = traj.mean

    def part(x, lo, hi):
        d = (x - mean).reshape(len(x), -1, 3)
        return sum(d[:, lo:hi, c].T @ d[:, :, c] for c in range(3))

    return _gram_rows(traj, part, len(mean) // 3)


def entries(spark, m: np.ndarray, value: str = "value", names: tuple[str, str] = ("i", "j")) -> DataFrame:
    """A matrix as rows i, j, value; made on the executors from its rows."""
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], f"{names[0]} int, r array<double>")
    return rows.select(names[0], F.posexplode("r").alias(names[1], value))


# ----------------------------------------------------------------------------------------------
# Pairs of atoms of a frame


def close_pairs(traj: Trajectory, cutoff: float, atoms: list[int] | None = None, max_inrow: int = MAX_INROW_ATOMS) -> DataFrame:
    """frame, i, j (i < j) and d of each pair of the given atoms at most the cutoff apart in a frame.

    Small sets of atoms are compared within their frame's row, without a shuffle.  Larger ones are
    put in cells of the cutoff's size; a pair lies in the same or in adjacent cells, so each atom
    meets 27 cells' atoms and not all of its frame.
    """
    atoms = list(range(traj.n_atoms)) if atoms is None else atoms
    if len(atoms) <= max_inrow:
        return _pairs_in_arrays(traj, cutoff, np.array(atoms, int))
    wanted = traj.spark.createDataFrame([(a,) for a in atoms], "atom_idx int")
    long = traj.long.join(F.broadcast(wanted) if len(atoms) <= 1_000_000 else wanted, "atom_idx")
    cell = [F.floor(F.col(c) / cutoff) for c in "xyz"]
    left = long.select("frame", F.col("atom_idx").alias("i"), *[F.col(c).alias(c + "1") for c in "xyz"], *[k.alias("c" + c) for k, c in zip(cell, "xyz")])
    steps = F.explode(F.array(*[F.array(*map(F.lit, (a, b, c))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    right = long.withColumn("s", steps).select(
        "frame", F.col("atom_idx").alias("j"), *[F.col(c).alias(c + "2") for c in "xyz"],
        *[(k + F.col("s")[n]).alias("c" + c) for n, (k, c) in enumerate(zip(cell, "xyz"))],
    )
    d = F.sqrt(sum(((F.col(c + "1") - F.col(c + "2")) * (F.col(c + "1") - F.col(c + "2")) for c in "xyz"), F.lit(0.0)))
    met = left.join(right, ["frame", "cx", "cy", "cz"]).filter("i < j").select("frame", "i", "j", d.alias("d"))
    return met.filter(F.col("d") <= cutoff)


def _pairs_in_arrays(traj: Trajectory, cutoff: float, atoms: np.ndarray) -> DataFrame:
    """The same by array arithmetic on batches of frames."""
    a, b = np.triu_indices(len(atoms), 1)

    def make(frames, x):
        at = x.reshape(len(x), -1, 3)[:, atoms]
        out = [[], [], [], []]
        step = max(1, 4_000_000 // max(1, len(a)))
        for lo in range(0, len(x), step):
            some = at[lo : lo + step]
            d = np.sqrt(((some[:, a] - some[:, b]) ** 2).sum(axis=2))
            f, p = np.nonzero(d <= cutoff)
            for o, v in zip(out, (frames[lo + f], atoms[a[p]], atoms[b[p]], d[f, p])):
                o.append(v)
        f, i, j, d = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return {"frame": f.astype(np.int64), "i": i.astype(np.int32), "j": j.astype(np.int32), "d": d.astype(float)}

    return map_frames(traj, "frame long, i int, j int, d double", make)


# ----------------------------------------------------------------------------------------------
# Order


def dense_index(
    df: DataFrame, key: str, name: str = "t", bucket: int = 65_536, by: tuple[str, ...] = (), then: tuple[str, ...] = ()
) -> DataFrame:
    """df with its rows numbered from 0 in the order of an integer key, and of `then` where keys tie, within each group of `by`.

    Keys are cut into ranges of `bucket`; the ranges' counts are summed up in order, a table smaller
    than the input by that factor, and rows are numbered within their range.  No task sorts all rows.
    """
    rows = df.withColumn("__b", F.floor(F.col(key) / bucket))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    starts = sizes.select(*by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    number = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(key, *then))
    joined = rows.withColumn("__r", number).join(starts, [*by, "__b"])
    return joined.withColumn(name, F.col("__s") + F.col("__r") - 1).drop("__b", "__r", "__s")
