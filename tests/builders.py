"""Small trajectories for closed-form tests."""

from __future__ import annotations

import numpy as np

from helixframe.model import Trajectory, atoms_frame


def make(spark, frames, atoms=None, cells=None) -> Trajectory:
    """frames: frames x atoms x 3; atoms: rows without atom_idx, carbons of one residue each by default."""
    x = np.asarray(frames, float)
    n = x.shape[1]
    rows = atoms or [("CA", "ALA", "A", k + 1, "C") for k in range(n)]
    table = atoms_frame(spark, [(k, *r) for k, r in enumerate(rows)])
    data = spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(x)], "frame long, xyz array<double>")
    boxes = None if cells is None else spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(cells)], "frame long, a double, b double, c double")
    return Trajectory(data, table, boxes)


def values(df, key, value) -> list:
    return [r[value] for r in df.orderBy(key).collect()]


def square(df, n, value="value") -> np.ndarray:
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.i, r.j] = r[value]
    return out


def noise(spark, frames=40, atoms=6, seed=0, **more) -> Trajectory:
    rng = np.random.default_rng(seed)
    base = rng.normal(scale=4, size=(atoms, 3))
    return make(spark, base + rng.normal(scale=0.6, size=(frames, atoms, 3)), **more)
