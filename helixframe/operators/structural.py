"""Deviation, fluctuation and shape of a structure, frame by frame and atom by atom."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.model import Trajectory
from helixframe.plans.primitives import map_frames, mean_vector, summed_vectors


def _per_atom(traj: Trajectory, values: np.ndarray, name: str) -> DataFrame:
    rows = [(i, float(v)) for i, v in enumerate(values)]
    return traj.spark.createDataFrame(rows, f"atom_idx int, {name} double")


def rmsd(traj: Trajectory) -> DataFrame:
    """N1. frame, rmsd: root mean square deviation from the first whole frame, without superposition.

    Here as in all measures a frame counts if it has a coordinate for each atom; others give no row.
    """
    first = traj.whole_frames.orderBy("frame").limit(1).collect()  # one frame's coordinates
    if not first:
        return traj.whole_frames.select("frame", F.lit(None).cast("double").alias("rmsd"))
    reference = np.array(first[0].xyz)

    def make(frames, x):
        return {"frame": frames, "rmsd": np.sqrt(((x - reference) ** 2).sum(axis=1) / (x.shape[1] / 3))}

    return map_frames(traj, "frame long, rmsd double", make)


def square_fluctuations(traj: Trajectory) -> np.ndarray:
    """The population variance of each of the 3N coordinates."""
    mean = traj.mean
    total = summed_vectors(traj, lambda x: ((x - mean) ** 2).sum(axis=0)[None, :], 1)[0]
    return total / max(1, traj.n_frames) if len(total) else np.zeros(len(mean))


def rmsf(traj: Trajectory) -> DataFrame:
    """N2. atom_idx, rmsf: root mean square fluctuation about the mean position."""
    return _per_atom(traj, np.sqrt(square_fluctuations(traj).reshape(-1, 3).sum(axis=1)), "rmsf")


def radius_of_gyration(traj: Trajectory) -> DataFrame:
    """N3. frame, rg: root mean square distance from the unweighted centroid."""

    def make(frames, x):
        at = x.reshape(len(x), -1, 3)
        return {"frame": frames, "rg": np.sqrt(((at - at.mean(axis=1, keepdims=True)) ** 2).sum(axis=2).mean(axis=1))}

    return map_frames(traj, "frame long, rg double", make)


def mean_structure(traj: Trajectory) -> DataFrame:
    """G1. atom_idx, x, y, z: mean positions."""
    at = mean_vector(traj).reshape(-1, 3)
    return traj.spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "atom_idx int, x double, y double, z double")


def frame_coordinates(traj: Trajectory, frame: int) -> DataFrame:
    """P4. atom_idx, x, y, z of one frame; an unknown frame is an error."""
    one = traj.where(traj.frames.filter(F.col("frame") == frame))
    if one.frames.isEmpty():
        raise ValueError(f"frame {frame} is out of range")
    return one.long.drop("frame")


def bfactors(values: DataFrame, value: str, key: str = "atom_idx") -> DataFrame:
    """N23. key, bfactor: the values scaled to 0..100 by their range; 50 where all are equal."""
    bounds = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    if not bounds.n:
        raise ValueError("no values to scale")
    span = bounds.hi - bounds.lo
    scaled = F.lit(50.0) if span < 1e-10 else (F.col(value) - F.lit(bounds.lo)) / F.lit(span) * 100.0
    return values.select(key, scaled.alias("bfactor"))


def bfactors_from_residues(traj: Trajectory, residues: DataFrame, value: str) -> DataFrame:
    """atom_idx, bfactor of a value a residue (label RES SEQ), each atom taking its residue's."""
    label = F.concat_ws(" ", "res_name", F.col("res_seq").cast("string"))
    joined = traj.atoms.select("atom_idx", label.alias("residue")).join(residues.select("residue", value), "residue")
    return bfactors(joined, value)


def stride(traj: Trajectory, step: int) -> Trajectory:
    """P3. Every step-th frame, renumbered from 0."""
    from helixframe.plans.primitives import dense_index

    kept = traj.frames.filter(F.col("frame") % step == 0)
    numbered = dense_index(kept, "frame", "t", bucket=65_536 * step)
    cells = None
    if traj.cells is not None:
        cells = traj.cells.join(numbered.select("frame", "t"), "frame").select(F.col("t").alias("frame"), "a", "b", "c")
    return Trajectory(numbered.select(F.col("t").alias("frame"), "xyz"), traj.atoms, cells)


def select_atoms(traj: Trajectory, selection: str) -> Trajectory:
    """S1, P1. The trajectory of the atoms that a selection expression names, renumbered from 0."""
    from helixframe.selection import compile_selection

    chosen = [r.atom_idx for r in traj.atoms.filter(compile_selection(selection)).select("atom_idx").orderBy("atom_idx").collect()]
    if not chosen:
        raise ValueError(f"selection {selection!r} names no atom")
    at = F.array(*[F.lit(3 * a + c) for a in chosen for c in range(3)])
    frames = traj.frames.select("frame", F.transform(at, lambda k: F.get("xyz", k)).alias("xyz"))
    rank = F.row_number().over(Window.orderBy("atom_idx")) - 1
    atoms = traj.atoms.filter(F.col("atom_idx").isin(chosen)).withColumn("atom_idx", rank.cast("int"))
    return Trajectory(frames, atoms, traj.cells)


def load(traj: Trajectory, selection: str = "name CA", step: int = 1) -> Trajectory:
    """S1. A selection of every step-th frame; no frame at all is an error."""
    out = stride(select_atoms(traj, selection), step) if step > 1 else select_atoms(traj, selection)
    if out.frames.isEmpty():
        raise ValueError("no frame was read")
    return out


def memory_message(traj: Trajectory) -> str:
    """The size of the dense coordinates, with the marks of 1 GB and 4 GB."""
    size = traj.n_frames * traj.n_atoms * 24
    if size < 1e9:
        return f"{traj.n_frames} frames, {traj.n_atoms} atoms"
    return f"{traj.n_frames} frames, {traj.n_atoms} atoms, {size / 1e9:.1f} GB dense" + (" (large)" if size >= 4e9 else "")
