"""N15. Backbone and pseudo dihedrals, their summaries, densities and regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.expr import bin_index, finite
from helixframe.model import Trajectory
from helixframe.plans.primitives import map_frames

BINS = 60


def residues(traj: Trajectory) -> tuple[str, list[dict]]:
    """The mode, and the residues in order of appearance with their atoms; a residue is a (res_seq, chain).

    Backbone mode holds if more than half of the residues have N, CA and C; others are then left out.
    """
    found: dict[tuple, dict] = {}
    for r in traj.atom_rows:
        one = found.setdefault((r.res_seq, r.chain_id), {"first": r.atom_idx, "res_seq": r.res_seq, "names": {}})
        one["names"].setdefault(r.atom_name, r.atom_idx)
    name_of = {r.atom_idx: r.res_name for r in traj.atom_rows}
    whole = [x for x in found.values() if {"N", "CA", "C"} <= x["names"].keys()]
    if len(whole) > len(found) // 2:
        chosen, mode = [{**x, "atom": x["names"]["CA"]} for x in whole], "backbone"
    else:
        chosen, mode = [{**x, "atom": x["names"].get("CA", x["first"])} for x in found.values()], "pseudodihedral"
    for x in chosen:
        x["res_name"] = name_of[x["atom"]]
    return mode, chosen


def _quads(mode: str, chosen: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The four atoms of each residue's phi and psi; -1 where an angle is undefined."""
    quads = np.full((2, len(chosen), 4), -1)
    for k, r in enumerate(chosen):
        if mode == "backbone":
            at = r["names"]
            if k > 0:
                quads[0, k] = chosen[k - 1]["names"]["C"], at["N"], at["CA"], at["C"]
            if k < len(chosen) - 1:
                quads[1, k] = at["N"], at["CA"], at["C"], chosen[k + 1]["names"]["N"]
        elif 0 < k < len(chosen) - 2:
            quads[0, k] = [chosen[k + d]["atom"] for d in (-1, 0, 1, 2)]
    return quads[0], quads[1]


def torsions(at: np.ndarray, quads: np.ndarray) -> np.ndarray:
    """Signed torsions in degrees, frames x quads; nan where an atom is missing or the middle two are closer than 1e-10."""
    a, b, c, d = (at[:, quads[:, k]] for k in range(4))
    axis = c - b
    n1, n2 = np.cross(b - a, axis), np.cross(axis, d - c)
    length = np.sqrt((axis**2).sum(axis=2))
    good = (length >= 1e-10) & (quads[:, 0] >= 0)
    sine = (np.cross(n1, axis) * n2).sum(axis=2) / np.where(good, length, 1.0)
    return np.where(good, -np.degrees(np.arctan2(sine, (n1 * n2).sum(axis=2))), np.nan)


def series(traj: Trajectory) -> DataFrame:
    """res_idx, res_seq, res_name, atom_idx, frame, phi, psi in degrees; undefined angles are null.

    Angles are array arithmetic on batches of frames; nothing is shuffled.
    """
    mode, chosen = residues(traj)
    phi_atoms, psi_atoms = _quads(mode, chosen)
    n = len(chosen)
    seq, atom = np.array([r["res_seq"] for r in chosen], np.int64), np.array([r["atom"] for r in chosen], np.int32)
    names = [r["res_name"] for r in chosen]

    def make(frames, x):
        at, m = x.reshape(len(x), -1, 3), len(x)
        phi, psi = (torsions(at, q).ravel() for q in (phi_atoms, psi_atoms))
        return {
            "res_idx": np.tile(np.arange(n, dtype=np.int32), m), "res_seq": np.tile(seq, m), "res_name": names * m, "atom_idx": np.tile(atom, m),
            "frame": np.repeat(frames, n), "phi": pa.array(phi, mask=np.isnan(phi)), "psi": pa.array(psi, mask=np.isnan(psi)),
        }

    return map_frames(traj, "res_idx int, res_seq long, res_name string, atom_idx int, frame long, phi double, psi double", make)


def summary(angles: DataFrame, circular: bool = False) -> DataFrame:
    """A row a residue: means, population standard deviations, and the smaller number of defined angles.

    Means and deviations are linear, across +-180 too; with circular they are of directions.
    """
    keys = ["res_idx", "res_seq", "res_name", "atom_idx"]

    def both(c: str) -> list[Column]:
        x = F.when(finite(F.col(c)), F.col(c))
        if not circular:
            return [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std")]
        s, k = F.avg(F.sin(F.radians(x))), F.avg(F.cos(F.radians(x)))
        length = F.greatest(F.lit(1e-300), F.sqrt(s * s + k * k))
        return [F.degrees(F.atan2(s, k)).alias(f"{c}_mean"), F.degrees(F.sqrt(-2 * F.ln(F.least(F.lit(1.0), length)))).alias(f"{c}_std")]

    n = [F.count(F.when(finite(F.col(c)), 1)) for c in ("phi", "psi")]
    return angles.groupBy(*keys).agg(*both("phi"), *both("psi"), F.least(*n).alias("n_valid"))


def density(angles: DataFrame, bins: int = BINS) -> DataFrame:
    """psi_bin, phi_bin, density of the bins with pairs of angles, relative to the fullest."""
    pairs = angles.filter(finite(F.col("phi")) & finite(F.col("psi")))
    counts = pairs.groupBy(
        bin_index(F.col("psi"), -180.0, 360.0, bins).alias("psi_bin"), bin_index(F.col("phi"), -180.0, 360.0, bins).alias("phi_bin")
    ).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select("psi_bin", "phi_bin", (F.col("n") / F.col("top")).alias("density"))


def dense_density(angles: DataFrame, bins: int = BINS) -> DataFrame:
    """density() with the empty bins as zeros."""
    spark = angles.sparkSession
    grid = spark.range(bins * bins).select((F.col("id") / bins).cast("int").alias("psi_bin"), (F.col("id") % bins).cast("int").alias("phi_bin"))
    return grid.join(density(angles, bins), ["psi_bin", "phi_bin"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def region(phi: Column, psi: Column) -> Column:
    """P15. alpha, beta or other."""
    return (
        F.when(phi.between(-145, -30) & psi.between(-60, 20), "alpha")
        .when(phi.between(-170, -55) & (psi >= 90), "beta").otherwise("other")
    )


def regions(angles: DataFrame) -> DataFrame:
    """region, n, share of the pairs of defined angles."""
    pairs = angles.filter(finite(F.col("phi")) & finite(F.col("psi")))
    counts = pairs.groupBy(region(F.col("phi"), F.col("psi")).alias("region")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("region", "n", (F.col("n") / F.col("total")).alias("share"))


def lookup(angles: DataFrame, atom_indices: list[int]) -> DataFrame:
    """P7. The series of the residues with these representative atoms, numbered in the order asked for."""
    wanted = angles.sparkSession.createDataFrame([(i, a) for i, a in enumerate(atom_indices)], "request int, atom_idx int")
    found = angles.join(F.broadcast(wanted), "atom_idx")
    if found.isEmpty():
        raise ValueError(f"no residue has the atoms {atom_indices}")
    return found.select("request", "res_idx", "res_seq", "res_name", "atom_idx", "frame", "phi", "psi")
