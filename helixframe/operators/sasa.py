"""N21. Solvent-accessible surface area by rolling a probe over sphere points.

Each pair of neighbouring atoms gives the points of the first's sphere that the second covers, as a
mask of bits in a few longs; the masks of an atom are OR-ed together, and the bits that are not set are
its exposed points.  Pairs, masks and sums are columns and aggregations: the atoms of one frame may be
spread over any number of tasks, and no task needs a frame whole.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.model import Trajectory

# Van der Waals radii in Å by element, the default radius, and the number of sphere points.
RADII = {
    "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80, "H": 1.20, "F": 1.47, "CL": 1.75, "Cl": 1.75, "BR": 1.85, "Br": 1.85,
    "I": 1.98, "CA": 2.31, "Ca": 2.31, "ZN": 1.39, "Zn": 1.39, "MG": 1.73, "Mg": 1.73, "FE": 1.52, "Fe": 1.52,
}
DEFAULT_RADIUS = 1.70
POINTS = 92
#: Points of one mask. Each mask has a function of its own in the compiled aggregation, which holds the mask's bits more than
#: once; beyond 8,000 bytes the JVM would not compile it, and a pair of atoms would take ten times as long.
MASK_BITS = 12
#: Atoms up to which all pairs of a frame are made from its row; beyond, a cell grid is joined.
MAX_INROW_ATOMS = 64


def sphere(n: int = POINTS) -> np.ndarray:
    """Points spread over the unit sphere along a golden-angle spiral from pole to pole."""
    k = np.arange(n)
    y = 1 - 2 * k / (n - 1)
    ring = np.sqrt(np.maximum(0, 1 - y * y))
    turn = np.pi * (3 - np.sqrt(5)) * k
    return np.stack([ring * np.cos(turn), y, ring * np.sin(turn)], axis=1)


def _atom_table(traj: Trajectory, probe: float) -> DataFrame:
    """atom_idx, r (the probe included), res_idx, residue; a residue is a run of consecutive atoms of one label RES SEQ."""
    rows, previous, run = [], None, -1
    for a in traj.atom_rows:
        label = f"{a.res_name} {a.res_seq}"
        run += label != previous
        rows.append((a.atom_idx, RADII.get(a.element, DEFAULT_RADIUS) + probe, run, label))
        previous = label
    return traj.spark.createDataFrame(rows, "atom_idx int, r double, res_idx int, residue string")


def _pairs_in_rows(traj: Trajectory, radii: list[float]) -> DataFrame:
    """frame, i, r of atom i, r2 of atom j, and the vector u from j to i, for all atoms i and j of a frame's row, i itself included."""
    r = F.array(*map(F.lit, radii))
    atoms = F.sequence(F.lit(0), F.lit(len(radii) - 1))
    at = lambda k, c: F.get("xyz", F.col(k) * 3 + c)
    left = traj.whole_frames.select("frame", "xyz", F.explode(atoms).alias("i"))
    left = left.select("frame", "xyz", "i", *[at("i", c).alias(f"a{c}") for c in range(3)])
    both = left.withColumn("j", F.explode(atoms))
    return both.select("frame", "i", F.get(r, "i").alias("r"), F.get(r, "j").alias("r2"), (F.col("i") == F.col("j")).alias("self"), *[(F.col(f"a{c}") - at("j", c)).alias(f"u{c}") for c in range(3)])


def _pairs_in_cells(traj: Trajectory, atoms: DataFrame, width: float) -> DataFrame:
    """The same for the atoms of cells as wide as two of the largest spheres and of their 26 neighbours."""
    long = traj.where(traj.whole_frames).long.join(atoms.select("atom_idx", "r"), "atom_idx")
    cell = [F.floor(F.col(c) / width) for c in "xyz"]
    left = long.select("frame", F.col("atom_idx").alias("i"), "r", *[F.col(c).alias(f"a{k}") for k, c in enumerate("xyz")], *[c.alias(f"c{k}") for k, c in enumerate(cell)])
    steps = F.explode(F.array(*[F.array(*map(F.lit, (a, b, c))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    right = long.withColumn("s", steps).select(
        "frame", F.col("atom_idx").alias("j"), F.col("r").alias("r2"), *[F.col(c).alias(f"b{k}") for k, c in enumerate("xyz")],
        *[(c + F.col("s")[k]).alias(f"c{k}") for k, c in enumerate(cell)],
    )
    met = left.join(right, ["frame", "c0", "c1", "c2"])
    return met.select("frame", "i", "r", "r2", (F.col("i") == F.col("j")).alias("self"), *[(F.col(f"a{c}") - F.col(f"b{c}")).alias(f"u{c}") for c in range(3)])


def _mask(points: np.ndarray) -> Column:
    """The bits of the points that lie within the other sphere: u . s below the threshold t of the pair.

    A tree of plain operators, which is compiled; functions of arrays are not.
    """
    bits = [
        F.when(F.col("u0") * float(x) + F.col("u1") * float(y) + F.col("u2") * float(z) < F.col("t"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        for k, (x, y, z) in enumerate(points)
    ]
    return reduce(Column.bitwiseOR, bits)


def atom_series(traj: Trajectory, probe: float = 1.4, max_inrow: int = MAX_INROW_ATOMS) -> DataFrame:
    """frame, atom_idx, sasa: the exposed area of each atom in each frame."""
    radii = [RADII.get(a.element, DEFAULT_RADIUS) + probe for a in traj.atom_rows]
    if not radii:
        return traj.spark.createDataFrame([], "frame long, atom_idx int, sasa double")
    if len(radii) <= max_inrow:
        pairs = _pairs_in_rows(traj, radii)
    else:
        pairs = _pairs_in_cells(traj, _atom_table(traj, probe), 2 * max(radii))
    d2 = F.col("u0") * F.col("u0") + F.col("u1") * F.col("u1") + F.col("u2") * F.col("u2")
    reach = F.col("r") + F.col("r2")
    near = pairs.withColumn("d2", d2).filter(F.col("self") | (F.col("d2") < reach * reach))
    # |u + r s|^2 < r2^2 solved for u . s; an atom does not cover itself.
    limit = F.when(F.col("self"), F.lit(float("-inf"))).otherwise((F.col("r2") * F.col("r2") - F.col("r") * F.col("r") - F.col("d2")) / (2.0 * F.col("r")))
    # A coordinate that is missing covers nothing; without nulls the code of a bit is shorter by half.
    known = [F.coalesce(F.col(f"u{c}"), F.lit(float("nan"))).alias(f"u{c}") for c in range(3)]
    shown = near.select("frame", "i", "r", F.coalesce(limit, F.lit(float("-inf"))).alias("t"), *known)
    parts = [sphere()[k : k + MASK_BITS] for k in range(0, POINTS, MASK_BITS)]
    covered = shown.groupBy("frame", "i", "r").agg(*[F.bit_or(_mask(part)).alias(f"m{n}") for n, part in enumerate(parts)])
    exposed = reduce(lambda left, n: left - F.bit_count(f"m{n}"), range(len(parts)), F.lit(POINTS))
    return covered.select("frame", F.col("i").alias("atom_idx"), (F.lit(4 * np.pi) * F.col("r") * F.col("r") * exposed / F.lit(float(POINTS))).alias("sasa"))


def residue_series(traj: Trajectory, probe: float = 1.4, max_inrow: int = MAX_INROW_ATOMS) -> DataFrame:
    """frame, res_idx, residue, sasa of each residue in each frame."""
    named = _atom_table(traj, probe).drop("r")
    return atom_series(traj, probe, max_inrow).join(named, "atom_idx").groupBy("frame", "res_idx", "residue").agg(F.sum("sasa").alias("sasa"))


def per_residue(areas: DataFrame) -> DataFrame:
    """res_idx, residue, mean_sasa, std_sasa (population)."""
    return areas.groupBy("res_idx", "residue").agg(F.avg("sasa").alias("mean_sasa"), F.stddev_pop("sasa").alias("std_sasa"))


def total(areas: DataFrame) -> DataFrame:
    """frame, total_sasa."""
    return areas.groupBy("frame").agg(F.sum("sasa").alias("total_sasa"))
