"""The data model: a trajectory as one row a frame, its atoms and its cells.

The wide form, a frame's 3N coordinates in one array, is the one the operators work on: what
concerns a frame alone then needs no shuffle.  The long form, a row a frame and atom, is for
relational work; either is derived from the other.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATOMS_SCHEMA = T.StructType(
    [
        T.StructField("atom_idx", T.IntegerType()),
        T.StructField("atom_name", T.StringType()),
        T.StructField("res_name", T.StringType()),
        T.StructField("chain_id", T.StringType()),
        T.StructField("res_seq", T.LongType()),
        T.StructField("element", T.StringType()),
    ]
)

#: Atoms beyond which per-atom vectors no longer travel to the driver (3N doubles, 48 MB).
MAX_DRIVER_ATOMS = 2_000_000


class Trajectory:
    """Frames, atoms and, if known, periodic cells.

    frames: frame long, xyz array<double> of 3N coordinates in atom order.
    atoms: ATOMS_SCHEMA, atom_idx 0..N-1.  cells: frame long, a, b, c double.
    """

    def __init__(self, frames: DataFrame, atoms: DataFrame, cells: DataFrame | None = None):
        self.frames, self.atoms, self.cells = frames.select("frame", "xyz"), atoms, cells

    @property
    def spark(self) -> SparkSession:
        return self.frames.sparkSession

    @cached_property
    def atom_rows(self) -> list:
        """The atoms on the driver; a trajectory's atoms are its dimension table, bounded by MAX_DRIVER_ATOMS."""
        rows = self.atoms.orderBy("atom_idx").limit(MAX_DRIVER_ATOMS + 1).collect()
        if len(rows) > MAX_DRIVER_ATOMS:
            raise ValueError(f"more than {MAX_DRIVER_ATOMS} atoms; analyse a selection")
        return rows

    @property
    def n_atoms(self) -> int:
        return len(self.atom_rows)

    @property
    def whole_frames(self) -> DataFrame:
        """The frames that have a coordinate for each atom; those without coordinates or with others count for nothing."""
        return self.frames.filter(F.size("xyz") == 3 * self.n_atoms)

    @cached_property
    def n_frames(self) -> int:
        return self.whole_frames.count()

    @property
    def long(self) -> DataFrame:
        """frame, atom_idx, x, y, z."""
        atoms = F.sequence(F.lit(0), F.lit(self.n_atoms - 1))
        return self.frames.select("frame", "xyz", F.explode(atoms).alias("atom_idx")).select(
            "frame", "atom_idx", *[F.get("xyz", F.col("atom_idx") * 3 + c).alias("xyz"[c]) for c in range(3)]
        )

    @cached_property
    def mean(self) -> np.ndarray:
        """Mean coordinates, 3N of them."""
        from helixframe.plans.primitives import mean_vector

        return mean_vector(self)

    def where(self, frames: DataFrame) -> Trajectory:
        return Trajectory(frames, self.atoms, self.cells)


def from_long(long: DataFrame, atoms: DataFrame, cells: DataFrame | None = None) -> Trajectory:
    """A trajectory of rows frame, atom_idx, x, y, z; one shuffle brings each frame together."""
    packed = long.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("atom_idx", "x", "y", "z"))).alias("a"))
    flat = F.flatten(F.transform("a", lambda s: F.array(s["x"], s["y"], s["z"])))
    return Trajectory(packed.select("frame", flat.alias("xyz")), atoms, cells)


def atoms_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ATOMS_SCHEMA)
