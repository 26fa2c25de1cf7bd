"""Correlated motion: cross-correlation, contacts, hydrogen bonds, perturbation response, mutual information."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.model import Trajectory
from helixframe.plans.primitives import close_pairs, displacement_products, entries, matrix


def dccm_matrix(traj: Trajectory) -> np.ndarray:
    g = displacement_products(traj)
    size = np.sqrt(np.maximum(0, np.diag(g)))
    scale = np.outer(size, size)
    return np.where(scale > 1e-9, g / np.where(scale > 1e-9, scale, 1), 0.0)


def dccm(traj: Trajectory) -> DataFrame:
    """N5. i, j, value: normalised displacement cross-correlation; 0 where an atom does not move."""
    return entries(traj.spark, dccm_matrix(traj))


def contacts(traj: Trajectory, cutoff: float = 8.0, apart: int = 2, max_inrow: int = 512) -> DataFrame:
    """N6. i, j, freq of the pairs ever in contact, both orders: the share of frames within the cutoff.

    Pairs whose residues are at most `apart` apart in sequence are left out; all others are zero.
    """
    seq = traj.atoms.select(F.col("atom_idx").alias("i"), F.col("res_seq").alias("si"))
    other = seq.select(F.col("i").alias("j"), F.col("si").alias("sj"))
    counts = close_pairs(traj, cutoff, max_inrow=max_inrow).groupBy("i", "j").agg(F.count("*").alias("n"))
    far = counts.join(seq, "i").join(other, "j").filter(F.abs(F.col("si") - F.col("sj")) > apart)
    upper = far.select("i", "j", (F.col("n") / F.lit(float(traj.n_frames))).alias("freq"))
    return upper.unionByName(upper.select(F.col("j").alias("i"), F.col("i").alias("j"), "freq"))


def contact_map(traj: Trajectory, cutoff: float = 8.0) -> DataFrame:
    """contacts() as a full matrix of N x N rows, for atoms whose matrix is wanted whole."""
    atoms = traj.atoms.select(F.col("atom_idx").alias("i"))
    grid = atoms.crossJoin(F.broadcast(atoms.select(F.col("i").alias("j"))))  # the matrix asked for, N x N by definition
    return grid.join(contacts(traj, cutoff), ["i", "j"], "left").withColumn("freq", F.coalesce("freq", F.lit(0.0)))


def polar_atoms(traj: Trajectory) -> list[int]:
    """P9. Nitrogens and oxygens, or all atoms if there are none."""
    polar = [r.atom_idx for r in traj.atom_rows if r.element in ("N", "O")]
    return polar or [r.atom_idx for r in traj.atom_rows]


def hydrogen_bonds(traj: Trajectory, cutoff: float = 3.5, min_occupancy: float = 0.05) -> DataFrame:
    """N7. donor, acceptor, occupancy, mean_dist of polar pairs near in at least that share of the frames."""
    near = close_pairs(traj, cutoff, polar_atoms(traj)).groupBy("i", "j").agg(F.count("*").alias("n"), F.avg("d").alias("mean_dist"))
    found = near.select(
        F.col("i").alias("donor"), F.col("j").alias("acceptor"), (F.col("n") / F.lit(float(traj.n_frames))).alias("occupancy"), "mean_dist"
    )
    return found.filter(F.col("occupancy") >= min_occupancy).orderBy(F.desc("occupancy"), "donor", "acceptor")


def _response(traj: Trajectory) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = displacement_products(traj) / max(1, traj.n_frames)
    own = np.maximum(np.diag(c), 1e-12) if len(c) else np.zeros(0)
    scale = np.sqrt(np.outer(own, own))
    size = np.abs(c)
    off = size - np.diag(np.diag(size))
    return size / scale if len(c) else c, off.sum(axis=1) / own, off.sum(axis=0) / own


def prs_matrix(traj: Trajectory) -> DataFrame:
    """N16. i, j, value: absolute covariance of displacements over the geometric mean of variances."""
    return entries(traj.spark, _response(traj)[0])


def prs_profiles(traj: Trajectory) -> DataFrame:
    """N16. atom_idx, effectiveness, sensitivity, each over its largest value.

    The covariance is symmetric, so the two are equal; both are kept for the exports that name them.
    """
    _, give, take = _response(traj)
    norm = lambda v: v / v.max() if len(v) and v.max() >= 1e-12 else v
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(norm(give), norm(take)))]
    return traj.spark.createDataFrame(rows, "atom_idx int, effectiveness double, sensitivity double")


#: Atoms of a block, frames that a task codes at once, and frames whose joint counts are made in one group.
NMI_BLOCK, NMI_CHUNK, NMI_FRAMES = 32, 4096, 65_536


def mutual_information(traj: Trajectory) -> DataFrame:
    """N17. i, j, value: normalised mutual information of displacement lengths, both orders and the diagonal.

    Lengths are binned by each atom's padded range.  One pass over the frames makes a byte code of each
    atom in each frame, packed by blocks of NMI_BLOCK atoms; every two blocks of the same frames meet in one
    group, which counts the joint codes of their atoms, so neither the atoms nor the frames are bounded by
    what a task holds.  Bytes were preferred to one bitmap a bin: counting a pair of atoms takes one look-up a
    frame, where bitmaps take bins x bins words for every 64 frames.
    """
    mean, n, frames = traj.mean, traj.n_atoms, traj.n_frames
    bins = int(min(50, max(5, np.floor(np.sqrt(frames)))))

    def lengths(x):
        return np.sqrt(((x - mean).reshape(len(x), -1, 3) ** 2).sum(axis=2))

    spread = _ranges(traj, lengths)
    low, high = spread[0], spread[1]
    pad = (high - low) * 0.01 + 1e-12
    low, width = low - pad, (high - low) + 2 * pad
    blocks, groups = -(-n // NMI_BLOCK), max(1, -(-frames // NMI_FRAMES))

    def coded(batches):
        from pyspark import TaskContext

        task, k, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            codes = np.concatenate(held)
            parts = [codes[:, b * NMI_BLOCK : (b + 1) * NMI_BLOCK].tobytes() for b in range(blocks)]
            where = hash((task, k)) % groups
            return pa.RecordBatch.from_pydict({"g": [where] * blocks, "chunk": [f"{task:08d}-{k:08d}"] * blocks, "b": range(blocks), "codes": parts}, schema=_CODES)

        for b in batches:
            for lo in range(0, b.num_rows, NMI_CHUNK):
                x = matrix(b.column(0).slice(lo, NMI_CHUNK))
                held.append(np.clip(((lengths(x) - low) / width * bins).astype(int), 0, bins - 1).astype(np.uint8))
                rows += len(x)
                if rows >= NMI_CHUNK:
                    yield packed()
                    k, held, rows = k + 1, [], 0
        if held:
            yield packed()

    def counted(t: pa.Table) -> pa.Table:
        p, q = t["p"][0].as_py(), t["q"][0].as_py()
        sizes = [min(NMI_BLOCK, n - b * NMI_BLOCK) for b in (p, q)]
        t = t.sort_by("chunk")
        sides = []
        for b, size in zip((p, q), sizes):
            own = t.filter(pa.compute.equal(t["b"], b))
            sides.append(np.concatenate([np.frombuffer(c, np.uint8).reshape(-1, size) for c in own["codes"].to_pylist()]).astype(np.int64))
        left, right = sides
        out = []
        for a in range(sizes[0]):  # one atom of the one block with all of the other
            cell = (np.arange(sizes[1]) * bins + left[:, a, None]) * bins + right
            count = np.bincount(cell.ravel(), minlength=sizes[1] * bins * bins)
            at = np.flatnonzero(count)
            out.append((np.full(len(at), p * NMI_BLOCK + a), q * NMI_BLOCK + at // (bins * bins), at % (bins * bins), count[at]))
        i, j, cell, count = (np.concatenate(c) for c in zip(*out))
        there = i <= j
        return pa.table({"i": i[there].astype(np.int32), "j": j[there].astype(np.int32), "b": cell[there].astype(np.int32), "n": count[there]})

    codes = traj.whole_frames.select("xyz").mapInArrow(coded, "g long, chunk string, b int, codes binary")
    # A block meets every other once, the one of the lower number first; it is sent once for each.
    other = F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))
    met = codes.withColumn("o", F.explode(other)).select("g", "chunk", "b", "codes", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))
    counts = met.groupBy("g", "p", "q").applyInArrow(counted, "i int, j int, b int, n long")
    joint = counts.groupBy("i", "j", "b").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.lit(float(frames))
    upper = joint.groupBy("i", "j").agg(F.sum(-share * F.ln(share)).alias("h"))
    own = upper.filter("i = j").select(F.col("i").alias("k"), "h")
    hi, hj = own.select(F.col("k").alias("i"), F.col("h").alias("hi")), own.select(F.col("k").alias("j"), F.col("h").alias("hj"))
    scale = F.sqrt(F.col("hi") * F.col("hj"))
    value = F.when(F.col("i") == F.col("j"), 1.0).when(scale < 1e-12, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("hi") + F.col("hj") - F.col("h"), scale)))
    )
    told = upper.join(hi, "i").join(hj, "j").select("i", "j", value.alias("value"))
    # Both orders of a pair from one row, the diagonal once.
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return told.select(F.explode(both).alias("at"), "value").select("at.i", "at.j", "value")


_CODES = pa.schema([("g", pa.int64()), ("chunk", pa.string()), ("b", pa.int32()), ("codes", pa.binary())])


def _ranges(traj: Trajectory, lengths) -> np.ndarray:
    """The least and largest of each column of a batch statistic, over all frames."""

    def run(batches):
        out = None
        for b in batches:
            if b.num_rows:
                x = lengths(matrix(b.column(0)))
                part = np.stack([x.min(axis=0), x.max(axis=0)])
                out = part if out is None else np.stack([np.minimum(out[0], part[0]), np.maximum(out[1], part[1])])
        if out is not None:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(3, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([0, 1]), lists], names=["i", "v"])

    parts = traj.whole_frames.select("xyz").mapInArrow(run, "i long, v array<double>").select("i", F.posexplode("v").alias("k", "x"))
    rows = parts.groupBy("k").agg(F.min(F.when(F.col("i") == 0, F.col("x"))).alias("lo"), F.max(F.when(F.col("i") == 1, F.col("x"))).alias("hi")).collect()
    out = np.zeros((2, traj.n_atoms))
    for r in rows:
        out[:, r.k] = r.lo, r.hi
    return out
