"""Principal components, elastic networks and entropy: small dense eigenproblems over distributed sums.

The matrices have 3N rows for N atoms; they are summed on the executors and decomposed on the
driver, so N is bounded by primitives.MAX_ROWS, but for the leading components of PCA, which need no matrix.  Eigenvectors have a fixed sign: their largest component, the
first of equal ones, is positive.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame

from helixframe.model import Trajectory
from helixframe.operators.structural import square_fluctuations
from helixframe.plans.primitives import MAX_ROWS, covariance, entries, map_frames, summed_vectors

_LOG = logging.getLogger(__name__)

# Constants of the quasi-harmonic entropy.
BOLTZMANN, AVOGADRO, HBAR = 1.380649e-23, 6.02214076e23, 1.054571817e-34
CARBON_KG, TEMPERATURE = 12.011 * 1.66054e-27, 300.0


def _eigh(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and signed eigenvectors as columns."""
    if len(m) > MAX_ROWS:
        raise ValueError(f"{len(m)} rows; at most {MAX_ROWS} are decomposed, analyse a selection")
    values, vectors = np.linalg.eigh(m)
    return values, _signed(vectors)


def _signed(vectors: np.ndarray) -> np.ndarray:
    if not vectors.size:
        return vectors
    lead = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[lead, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


#: Rows up to which the covariance is decomposed whole (72 MB); beyond, the leading components are found by themselves.
DENSE_ROWS = 3_000
#: Vectors that a pass over the frames multiplies, those of the basis at most, and the residual to stop at.
BLOCK, MAX_BASIS, RESIDUAL = 10, 400, 1e-9


def leading_components(traj: Trajectory, k: int = 20, block: int = BLOCK, max_basis: int = MAX_BASIS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, bool]:
    """The k largest eigenvalues of the covariance, their vectors as columns, and whether they have converged.

    Block Krylov iteration from random vectors, orthogonal throughout: a pass over the frames multiplies
    the covariance with a block, as (x - mean) times its own product with the block, summed on the executors. The 3N x 3N matrix is
    never made; the driver holds the basis, 3N by max_basis numbers at most, and what it was multiplied to.
    A component has converged if its residual is RESIDUAL of the largest eigenvalue; the basis may also
    come to hold all that the frames span, which is exact.
    """
    mean, frames = traj.mean, max(1, traj.n_frames)
    n = len(mean)
    k = min(k, n)
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((n, 0)), np.zeros((n, 0))
    new = np.linalg.qr(rng.normal(size=(n, min(block, n))))[0]
    while True:
        def product(x, q=new):
            d = x - mean
            return (d @ q).T @ d

        found = summed_vectors(traj, product, new.shape[1])
        image = found.T / frames if found.size else np.zeros_like(new)
        basis, images = np.hstack([basis, new]), np.hstack([images, image])
        small = basis.T @ images
        values, inside = np.linalg.eigh((small + small.T) / 2)
        lead = np.arange(len(values))[::-1][:k]
        values, vectors = values[lead], basis @ inside[:, lead]
        top = max(values[0], 0.0) if len(values) else 0.0
        rest = np.linalg.norm(images @ inside[:, lead] - vectors * values, axis=0)
        if len(lead) == k and (rest <= RESIDUAL * top).all():
            return np.maximum(values, 0), _signed(vectors), True
        new = image - basis @ (basis.T @ image)
        new -= basis @ (basis.T @ new)
        q, r = np.linalg.qr(new)
        there = np.abs(np.diag(r)) > 1e-10 * max(top, 1e-300)
        if not there.any() or basis.shape[1] >= n:  # the basis holds all that the frames span
            more = k - len(values)
            if more > 0:
                values = np.append(values, np.zeros(more))
                fill = rng.normal(size=(n, more))
                vectors = np.linalg.qr(np.hstack([vectors, fill]))[0]
            return np.maximum(values, 0), _signed(vectors), True
        if basis.shape[1] + there.sum() > max_basis:
            return np.maximum(values, 0), _signed(vectors), False
        new = q[:, there][:, : n - basis.shape[1]]
        new -= basis @ (basis.T @ new)
        new = np.linalg.qr(new)[0]


class Pca:
    """N4. Components of the coordinates' covariance in descending order.

    Of up to DENSE_ROWS coordinates these are all components; of more the leading ones, whose shares are of
    the total variance all the same, since the trace is summed by itself.
    """

    def __init__(self, traj: Trajectory, components: int = 20, dense_rows: int = DENSE_ROWS):
        self.traj = traj
        if 3 * traj.n_atoms <= dense_rows:
            values, vectors = _eigh(covariance(traj))
            self.values, self.vectors = values[::-1], vectors[:, ::-1]
            size = np.abs(values).sum()
        else:
            self.values, self.vectors, converged = leading_components(traj, components)
            if not converged:
                _LOG.warning("the leading components have not converged within %d vectors", MAX_BASIS)
            size = square_fluctuations(traj).sum()
        self.ratios = np.abs(self.values) / size if size else np.zeros(len(self.values))

    def variance(self) -> DataFrame:
        """component (from 1), eigenvalue, explained_variance of the components that were found."""
        rows = [(k + 1, float(v), float(r)) for k, (v, r) in enumerate(zip(self.values, self.ratios))]
        return self.traj.spark.createDataFrame(rows, "component int, eigenvalue double, explained_variance double")

    def loadings(self, top: int = 20) -> DataFrame:
        """component, loadings of the leading components."""
        rows = [(k + 1, self.vectors[:, k].tolist()) for k in range(min(top, len(self.values)))]
        return self.traj.spark.createDataFrame(rows, "component int, loadings array<double>")

    def projection(self) -> DataFrame:
        """frame, pc1, pc2."""
        mean, axes = self.traj.mean, self.vectors[:, :2]

        def make(frames, x):
            p = (x - mean) @ axes
            return {"frame": frames, "pc1": p[:, 0], "pc2": p[:, 1]}

        return map_frames(self.traj, "frame long, pc1 double, pc2 double", make)


def entropy(traj: Trajectory) -> DataFrame:
    """N14. entropy_j_per_mol_k and n_modes of the quasi-harmonic model at 300 K, every atom a carbon."""
    values, _ = _eigh(covariance(traj))
    kept = values[values > 1e-6 * max(0.0, values.max(initial=0.0))]
    scale = 2 * np.pi * np.e * BOLTZMANN * TEMPERATURE * CARBON_KG / HBAR**2 * 1e-20
    argument = scale * kept
    total = (BOLTZMANN / 2 * np.log(argument[argument > 1])).sum() * AVOGADRO
    return traj.spark.createDataFrame([(float(total), len(kept))], "entropy_j_per_mol_k double, n_modes int")


# ----------------------------------------------------------------------------------------------
# Elastic networks


def _springs(traj: Trajectory, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Differences r_j - r_i of all mean positions, and which pairs are within the cutoff."""
    at = traj.mean.reshape(-1, 3)
    gap = at[None, :, :] - at[:, None, :]
    near = (gap**2).sum(axis=2) <= cutoff**2
    np.fill_diagonal(near, False)
    return gap, near


def kirchhoff_matrix(traj: Trajectory, cutoff: float = 7.5) -> np.ndarray:
    """N8, GNM. -1 for each spring, the number of springs on the diagonal."""
    near = _springs(traj, cutoff)[1].astype(float)
    return np.diag(near.sum(axis=1)) - near


def hessian_matrix(traj: Trajectory, cutoff: float = 7.5) -> np.ndarray:
    """N8, ANM. Blocks -(r r^T)/r^2 for each spring, minus their sum on the diagonal."""
    gap, near = _springs(traj, cutoff)
    n = len(gap)
    r2 = np.where(near, (gap**2).sum(axis=2), 1.0)
    blocks = -gap[:, :, :, None] * gap[:, :, None, :] / r2[:, :, None, None] * near[:, :, None, None]
    i = np.arange(n)
    blocks[i, i] = -blocks.sum(axis=1)
    return blocks.transpose(0, 2, 1, 3).reshape(3 * n, 3 * n)


def kirchhoff(traj: Trajectory, cutoff: float = 7.5) -> DataFrame:
    return entries(traj.spark, kirchhoff_matrix(traj, cutoff))


def hessian(traj: Trajectory, cutoff: float = 7.5) -> DataFrame:
    return entries(traj.spark, hessian_matrix(traj, cutoff))


class ElasticNetwork:
    """N8. The modes of an elastic network about the mean structure; any model but GNM is ANM."""

    def __init__(self, traj: Trajectory, cutoff: float = 7.5, n_modes: int = 20, model: str = "ANM"):
        self.traj, self.model = traj, "GNM" if model.upper() == "GNM" else "ANM"
        m = kirchhoff_matrix(traj, cutoff) if self.model == "GNM" else hessian_matrix(traj, cutoff)
        self.spectrum, vectors = _eigh(m)
        skip = 1 if self.model == "GNM" else 6
        keep = slice(skip, skip + max(0, min(n_modes, traj.n_atoms - 1)))
        self.values, self.vectors = self.spectrum[keep], vectors[:, keep]

    def modes(self) -> DataFrame:
        """mode (from 1), eigenvalue, vector: values and vectors of one mode stand together."""
        rows = [(k + 1, float(v), self.vectors[:, k].tolist()) for k, v in enumerate(self.values)]
        return self.traj.spark.createDataFrame(rows, "mode int, eigenvalue double, vector array<double>")

    def bfactors(self) -> DataFrame:
        """atom_idx, bfactor: squared displacements over eigenvalues, summed over modes of nonzero eigenvalue."""
        good = np.abs(self.values) >= 1e-10
        size = (self.vectors[:, good] ** 2).reshape(self.traj.n_atoms, -1, good.sum()).sum(axis=1)
        b = (size / self.values[good]).sum(axis=1)
        return self.traj.spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "atom_idx int, bfactor double")

    def overlap(self) -> DataFrame:
        """N9. mode, overlap, cumulative: squared inner products with the trajectory's fluctuation vector."""
        if self.model == "GNM":
            raise ValueError("modes of a GNM have no direction; use ANM for the overlap")
        u = square_fluctuations(self.traj)
        size = np.linalg.norm(u)
        if size < 1e-12:
            raise ValueError("the trajectory does not move")
        each = (self.vectors.T @ (u / size)) ** 2
        rows = [(k + 1, float(a), float(b)) for k, (a, b) in enumerate(zip(each, np.cumsum(each)))]
        return self.traj.spark.createDataFrame(rows, "mode int, overlap double, cumulative double")
