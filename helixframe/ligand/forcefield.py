"""A small force field: springs for bonds and angles, a soft wall between all other pairs."""

from __future__ import annotations

import math

import numpy as np

from helixframe.ligand.molecule import DRAWN_BOND, Molecule

# Single-bond radii (Å) and electronegativities by element.
RADIUS = {
    "H": 0.354, "C": 0.757, "N": 0.700, "O": 0.658, "S": 1.050, "P": 1.070, "F": 0.570, "Cl": 1.020, "Br": 1.200, "I": 1.390,
    "B": 0.840, "Si": 1.110, "Na": 1.144, "Mg": 1.184, "Al": 1.213, "K": 1.468, "Ca": 1.429, "Fe": 1.243, "Zn": 1.278, "Se": 1.220,
}
ELECTRONEGATIVITY = {
    "H": 2.20, "C": 2.55, "N": 3.04, "O": 3.44, "S": 2.58, "P": 2.19, "F": 3.98, "Cl": 3.16, "Br": 2.96, "I": 2.66, "B": 2.04, "Si": 1.90,
}
# Equilibrium angles in degrees by element, up to a number of neighbours.
ANGLES = {
    "C": [(2, 180.0), (3, 120.0), (99, 109.47)], "N": [(2, 120.0), (99, 107.0)], "O": [(1, 180.0), (99, 104.5)],
    "S": [(2, 104.5), (99, 109.5)], "P": [(2, 104.5), (99, 109.5)], "Si": [(99, 109.47)], "B": [(99, 120.0)],
}
# Default radius, electronegativity and angle; stretch, bend and wall constants; wall radius.
OTHER_RADIUS, OTHER_CHI, OTHER_ANGLE = 0.9, 2.0, 109.47
STRETCH, BEND, WALL, WALL_RADIUS = 700.0, 150.0, 200.0, 2.5


def bond_length(a: str, b: str, order: int = 1) -> float:
    """B1. Radii, less what bond order and the difference of electronegativities shorten; 0.8 at least."""
    ra, rb = RADIUS.get(a, OTHER_RADIUS), RADIUS.get(b, OTHER_RADIUS)
    xa, xb = ELECTRONEGATIVITY.get(a, OTHER_CHI), ELECTRONEGATIVITY.get(b, OTHER_CHI)
    n = order if order in (2, 3) else 1
    shorter = ra * rb * (math.sqrt(xa) - math.sqrt(xb)) ** 2 / (ra * xa + rb * xb)
    return max(0.8, (ra + rb) * (1 - 0.1332 * math.log(n)) - shorter)


def bond_angle(element: str, neighbours: int) -> float:
    """B1. Degrees."""
    return next((a for most, a in ANGLES.get(element, [(99, OTHER_ANGLE)]) if neighbours <= most), OTHER_ANGLE)


class ForceField:
    """B2-B4. Energies of a molecule's coordinates, of many sets of coordinates at once."""

    def __init__(self, molecule: Molecule):
        self.n = len(molecule.atoms)
        near = [[w for w, _ in x] for x in molecule.neighbours()]
        element = [a.element for a in molecule.atoms]
        self.bonds = np.array([(b.a, b.b) for b in molecule.bonds], int).reshape(-1, 2)
        self.lengths = np.array([bond_length(element[b.a], element[b.b], b.order) for b in molecule.bonds])
        angles = [(x, c, y) for c in range(self.n) for k, x in enumerate(near[c]) for y in near[c][k + 1 :]]
        self.angles = np.array(angles, int).reshape(-1, 3)
        self.theta = np.radians([bond_angle(element[c], len(near[c])) for _, c, _ in angles])
        tied = {frozenset(p) for p in self.bonds.tolist()} | {frozenset((a, b)) for a, _, b in angles}
        far = [(i, j) for i in range(self.n) for j in range(i + 1, self.n) if frozenset((i, j)) not in tied]
        self.far = np.array(far, int).reshape(-1, 2)

    def energy(self, at: np.ndarray) -> np.ndarray:
        """Energies of coordinates (..., atoms, 3)."""
        gap = lambda p: np.sqrt(((at[..., p[:, 0], :] - at[..., p[:, 1], :]) ** 2).sum(axis=-1))
        stretch = STRETCH * ((gap(self.bonds) - self.lengths) ** 2).sum(axis=-1)
        u = at[..., self.angles[:, 0], :] - at[..., self.angles[:, 1], :]
        v = at[..., self.angles[:, 2], :] - at[..., self.angles[:, 1], :]
        nu, nv = np.sqrt((u**2).sum(axis=-1)), np.sqrt((v**2).sum(axis=-1))
        short = (nu < 1e-9) | (nv < 1e-9)
        cosine = (u * v).sum(axis=-1) / np.where(short, 1.0, nu * nv)
        theta = np.where(short, np.pi / 2, np.arccos(np.clip(cosine, -1, 1)))
        bend = BEND * ((theta - self.theta) ** 2).sum(axis=-1)
        overlap = np.maximum(0.0, WALL_RADIUS - np.maximum(0.1, gap(self.far)))
        return stretch + bend + WALL * (overlap**3).sum(axis=-1)

    def gradient(self, at: np.ndarray, h: float = 1e-4) -> np.ndarray:
        """B3. Forward differences, all 3N moved copies in one evaluation."""
        moved = at[None] + h * np.eye(3 * self.n).reshape(-1, self.n, 3)
        return ((self.energy(moved) - self.energy(at)) / h).reshape(self.n, 3)


class _Jitter:
    """The xorshift generator that lifts branched atoms out of the plane."""

    def __init__(self, seed: int = 12345):
        self.s = seed

    def __call__(self) -> float:
        mask = (1 << 64) - 1
        self.s ^= (self.s << 13) & mask
        self.s ^= self.s >> 7
        self.s ^= (self.s << 17) & mask
        return (self.s & 0xFFFFFF) / 0xFFFFFF - 0.5


def generate_coordinates(molecule: Molecule, steps: int = 300) -> np.ndarray:
    """B5. Coordinates in Å from the drawing: mean bond 1.54, branched atoms lifted, then normalised descent."""
    if not molecule.atoms:
        raise ValueError("the molecule has no atoms")
    flat = np.array([(a.x, a.y) for a in molecule.atoms])
    drawn = [math.dist(flat[b.a], flat[b.b]) for b in molecule.bonds]
    scale = 1.54 / max(1.0, sum(drawn) / len(drawn) if drawn else DRAWN_BOND)
    near, jitter = molecule.neighbours(), _Jitter()
    lifted = [len(n) > 3 or (len(n) == 3 and a.element != "C") for n, a in zip(near, molecule.atoms)]
    at = np.column_stack([flat * scale, [jitter() * 0.5 if up else 0.0 for up in lifted]])
    field, rate = ForceField(molecule), 0.05
    for step in range(steps):
        g = field.gradient(at)
        size = np.linalg.norm(g)
        if size < 0.01:
            break
        at = at - rate * g / max(1.0, size)
        if step % 50 == 49:
            rate *= 0.8
    return at


def minimise(molecule: Molecule, at: np.ndarray, steps: int = 500, tolerance: float = 1e-4) -> tuple[np.ndarray, int, float]:
    """B6. Steepest descent with halved steps until the energy falls; coordinates, steps and energy."""
    field, rate, last, ran = ForceField(molecule), 0.05, math.inf, 0
    for step in range(steps):
        energy = float(field.energy(at))
        if abs(last - energy) < tolerance and step > 10:
            ran = step
            break
        last, ran = energy, step + 1
        g = field.gradient(at)
        size = float(np.linalg.norm(g))
        if size < tolerance * 0.1:
            break
        trial = rate
        for _ in range(10):
            moved = at - trial * g / max(1e-9, size)
            if field.energy(moved) < energy:
                at, rate = moved, trial
                break
            trial *= 0.5
        if step % 100 == 99:
            rate = min(0.1, rate * 1.2)
    return at, ran, float(field.energy(at))
