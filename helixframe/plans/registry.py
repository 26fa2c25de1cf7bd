"""The analyses by name: their parameters with defaults, what they need first, and how they are built.

What an analysis needs is computed for it; results are kept by name, parameters and trajectory, so a
changed parameter never gets an older result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from helixframe.model import Trajectory
from helixframe.operators import correlation, dihedrals, geometry, linalg, mbar, network, sasa, structural, thermo
from helixframe.operators.membrane import Membrane
from helixframe.sinks import structures
from helixframe.sources import umbrella


@dataclass(frozen=True)
class Analysis:
    build: Callable[..., Any]
    params: dict[str, Any] = field(default_factory=dict)
    requires: tuple[str, ...] = ()


def _graph(run: Session, threshold: float) -> DataFrame:
    return network.edges(run.get("dccm"), threshold)


def _clusters(run: Session, n_clusters: int, method: str, lag: int, n_macro: int | None, compat: bool) -> dict[str, DataFrame]:
    k = max(2, n_clusters)
    points = thermo.points_of(run.get("pca").projection())
    centers = thermo.kmeans(points, k)
    assigned = thermo.assign(points, centers)
    out = {"assignments": assigned, "populations": thermo.populations(assigned, k)}
    if method == "msm":
        model = thermo.MarkovModel(assigned, k, lag, n_macro, compat)
        out |= {"timescales": model.its(), "membership": model.membership()}
    return out


def _umbrella(run: Session) -> tuple[DataFrame, DataFrame]:
    if run.samples is None or run.windows is None:
        raise ValueError("the session has no umbrella windows; give it samples and windows")
    return run.samples, run.windows


def _exports(run: Session, names: list[str] | None, params: dict) -> dict[str, DataFrame]:
    from helixframe.sinks import exports

    return {n: exports.table(run, n, params) for n in (exports.EXPORTS if names is None else names)}


def _bfactors(run: Session, of: str) -> DataFrame:
    """The values by residue, or by atom, that an analysis gives."""
    if of == "sasa":
        return structural.bfactors_from_residues(run.traj, sasa.per_residue(run.get("sasa")), "mean_sasa")
    values = run.get(of)
    value = next(c for c, t in values.dtypes if t == "double")
    return structural.bfactors(values, value)


_MBAR = {"force": 300.0, "temperature": 300.0, "n_bins": None, "n_boot": 50}

ANALYSES: dict[str, Analysis] = {
    "rmsd": Analysis(lambda run: structural.rmsd(run.traj)),
    "rmsf": Analysis(lambda run: structural.rmsf(run.traj)),
    "radius_of_gyration": Analysis(lambda run: structural.radius_of_gyration(run.traj)),
    "mean_structure": Analysis(lambda run: structural.mean_structure(run.traj)),
    "pca": Analysis(lambda run: linalg.Pca(run.traj)),
    "dccm": Analysis(lambda run: correlation.dccm(run.traj)),
    "contacts": Analysis(lambda run, cutoff: correlation.contact_map(run.traj, cutoff), {"cutoff": 8.0}),
    "hbond": Analysis(lambda run, cutoff_dist, min_occupancy: correlation.hydrogen_bonds(run.traj, cutoff_dist, min_occupancy), {"cutoff_dist": 3.5, "min_occupancy": 0.05}),
    "enm": Analysis(lambda run, cutoff, n_modes, model: linalg.ElasticNetwork(run.traj, cutoff, n_modes, model), {"cutoff": 7.5, "n_modes": 20, "model": "ANM"}),
    "nma_overlap": Analysis(lambda run: run.get("enm").overlap(), requires=("enm",)),
    "communities": Analysis(lambda run, threshold, max_communities: network.communities(_graph(run, threshold), run.traj.n_atoms, max_communities), {"threshold": 0.6, "max_communities": 10}, ("dccm",)),
    "betweenness": Analysis(lambda run, threshold: network.betweenness(_graph(run, threshold), run.traj.n_atoms), {"threshold": 0.4}, ("dccm",)),
    "optimal_paths": Analysis(lambda run, source, sink, threshold: network.optimal_path(_graph(run, threshold), run.traj.n_atoms, source, sink), {"source": 0, "sink": 1, "threshold": 0.3}, ("dccm",)),
    "fes": Analysis(lambda run, n_bins: thermo.free_energy_surface(run.get("pca").projection(), "pc1", "pc2", n_bins), {"n_bins": 50}, ("pca",)),
    "entropy": Analysis(lambda run: linalg.entropy(run.traj)),
    "dihedrals": Analysis(lambda run: dihedrals.series(run.traj)),
    "dihedral_summary": Analysis(lambda run: dihedrals.summary(run.get("dihedrals")), requires=("dihedrals",)),
    "dihedral_time_series": Analysis(lambda run, atom_indices: dihedrals.lookup(run.get("dihedrals"), atom_indices), {"atom_indices": [0]}, ("dihedrals",)),
    "prs": Analysis(lambda run: correlation.prs_profiles(run.traj)),
    "prs_matrix": Analysis(lambda run: correlation.prs_matrix(run.traj)),
    "mutual_information": Analysis(lambda run: correlation.mutual_information(run.traj)),
    "clustering": Analysis(_clusters, {"n_clusters": 5, "method": "kmeans", "lag": 1, "n_macro": None, "compat": False}, ("pca",)),
    "geometry_series": Analysis(lambda run, **p: geometry.series(run.traj, **p), {"pairs": [(0, 1)]}),
    "sasa": Analysis(lambda run, probe: sasa.residue_series(run.traj, probe), {"probe": 1.4}),
    "membrane": Analysis(lambda run, headgroup, normal: Membrane(run.traj, headgroup, normal), {"headgroup": "P", "normal": 2}),
    "bfactors": Analysis(_bfactors, {"of": "rmsf"}),
    "frame": Analysis(lambda run, frame: structural.frame_coordinates(run.traj, frame), {"frame": 0}),
    "window_stats": Analysis(lambda run: mbar.window_stats(_umbrella(run)[0])),
    "window_density": Analysis(lambda run, low, high: mbar.window_density(_umbrella(run)[0], low, high), {"low": -0.8, "high": 2.1}),
    "window_frames": Analysis(lambda run, kind: umbrella.window_frames(run.traj.spark, _umbrella(run)[1], run.traj.atoms, kind), {"kind": None}),
    "mbar": Analysis(lambda run, force, temperature, n_bins, n_boot: mbar.Mbar(*_umbrella(run), force, temperature, n_bins, n_boot), _MBAR),
    "pmf": Analysis(lambda run, **p: run.get("mbar", **p).profile(), _MBAR),
    "free_energies": Analysis(lambda run, **p: run.get("mbar", **p).free_energies(), _MBAR),
    "region": Analysis(lambda run, frame, serials: structures.region_atoms(run.traj, frame, serials), {"frame": 0, "serials": [1]}),
    "region_mask": Analysis(lambda run, **p: structures.region_mask(run.get("region", **p)), {"frame": 0, "serials": [1]}),
    "region_xyz": Analysis(lambda run, **p: structures.region_xyz(run.get("region", **p)), {"frame": 0, "serials": [1]}),
    "region_orca": Analysis(lambda run, **p: structures.region_orca(run.get("region", **p)), {"frame": 0, "serials": [1]}),
    "pdb": Analysis(lambda run, frame, of: structures.pdb_lines(run.traj, frame, None if of is None else run.get("bfactors", of=of)), {"frame": 0, "of": None}),
    "export_wide": Analysis(lambda run: structures.export_wide(run.get("rmsd"), run.get("rmsf"), run.get("radius_of_gyration"))),
    "batch_export": Analysis(_exports, {"names": None, "params": {}}),
}


class Session:
    """One trajectory, perhaps with umbrella windows (window_idx, val0, ...) and their samples, and the results computed of them."""

    def __init__(self, traj: Trajectory, samples: DataFrame | None = None, windows: DataFrame | None = None):
        self.traj, self.samples, self.windows, self._kept = traj, samples, windows, {}

    def get(self, name: str, **params) -> Any:
        analysis = ANALYSES.get(name)
        if analysis is None:
            raise ValueError(f"unknown analysis {name!r}")
        if (extra := set(params) - set(analysis.params)) and name != "geometry_series":
            raise ValueError(f"{name} has no parameter {sorted(extra)[0]!r}")
        full = {**analysis.params, **params}
        key = (name, repr(sorted(full.items())))
        if key not in self._kept:
            for needed in analysis.requires:
                self.get(needed)
            self._kept[key] = analysis.build(self, **full)
        return self._kept[key]

    def computed(self) -> list[str]:
        """S15. The names of the results that are kept."""
        return sorted({name for name, _ in self._kept})
