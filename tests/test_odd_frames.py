"""Frames without coordinates, or with too few or too many, count for nothing in every measure of a trajectory."""

from __future__ import annotations

import numpy as np
import pytest

from helixframe.model import Trajectory
from helixframe.operators import correlation, dihedrals, geometry, linalg, network, sasa, structural, thermo
from helixframe.operators.membrane import Membrane
from helixframe.plans.primitives import covariance, entries
from tests.builders import make

ATOMS = [(("N", "CA", "C")[k % 3], "ALA", "A", k // 3 + 1, ("N", "C", "C")[k % 3]) for k in range(9)]
MEASURES = {
    "rmsd": structural.rmsd, "rmsf": structural.rmsf, "rg": structural.radius_of_gyration, "mean": structural.mean_structure,
    "covariance": lambda t: entries(t.spark, covariance(t)), "dccm": correlation.dccm, "contacts": correlation.contact_map,
    "cell contacts": lambda t: correlation.contacts(t, apart=0, max_inrow=1), "hbonds": lambda t: correlation.hydrogen_bonds(t, 6.0), "prs": correlation.prs_profiles,
    "nmi": correlation.mutual_information, "pca": lambda t: linalg.Pca(t).variance(), "projection": lambda t: linalg.Pca(t).projection(),
    "leading": lambda t: linalg.Pca(t, 4, 0).variance(), "entropy": linalg.entropy, "modes": lambda t: linalg.ElasticNetwork(t).modes(),
    "overlap": lambda t: linalg.ElasticNetwork(t).overlap(), "edges": lambda t: network.edges(correlation.dccm(t), 0.1),
    "fes": lambda t: thermo.free_energy_surface(linalg.Pca(t).projection(), "pc1", "pc2"), "dihedrals": dihedrals.series,
    "summary": lambda t: dihedrals.summary(dihedrals.series(t)), "geometry": lambda t: geometry.series(t, pairs=[(0, 4)], triplets=[(0, 1, 2)]),
    "membrane": lambda t: Membrane(t, "N").per_frame(), "density": lambda t: Membrane(t, "N").density(), "order": lambda t: Membrane(t, "N").order(),
    "sasa": sasa.residue_series, "sasa cells": lambda t: sasa.residue_series(t, max_inrow=0),
}


@pytest.fixture(scope="module")
def pair(spark):
    """A trajectory, and the same with a null frame first, in the middle and last, and frames of wrong lengths that cancel out."""
    x = np.random.default_rng(6).normal(scale=3, size=(12, 9, 3))
    clean = make(spark, x, ATOMS)
    frames = [(k + 1 + k // 6, f.ravel().tolist()) for k, f in enumerate(x)]
    odd = [(0, None), (7, None), (14, None), (15, [1.0] * 26), (16, [1.0] * 28), (17, [])]
    schema = "frame long, xyz array<double>"
    rows = sorted(frames + odd)
    moved = spark.createDataFrame(frames, schema)
    return Trajectory(moved, clean.atoms), Trajectory(spark.createDataFrame(rows, schema).coalesce(2), clean.atoms)


def near(v):
    return round(v, 8) + 0.0 if isinstance(v, float) else [near(x) for x in v] if isinstance(v, list) else v


def shown(df):
    return sorted(str([near(v) for v in r]) for r in df.collect())


@pytest.mark.parametrize("name", MEASURES)
def test_measures(pair, name):
    clean, odd = pair
    want, got = shown(MEASURES[name](clean)), shown(MEASURES[name](odd))
    assert got == want and len(want) > 0


@pytest.mark.parametrize("name", ["rmsd", "rg", "nmi", "geometry", "membrane", "sasa", "dihedrals"])
def test_no_whole_frame_at_all(spark, pair, name):
    none = pair[0].where(spark.createDataFrame([(0, None), (1, [1.0])], "frame long, xyz array<double>"))
    assert MEASURES[name](none).count() == 0
