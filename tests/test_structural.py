from __future__ import annotations

import numpy as np
import pytest

from helixframe.operators import dihedrals, geometry, linalg, sasa, structural
from helixframe.operators.membrane import Membrane
from helixframe.plans.primitives import close_pairs, dense_index
from tests.builders import make, noise, values


def test_rmsd_of_a_shift(spark):
    base = np.arange(12).reshape(4, 3)
    assert values(structural.rmsd(make(spark, [base, base + [3, 4, 0]])), "frame", "rmsd") == pytest.approx([0, 5])


def test_rmsf_of_still_and_moving_atoms(spark):
    frames = np.zeros((2, 2, 3))
    frames[1, 1] = [2, 0, 0]
    assert values(structural.rmsf(make(spark, frames)), "atom_idx", "rmsf") == pytest.approx([0, 1])


def test_radius_of_two_points(spark):
    assert values(structural.radius_of_gyration(make(spark, [[[0, 0, 0], [2, 0, 0]]])), "frame", "rg") == pytest.approx([1])


def test_frames_in_any_order_fluctuate_alike(spark):
    t = noise(spark)
    x = np.array([r.xyz for r in t.frames.orderBy("frame").collect()]).reshape(40, 6, 3)
    shuffled = make(spark, x[::-1])
    assert values(structural.rmsf(t), "atom_idx", "rmsf") == pytest.approx(values(structural.rmsf(shuffled), "atom_idx", "rmsf"))


def test_bfactors(spark):
    same = spark.createDataFrame([(0, 2.0), (1, 2.0)], "atom_idx int, v double")
    assert values(structural.bfactors(same, "v"), "atom_idx", "bfactor") == [50, 50]
    some = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 2.0)], "atom_idx int, v double")
    assert values(structural.bfactors(some, "v"), "atom_idx", "bfactor") == [0, 100, 50]
    with pytest.raises(ValueError, match="no values"):
        structural.bfactors(some.limit(0), "v")


def test_selection_and_stride(spark):
    t = make(spark, np.arange(90).reshape(10, 3, 3), [("N", "ALA", "A", 1, "N"), ("CA", "ALA", "A", 1, "C"), ("CB", "ALA", "A", 1, "C")])
    got = structural.load(t, "name C*", 3)
    assert (got.n_atoms, got.n_frames) == (2, 4)
    assert [r.xyz for r in got.frames.orderBy("frame").collect()][1] == list(map(float, range(30, 36)))
    with pytest.raises(ValueError, match="no atom"):
        structural.load(t, "name XX")


def test_an_unknown_frame_is_an_error(spark):
    with pytest.raises(ValueError, match="out of range"):
        structural.frame_coordinates(noise(spark), 99)


def test_cell_grid_and_rows_find_the_same_pairs(spark):
    t = noise(spark, frames=5, atoms=30)
    key = lambda df: sorted((r.frame, r.i, r.j, round(r.d, 9)) for r in df.collect())
    assert key(close_pairs(t, 5.0)) == key(close_pairs(t, 5.0, max_inrow=1))


def test_dense_index_over_ranges(spark):
    rows = spark.createDataFrame([(k * k - 50, k % 2) for k in range(60)], "k long, g int")
    got = dense_index(rows, "k", bucket=7).orderBy("k").collect()
    assert [r.t for r in got] == list(range(60))
    by = dense_index(rows, "k", bucket=7, by=("g",)).orderBy("g", "k").collect()
    assert [r.t for r in by] == list(range(30)) * 2


# -- dihedrals and geometry


def test_trans_and_cis(spark):
    trans, cis = [[0, 1, 0], [0, 0, 0], [1, 0, 0], [1, -1, 0]], [[0, 1, 0], [0, 0, 0], [1, 0, 0], [1, 1, 0]]
    quads = np.array([[0, 1, 2, 3]])
    assert abs(dihedrals.torsions(np.array([trans], float), quads)[0, 0]) == pytest.approx(180)
    assert dihedrals.torsions(np.array([cis], float), quads)[0, 0] == pytest.approx(0)
    turned = [[0, 1, 0], [0, 0, 0], [1, 0, 0], [1, np.cos(np.pi / 3), np.sin(np.pi / 3)]]
    assert abs(dihedrals.torsions(np.array([turned], float), quads)[0, 0]) == pytest.approx(60)
    flat = [[0, 1, 0], [0, 0, 0], [0, 0, 0], [1, 0, 0]]
    assert np.isnan(dihedrals.torsions(np.array([flat], float), quads)[0, 0])


def test_column_torsions_agree(spark):
    from helixframe.functions.expr import atom, dihedral_degrees

    t = noise(spark, frames=20, atoms=4)
    got = t.frames.select("frame", dihedral_degrees(*[atom("xyz", k) for k in range(4)]).alias("v")).orderBy("frame").collect()
    x = np.array([r.xyz for r in t.frames.orderBy("frame").collect()]).reshape(20, 4, 3)
    assert [r.v for r in got] == pytest.approx(dihedrals.torsions(x, np.array([[0, 1, 2, 3]]))[:, 0])


def test_modes_and_chains(spark):
    backbone = [(n, "ALA", "A", r, "C") for r in (1, 2, 3) for n in ("N", "CA", "C")]
    t = make(spark, np.random.default_rng(1).normal(size=(3, 9, 3)), backbone)
    assert dihedrals.residues(t)[0] == "backbone"
    rows = dihedrals.series(t).filter("frame = 0").orderBy("res_idx").collect()
    assert [(r.phi is None, r.psi is None) for r in rows] == [(True, False), (False, False), (False, True)]
    only = make(spark, np.random.default_rng(1).normal(size=(2, 5, 3)), [("CA", "GLY", "A", r, "C") for r in range(5)])
    assert dihedrals.residues(only)[0] == "pseudodihedral"
    some = dihedrals.series(only).filter("frame = 0").orderBy("res_idx").collect()
    assert [r.phi is None for r in some] == [True, False, False, True, True] and all(r.psi is None for r in some)
    with pytest.raises(ValueError, match="no residue"):
        dihedrals.lookup(dihedrals.series(only), [77])


def test_linear_and_circular_means(spark):
    angles = spark.createDataFrame([(0, 1, "A", 0, f, a, None) for f, a in enumerate((179.0, -179.0))], "res_idx int, res_seq long, res_name string, atom_idx int, frame long, phi double, psi double")
    linear, circular = dihedrals.summary(angles).first(), dihedrals.summary(angles, circular=True).first()
    assert linear.phi_mean == pytest.approx(0) and abs(circular.phi_mean) == pytest.approx(180)
    assert circular.phi_std == pytest.approx(1, abs=0.01) and linear.n_valid == 0 and linear.psi_mean is None


def test_geometry(spark):
    t = make(spark, [[[1, 0, 0], [0, 0, 0], [0, 1, 0], [0, 0, 0]]])
    rows = {r.series_idx: r for r in geometry.series(t, [(0, 2)], [(0, 1, 2), (0, 1, 3)], ["", "elbow"], [(0, 1)], [2.0]).collect()}
    assert rows[0].value == pytest.approx(2**0.5) and rows[0].label == "d(0,2)"
    assert rows[1].value == pytest.approx(90) and rows[1].label == "elbow" and rows[2].value is None
    assert rows[3].value == pytest.approx(2**0.5 + 180)
    with pytest.raises(ValueError, match="out of range"):
        geometry.series(t, [(0, 9)])
    assert geometry.series(t, [(0, 9)], strict=False).first().value is None
    block = {"iat": [1, 2, 2, 3], "rstwt": [1.0, -1.0]}
    assert geometry.from_restraint(block) == {"pairs": [(0, 1), (1, 2)], "composites": [(0, 1)], "weights": [-1.0]}


# -- surface and membrane


def test_lone_atom_and_hidden_atom(spark):
    lone = sasa.residue_series(make(spark, [[[0, 0, 0]]]))
    assert lone.first().sasa == pytest.approx(4 * np.pi * 3.1**2)
    far = make(spark, [[[0, 0, 0], [50, 0, 0]]])
    assert sasa.total(sasa.residue_series(far)).first().total_sasa == pytest.approx(8 * np.pi * 3.1**2)
    near = make(spark, [[[0, 0, 0], [1, 0, 0]]])
    assert sasa.total(sasa.residue_series(near)).first().total_sasa < 8 * np.pi * 3.1**2


def test_consecutive_residues_are_grouped(spark):
    atoms = [("A", "ALA", "A", 1, "C"), ("B", "ALA", "A", 1, "C"), ("A", "GLY", "A", 2, "C"), ("A", "ALA", "A", 1, "C")]
    rows = sasa.residue_series(make(spark, np.zeros((1, 4, 3)), atoms)).orderBy("res_idx").collect()
    assert [(r.res_idx, r.residue) for r in rows] == [(0, "ALA 1"), (1, "GLY 2"), (2, "ALA 1")]


def bilayer(spark, cells=None):
    x = [[[k * 5, 0, 20] for k in range(4)] + [[k * 5, 0, -20] for k in range(4)]]
    return make(spark, x, [("P", "POPC", "A", k + 1, "P") for k in range(8)], cells)


def test_bilayer(spark):
    row = Membrane(bilayer(spark, [(60, 60, 100)])).per_frame().first()
    assert (row.thickness, row.apl, row.n_upper, row.n_lower) == (40, 900, 4, 4)
    bare = Membrane(bilayer(spark)).per_frame().first()
    assert (bare.thickness, bare.apl) == (40, 0)
    assert Membrane(bilayer(spark)).order().count() == 0
    top = Membrane(bilayer(spark)).density().filter("density > 0").collect()
    assert {(r.leaflet, r.bin, r.density) for r in top} == {("upper", 0, 1.0), ("lower", 0, 1.0)}


def test_headgroups_by_name_or_all(spark):
    t = bilayer(spark)
    assert len(Membrane(t, "p , n").heads) == 8 and len(Membrane(t, "XX").heads) == 8
    assert Membrane(t, normal=7).axis == 2


# -- modes


def test_pca_against_numpy(spark):
    t = noise(spark)
    x = np.array([r.xyz for r in t.frames.orderBy("frame").collect()])
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    pca = linalg.Pca(t)
    assert values(pca.variance(), "component", "eigenvalue") == pytest.approx(want, abs=1e-9)
    assert sum(values(pca.variance(), "component", "explained_variance")) == pytest.approx(1)
    p = pca.projection().orderBy("frame").collect()
    assert np.var([r.pc1 for r in p]) == pytest.approx(want[0]) and np.var([r.pc2 for r in p]) == pytest.approx(want[1])


def test_entropy_against_the_formula(spark):
    t = noise(spark)
    x = np.array([r.xyz for r in t.frames.orderBy("frame").collect()])
    lam = np.linalg.eigvalsh(np.cov(x.T, bias=True))
    lam = lam[lam > 1e-6 * lam.max()]
    arg = 2 * np.pi * np.e * 1.380649e-23 * 300 * 12.011 * 1.66054e-27 / 1.054571817e-34**2 * lam * 1e-20
    row = linalg.entropy(t).first()
    assert row.n_modes == len(lam)
    assert row.entropy_j_per_mol_k == pytest.approx(6.02214076e23 * 1.380649e-23 / 2 * np.log(arg[arg > 1]).sum())


def test_chain_network(spark):
    t = make(spark, [[[4 * k, 0, 0] for k in range(5)]])
    gnm = linalg.ElasticNetwork(t, cutoff=5, model="gnm")
    assert gnm.spectrum == pytest.approx([2 - 2 * np.cos(k * np.pi / 5) for k in range(5)], abs=1e-9)
    assert len(gnm.values) == gnm.vectors.shape[1] == 4
    with pytest.raises(ValueError, match="no direction"):
        gnm.overlap()


def test_anm(spark):
    t = noise(spark, atoms=8)
    net = linalg.ElasticNetwork(t, cutoff=50)
    assert np.abs(net.spectrum[:6]).max() < 1e-9 and net.spectrum[6] > 1e-3  # six rigid motions
    h = linalg.hessian_matrix(t, 50)
    assert h == pytest.approx(h.T) and np.abs(h.sum(axis=1)).max() < 1e-9
    b = values(net.bfactors(), "atom_idx", "bfactor")
    want = sum((net.vectors[:, k] ** 2).reshape(8, 3).sum(axis=1) / net.values[k] for k in range(len(net.values)))
    assert b == pytest.approx(want)
    assert 0 < net.overlap().orderBy("mode").collect()[-1].cumulative <= 1 + 1e-9
    with pytest.raises(ValueError, match="does not move"):
        linalg.ElasticNetwork(make(spark, np.repeat(np.random.default_rng(0).normal(size=(1, 8, 3)), 3, axis=0)), cutoff=50).overlap()


# -- leading components


@pytest.mark.parametrize(("frames", "atoms"), [(300, 12), (20, 15)])
def test_leading_components_against_all(spark, frames, atoms):
    """More frames than coordinates, and fewer, so that the frames span less than is asked for."""
    rng = np.random.default_rng(3)
    slow = rng.normal(size=(frames, 4)) * [9, 5, 3, 2]
    x = slow @ rng.normal(size=(4, 3 * atoms)) + rng.normal(scale=0.5, size=(frames, 3 * atoms))
    t = make(spark, x.reshape(frames, atoms, 3))
    whole, lead = linalg.Pca(t), linalg.Pca(t, components=8, dense_rows=0)
    assert len(lead.values) == 8
    assert lead.values == pytest.approx(whole.values[:8], rel=1e-8) and lead.ratios == pytest.approx(whole.ratios[:8], rel=1e-8)
    assert np.abs(lead.vectors[:, :4] - whole.vectors[:, :4]).max() < 1e-6
    assert np.abs(lead.vectors.T @ lead.vectors - np.eye(8)).max() < 1e-9


def test_leading_components_of_the_given_frames(spark, small):
    """Variances that hardly differ: the basis grows until it holds them all."""
    from helixframe.sources import fixtures

    t = fixtures.trajectory(spark, small)
    whole, lead = linalg.Pca(t), linalg.Pca(t, components=20, dense_rows=0)
    assert lead.values == pytest.approx(whole.values[:20], rel=1e-8)


def test_leading_components_of_many_coordinates(spark):
    """100,000 coordinates: no square matrix is made."""
    rng = np.random.default_rng(9)
    modes, n = rng.normal(size=(3, 99_999)), 33_333
    x = (rng.normal(size=(25, 3)) * [5, 3, 1]) @ modes
    t = make(spark, x.reshape(25, n, 3))
    lead = linalg.Pca(t, components=5)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / 25
    assert lead.values[:3] == pytest.approx(want[:3], rel=1e-8) and abs(lead.values[3:]).max() < 1e-6 * want[0]
    assert lead.ratios[:3].sum() == pytest.approx(1) and lead.projection().count() == 25


def test_static_frames_have_no_components(spark):
    lead = linalg.Pca(make(spark, np.ones((5, 4, 3))), components=3, dense_rows=0)
    assert (lead.values == 0).all() and (lead.ratios == 0).all()
