"""The surface against a plain reading of its definition, by rows and by cells."""

from __future__ import annotations

import re

import numpy as np
import pytest

from helixframe import catalog
from helixframe.operators import sasa
from helixframe.sources import fixtures
from tests.builders import make


def plain(x, radii):
    """The area of each atom: every point of its sphere against every other atom."""
    out = []
    for i, (at, r) in enumerate(zip(x, radii)):
        spots = at + r * sasa.sphere()
        others = [j for j in range(len(x)) if j != i]
        free = [all(((s - x[j]) ** 2).sum() >= radii[j] ** 2 for j in others) for s in spots]
        out.append(4 * np.pi * r * r * sum(free) / sasa.POINTS)
    return out


def test_series_holds_every_frame(spark, small):
    got = catalog.QUERIES["sasa_residue_series"](spark, small)
    frames = fixtures.read(spark, small, "embeddings").count()
    assert frames > 20 and got.count() == 7 * frames
    assert got.select("frame").distinct().count() == frames


@pytest.mark.parametrize("max_inrow", [100, 0])
def test_areas(spark, max_inrow):
    """Elements of several radii, atoms that coincide, and others far away."""
    rng = np.random.default_rng(4)
    x = rng.normal(scale=5, size=(3, 30, 3))
    x[:, 7] = x[:, 3]
    x[:, 9] += 100
    kinds = ["C", "N", "O", "ZN", "H", "Xx"]
    atoms = [(f"A{k}", "ALA", "A", k // 4, kinds[k % 6]) for k in range(30)]
    t = make(spark, x, atoms)
    radii = [sasa.RADII.get(a[4], 1.7) + 1.4 for a in atoms]
    got = {(r.frame, r.atom_idx): r.sasa for r in sasa.atom_series(t, max_inrow=max_inrow).collect()}
    assert len(got) == 90
    for f in range(3):
        assert [got[f, i] for i in range(30)] == pytest.approx(plain(x[f], radii), abs=1e-9)
    assert got[0, 9] == pytest.approx(4 * np.pi * radii[9] ** 2)


def test_many_atoms_take_the_cells(spark):
    """A frame of thousands of atoms: one task holds cells, not the frame."""
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 60, size=(1, 3000, 3))
    t = make(spark, x)
    got = {r.atom_idx: r.sasa for r in sasa.atom_series(t).collect()}
    near = [0, 17, 2999]
    assert len(got) == 3000
    for i in near:
        close = np.argsort(((x[0] - x[0][i]) ** 2).sum(axis=1))[:80]
        assert got[i] == pytest.approx(plain(x[0][close], [3.1] * 80)[0])


def test_plan_has_no_python(spark, small):
    plan = sasa.residue_series(fixtures.trajectory(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("max_inrow", [100, 0])
def test_masks_are_compiled(spark, small, max_inrow):
    """By Spark, which leaves functions of arrays to be interpreted, and by the JVM, which leaves functions of over 8,000 bytes."""
    areas = sasa.atom_series(fixtures.trajectory(spark, small), max_inrow=max_inrow)
    spark.conf.set("spark.sql.adaptive.enabled", False)  # else there is no code before the query runs
    try:
        plan = areas.select("*")._jdf.queryExecution().executedPlan()
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "aggregate(array(" not in plan.toString() and "bit_or" in code
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000


def test_a_missing_coordinate_covers_nothing(spark):
    t = make(spark, np.zeros((1, 3, 3)))
    rows = spark.createDataFrame([(0, [0.0, 0.0, 0.0, None, 0.0, 0.0, 0.0, float("nan"), 0.0])], "frame long, xyz array<double>")
    got = {r.atom_idx: r.sasa for r in sasa.atom_series(t.where(rows)).collect()}
    assert [got[i] for i in range(3)] == pytest.approx([4 * np.pi * 3.1**2] * 3)


def test_frames_without_coordinates_count_for_nothing(spark):
    t = make(spark, np.zeros((2, 2, 3)))
    rows = t.frames.unionByName(spark.createDataFrame([(9, None), (10, [1.0])], "frame long, xyz array<double>"))
    assert {r.frame for r in sasa.residue_series(t.where(rows)).collect()} == {0, 1}
