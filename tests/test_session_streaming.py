from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import structural
from helixframe.plans.registry import ANALYSES, Session
from helixframe.streaming import incremental
from tests.builders import noise, values


def test_every_analysis_builds(spark):
    samples = spark.range(300).select((F.col("id") % 3).cast("int").alias("window_idx"), F.col("id").alias("sample_idx"), (F.col("id") % 3 + F.sin("id") / 3).alias("x"))
    windows = spark.createDataFrame([(k, float(k)) for k in range(3)], "window_idx int, val0 double")
    run = Session(noise(spark, frames=30, atoms=6), samples, windows)
    run.get("enm", cutoff=50.0)
    for name in ANALYSES:
        if name in ("nma_overlap", "optimal_paths", "dihedral_time_series", "window_frames"):
            continue
        out = run.get(name)
        assert out is not None, name
    path = run.get("optimal_paths", threshold=0.0001, source=0, sink=3)
    assert path.count() >= 1
    assert "pca" in run.computed()


def test_umbrella_sampling_by_name(spark):
    """Windows, their free energies and the profile, as a user asks for them one after another."""
    from helixframe.operators import mbar

    samples = spark.range(900).select((F.col("id") % 3).cast("int").alias("window_idx"), F.col("id").alias("sample_idx"), (F.col("id") % 3 / 2 + F.sin("id") / 2).alias("x"))
    windows = spark.createDataFrame([(k, k / 2) for k in range(3)], "window_idx int, val0 double")
    run = Session(noise(spark), samples, windows)
    asked = {"force": 5.0, "n_bins": 8, "n_boot": 0}
    want = mbar.Mbar(samples, windows, 5.0, n_bins=8, n_boot=0).profile().collect()
    assert [str(r) for r in run.get("pmf", **asked).collect()] == [str(r) for r in want] and len(want) == 8
    assert run.get("pmf", **asked) is run.get("pmf", **asked) and run.get("free_energies", **asked).count() == 3
    assert [r.n for r in run.get("window_stats").collect()] == [300] * 3
    with pytest.raises(ValueError, match="no umbrella windows"):
        Session(noise(spark)).get("mbar")


def test_values_regions_and_exports_by_name(spark):
    run = Session(noise(spark, frames=20, atoms=6))
    b = values(run.get("bfactors"), "atom_idx", "bfactor")
    assert min(b) == 0 and max(b) == 100
    assert values(run.get("bfactors", of="sasa"), "atom_idx", "bfactor")
    assert run.get("region_mask", frame=3, serials=[2, 5]).first().mask == ":2,5"
    assert "  0.00" not in run.get("pdb", frame=1, of="rmsf").orderBy("line").first().text[60:66] or b[0] == 0
    out = run.get("batch_export", names=["rg", "cluster_populations"], params={"clustering": {"n_clusters": 2}})
    assert out["rg"].columns == ["frame", "rg_angstrom"] and out["cluster_populations"].count() == 2
    with pytest.raises(ValueError, match="no_such"):
        run.get("batch_export", names=["no_such"])


def test_results_are_kept_by_parameters(spark):
    run = Session(noise(spark))
    assert run.get("contacts", cutoff=8.0) is run.get("contacts")
    assert run.get("contacts", cutoff=4.0) is not run.get("contacts")
    with pytest.raises(ValueError, match="unknown analysis"):
        run.get("nothing")
    with pytest.raises(ValueError, match="no parameter"):
        run.get("rmsd", cutoff=1)


def test_clustering(spark):
    run = Session(noise(spark, frames=30))
    out = run.get("clustering", n_clusters=3, method="msm", lag=2)
    assert set(out) == {"assignments", "populations", "timescales", "membership"}
    assert sum(values(out["populations"], "cluster", "population")) == pytest.approx(1)


def test_streamed_frames(spark, tmp_path):
    t = noise(spark, frames=10)
    t.frames.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(t.frames.schema).parquet(f"{tmp_path}/in")
    first = t.frames.orderBy("frame").first().xyz
    for name, made in (("rg", incremental.stream_radius_of_gyration(stream, t.atoms)), ("rmsd", incremental.stream_rmsd(stream, t.atoms, first))):
        query = made.writeStream.format("memory").queryName(f"s_{name}").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c_{name}").start()
        query.awaitTermination(120)
        got = spark.table(f"s_{name}").orderBy("frame").collect()
        want = structural.radius_of_gyration(t) if name == "rg" else structural.rmsd(t)
        assert [r[name] for r in got] == pytest.approx(values(want, "frame", name))


def test_windowed_means(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    batch = incremental.windowed_mean(events, "ts", "value", "1 day").agg(F.sum("n")).first()[0]
    assert batch == events.count()


def test_streamed_windows(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{small}/events*.parquet")
    query = (
        incremental.windowed_mean(stream, "ts", "value", "1 day").writeStream.format("memory").queryName("s_win").outputMode("complete")
        .trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    )
    query.awaitTermination(120)
    assert spark.table("s_win").agg(F.sum("n")).first()[0] == events.count()
    assert np.isfinite([r["mean"] for r in spark.table("s_win").collect()]).all()
