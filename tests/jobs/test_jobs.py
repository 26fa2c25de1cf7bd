"""The jobs: against SQL, run again, over input that grows, and from the command line."""

from __future__ import annotations

import json
import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from helixframe.sinks import exports
from helixframe.sources import fixtures
from jobs import common, queries, trajectory_export, umbrella_ingest
from tests.oracle import duck_rows, rows_of, same


def settings(spark):
    return {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.")}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, small, name):
    before = settings(spark)
    same(queries.QUERIES[name](spark, small), queries.SQL[name], small)
    assert settings(spark) == before


# ---------------------------------------------------------------------------------------------- job 1

#: The files of a batch export with their headers; None: a matrix without one.
HEADERS = {
    "rmsd": "frame,rmsd_angstrom", "rmsf": "atom_index,rmsf_angstrom", "rg": "frame,rg_angstrom", "pca": "frame,pc1,pc2",
    "pca_variance": "component,explained_variance", "dccm": None, "contacts": None, "mutual_information": None,
    "prs_effectiveness": "atom_idx,effectiveness", "prs_sensitivity": "atom_idx,sensitivity", "sasa_per_residue": "residue,mean_sasa_a2,std_sasa_a2",
    "sasa_total": "frame,total_sasa_a2", "membrane_per_frame": "frame,thickness_angstrom,apl_angstrom2", "membrane_order_params": "carbon,abs_scd",
    "membrane_z_density": "bin,upper_norm,lower_norm", "dihedrals": "atom_idx,res_name,res_seq,phi_mean,psi_mean,phi_std,psi_std",
    "clustering": "frame,cluster_id", "cluster_populations": "cluster_id,population", "geometry": "index,d(0,10),d(3,20),RC(0−1)",
}


@pytest.fixture(scope="module")
def exported(spark, small, tmp_path_factory):
    """All nineteen exports of the small tables."""
    out = str(tmp_path_factory.mktemp("job1") / "out")
    config = common.defaults(trajectory_export.__file__) | {"exports": list(exports.EXPORTS)}
    values = trajectory_export.run(spark, small, out, config)
    return out, config, values


def lines_of(spark, path):
    """The header and the rows of a folder of CSV files in the order of their names."""
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    texts = [open(f"{path}/{f}", encoding="utf-8").read().splitlines() for f in files]
    return texts


def test_nineteen_files_with_their_headers(spark, exported):
    out, _, values = exported
    assert set(HEADERS) == set(exports.EXPORTS) == {r.export for r in values.select("export").distinct().collect()} and len(HEADERS) == 19
    for name, header in HEADERS.items():
        texts = [t for t in lines_of(spark, f"{out}/csv/{name}") if t]
        if header is None:
            rows = [x for t in texts for x in t]
            assert len(rows) == 21 and all(len(r.split(",")) == 21 for r in rows), name
            assert all(len(c.split(".")[1]) == 4 for r in rows for c in r.split(","))
        else:
            quoted = lambda h: h.replace('"', "")
            assert {quoted(t[0]) for t in texts} == {header} and sum(len(t) - 1 for t in texts) > 0, name


def test_the_surface_is_computed_once_for_its_exports(spark, small, tmp_path, monkeypatch):
    plans, write = [], trajectory_export.write_partitions

    def seen(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, *rest)

    monkeypatch.setattr(trajectory_export, "write_partitions", seen)
    config = common.defaults(trajectory_export.__file__) | {"exports": ["sasa_per_residue", "sasa_total"], "csv": False}
    trajectory_export.run(spark, small, str(tmp_path / "out"), config)
    assert len(plans) == 2 and all("InMemoryTableScan" in p for p in plans)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_decimals_and_order_of_the_files(spark, small, exported):
    out, _, values = exported
    rows = [x.split(",") for t in lines_of(spark, f"{out}/csv/rmsd") for x in t[1:]]
    assert [int(f) for f, _ in rows] == list(range(len(rows))) and all(len(v.split(".")[1]) == 6 for _, v in rows)
    areas = [x.split(",") for t in lines_of(spark, f"{out}/csv/sasa_per_residue") for x in t[1:]]
    assert [a[0] for a in areas] == [f"{r} {k + 1}" for k, r in enumerate(fixtures.RESIDUES)] and all(len(v.split(".")[1]) == 4 for a in areas for v in a[1:])
    angles = [x.split(",") for t in lines_of(spark, f"{out}/csv/dihedrals") for x in t[1:]]
    assert angles[0][3] == "NaN" and angles[-1][4] == "NaN"
    held = {(r.row, r.item): r.value for r in values.filter("export = 'dccm'").collect()}
    cells = [x.split(",") for t in lines_of(spark, f"{out}/csv/dccm") for x in t]
    assert all(abs(float(cells[i][j]) - held[i, str(j)]) <= 5e-5 + 1e-12 for i in range(21) for j in range(21))


def test_again_and_in_part(spark, small, exported):
    """The same rows again; one export by itself replaces its own partition only."""
    out, config, values = exported
    before = rows_of(values)
    some = config | {"exports": ["rg", "dihedrals", "sasa_total"]}
    assert rows_of(trajectory_export.run(spark, small, out, some)) == before
    part = {"exports": ["sasa_total"], "csv": False, "analyses": {"sasa": {"probe": 2.0}}}
    after = trajectory_export.run(spark, small, out, part)
    assert {r.export for r in after.select("export").distinct().collect()} == set(HEADERS)
    assert rows_of(after.filter("export <> 'sasa_total'")) == [r for r in before if not r.startswith("('sasa_total'")]
    assert len(rows_of(after)) == len(before) and rows_of(after) != before
    assert rows_of(trajectory_export.run(spark, small, out, some)) == before


def test_unknown_exports_are_errors_before_any_work(spark, small, tmp_path):
    with pytest.raises(ValueError, match="hbond"):
        trajectory_export.run(spark, small, str(tmp_path / "x"), {"exports": ["rmsd", "hbond"], "csv": False, "analyses": {}})
    assert not (tmp_path / "x").exists()


# ---------------------------------------------------------------------------------------------- job 2


@pytest.fixture
def growing(spark, small, tmp_path):
    """A folder of event files that takes on more."""
    events = fixtures.read(spark, small, "events")

    def add(name, rows):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/tables/events.parquet")

    return str(tmp_path), events, add


def samples_taken(spark, out):
    return spark.read.parquet(f"{out}/samples")


def test_two_runs_over_growing_input(spark, small, growing, caplog):
    """The second run takes the new file only, and the report is that of all files at once."""
    root, events, add = growing
    add("a", events.filter("event_id % 3 = 0"))
    with caplog.at_level("INFO", logger="jobs"):
        umbrella_ingest.run(spark, f"{root}/tables", f"{root}/out")
        first = samples_taken(spark, f"{root}/out")
        n = events.filter("event_id % 3 = 0").count()
        assert first.count() == n and first.select("batch").distinct().count() == 1
        files = {f.name: f.stat().st_mtime_ns for f in os.scandir(f"{root}/out/samples/batch=0/window_idx=0") if f.name.startswith("part")}
        add("b", events.filter("event_id % 3 <> 0"))
        report = umbrella_ingest.run(spark, f"{root}/tables", f"{root}/out")
    assert f"took {n} samples" in caplog.text and f"took {events.count() - n} samples" in caplog.text
    second = samples_taken(spark, f"{root}/out")
    assert second.count() == events.count() == second.select("sample_idx").distinct().count()
    assert second.filter("batch = 1").count() == events.count() - n
    assert {f.name: f.stat().st_mtime_ns for f in os.scandir(f"{root}/out/samples/batch=0/window_idx=0") if f.name.startswith("part")} == files
    names, want = duck_rows(queries.SQL["job2_umbrella_ingest"], small)
    got = rows_of(report.withColumn("value", F.round("value", 6) + 0.0))
    assert got == want
    # A third run finds nothing new and writes the same report again.
    before = rows_of(report)
    assert rows_of(umbrella_ingest.run(spark, f"{root}/tables", f"{root}/out")) == before
    assert samples_taken(spark, f"{root}/out").count() == events.count()


def test_a_run_that_was_cut_off_is_made_good(spark, growing, monkeypatch):
    """A batch that fails after its samples are written is taken again under its number, and counts once."""
    root, events, add = growing
    add("a", events.filter("event_id < 500"))
    real = umbrella_ingest.partials

    def broken(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(umbrella_ingest, "partials", broken)
    with pytest.raises(Exception, match="lost"):
        umbrella_ingest.run(spark, f"{root}/tables", f"{root}/out")
    assert samples_taken(spark, f"{root}/out").count() == 500
    monkeypatch.setattr(umbrella_ingest, "partials", real)
    add("b", events.filter("event_id >= 500"))
    report = umbrella_ingest.run(spark, f"{root}/tables", f"{root}/out")
    assert samples_taken(spark, f"{root}/out").count() == events.count()
    assert report.filter("measure = 'n'").agg(F.sum("value")).first()[0] == events.count()


def test_a_report_that_was_not_written_is_made_good(spark, growing, monkeypatch):
    """Cut off between the last batch and the report: the next run has nothing new to take, and still tells of all."""
    root, events, add = growing
    add("a", events.filter("event_id < 400"))
    umbrella_ingest.run(spark, f"{root}/tables", f"{root}/out")
    add("b", events.filter("event_id >= 400"))
    real = umbrella_ingest.report
    monkeypatch.setattr(umbrella_ingest, "report", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        umbrella_ingest.run(spark, f"{root}/tables", f"{root}/out")
    monkeypatch.setattr(umbrella_ingest, "report", real)
    made = umbrella_ingest.run(spark, f"{root}/tables", f"{root}/out")
    assert made.filter("measure = 'n'").agg(F.sum("value")).first()[0] == events.count()


def test_odd_samples_and_empty_input(spark, growing):
    root, events, add = growing
    add("none", events.limit(0))
    assert umbrella_ingest.run(spark, f"{root}/tables", f"{root}/out").count() == 0
    odd = [(None, 1.0), (1, None), (2, math.nan), (3, math.inf), (4, 1e6), (34, -1e6), (5, 50.0)]
    rows = spark.createDataFrame(odd, "event_id long, value double").join(events.limit(1).drop("event_id", "value")).select(events.columns)
    add("odd", rows)
    report = {(r.measure, r.window_idx, r.bin): r.value for r in umbrella_ingest.run(spark, f"{root}/tables", f"{root}/out").collect()}
    assert report["n", 4, -1] == 2 and report["n", 5, -1] == 1 and report["std", 5, -1] == 0 and report["overlap", 5, -1] == 0
    assert report["histogram", 4, 0] == report["histogram", 4, 57] == 1 and not any(w in (1, 2, 3) for _, w, _ in report)


def test_other_windows_and_bins(spark, small, growing):
    root, events, add = growing
    add("a", events)
    config = common.defaults(umbrella_ingest.__file__) | {"windows": {"n": 4, "low": 0.0, "high": 3.0}, "bins": 10}
    made = umbrella_ingest.run(spark, f"{root}/tables", f"{root}/out", config)
    report = {(r.measure, r.window_idx): r.value for r in made.filter("bin = -1").collect()}
    assert {w for _, w in report} == {0, 1, 2, 3} and sum(report["n", w] for w in range(4)) == events.count()
    assert made.filter("measure = 'histogram'").agg(F.max("bin"), F.sum("value")).first() == (9, events.count())
    assert report["mean", 3] == pytest.approx(3.0, abs=0.1)


def test_state_of_batches_combines_without_loss(spark):
    """Values far from zero, over many small parts: the spread keeps its digits."""
    config = common.defaults(umbrella_ingest.__file__)
    rows = spark.range(3000).select(F.lit(0).alias("window_idx"), (F.lit(1e9) + F.col("id") % 7).alias("x"), (F.col("id") % 50).alias("batch"))
    parts = None
    for b in range(0, 50, 10):
        p = umbrella_ingest.partials(rows.filter((F.col("batch") >= b) & (F.col("batch") < b + 10)), config)
        parts = p if parts is None else parts.unionByName(p)
    got = umbrella_ingest.combined(parts, "window_idx").first()
    want = rows.agg(F.avg("x").alias("mean"), F.var_pop("x").alias("v")).first()
    assert got.n == 3000 and got.mean == pytest.approx(want.mean, rel=1e-15) and got.m2 / got.n == pytest.approx(4.0, rel=1e-2) and got.m2 / got.n == pytest.approx(want.v, rel=1e-7)


# ---------------------------------------------------------------------------------------------- command line


@pytest.mark.parametrize("job, option", [("trajectory_export", {"exports": ["rg"], "csv": False}), ("umbrella_ingest", {"bins": 20})])
def test_command_line(small, tmp_path, job, option):
    (tmp_path / "c.json").write_text(json.dumps(option))
    root = os.path.dirname(os.path.dirname(os.path.abspath(common.__file__)))
    env = os.environ | {"PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    said = subprocess.run(
        [sys.executable, "-m", f"jobs.{job}", "--tables", small, "--out", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert said.returncode == 0, said.stderr[-2000:]
    assert "read " in said.stderr and "wrote " in said.stderr
    bad = common.defaults
    assert bad(trajectory_export.__file__)["csv"] is True


def test_unknown_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"windoes": 3}')
    with pytest.raises(ValueError, match="windoes"):
        common.configuration(spark, umbrella_ingest.__file__, str(tmp_path / "c.json"))
