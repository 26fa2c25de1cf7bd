"""The jobs as queries: each is run twice into a new folder, and gives the output that the folder then holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe import catalog
from helixframe.operators import mbar
from helixframe.plans.tables import fresh_path
from jobs import trajectory_export, umbrella_ingest
from jobs.common import defaults


def job1_trajectory_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "job1")
    trajectory_export.run(spark, sf_dir, out)
    return catalog.rounded(trajectory_export.run(spark, sf_dir, out))


def job2_umbrella_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "job2")
    umbrella_ingest.run(spark, sf_dir, out)
    return catalog.rounded(umbrella_ingest.run(spark, sf_dir, out))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_trajectory_export, job2_umbrella_ingest)}

#: export, the catalogue's query that states it, its row, and the items with their values.
_EXPORTED = [
    ("rmsd", "rmsd", "frame", {"'rmsd_angstrom'": "rmsd"}),
    ("rmsf", "rmsf", "atom_idx", {"'rmsf_angstrom'": "rmsf"}),
    ("rg", "radius_of_gyration", "frame", {"'rg_angstrom'": "rg"}),
    ("dccm", "dccm", "i", {"j::VARCHAR": "value"}),
    ("contacts", "contact_map", "i", {"j::VARCHAR": "freq"}),
    ("mutual_information", "mutual_information", "i", {"j::VARCHAR": "value"}),
    ("prs_effectiveness", "prs_effectiveness", "atom_idx", {"'effectiveness'": "effectiveness"}),
    ("prs_sensitivity", "prs_sensitivity", "atom_idx", {"'sensitivity'": "sensitivity"}),
    ("sasa_per_residue", "sasa_per_residue", "res_idx", {"'mean_sasa_a2'": "mean_sasa", "'std_sasa_a2'": "std_sasa"}),
    ("sasa_total", "sasa_total", "frame", {"'total_sasa_a2'": "total_sasa"}),
    ("membrane_per_frame", "membrane_thickness", "frame", {"'thickness_angstrom'": "thickness"}),
    ("membrane_per_frame", "membrane_apl", "frame", {"'apl_angstrom2'": "apl"}),
    ("membrane_order_params", "lipid_order", "pair", {"'abs_scd'": "abs_scd"}),
    ("membrane_z_density", "membrane_z_density", "bin", {"leaflet || '_norm'": "density"}),
    ("dihedrals", "dihedral_summary", "atom_idx", {f"'{c}'": c for c in ("res_seq", "phi_mean", "psi_mean", "phi_std", "psi_std")}),
    ("geometry", "geometry_distance", "t", {"label": "value"}),
    ("geometry", "geometry_composite", "t", {"'RC(0−1)'": "value"}),
]

_CONFIG = defaults(umbrella_ingest.__file__)
_LOW = _CONFIG["windows"]["low"] - _CONFIG["margin"]
_WIDTH = _CONFIG["windows"]["high"] - _CONFIG["windows"]["low"] + 2 * _CONFIG["margin"]
_STIFF = (mbar.beta(_CONFIG["temperature"]) * _CONFIG["force"]) ** 0.5

SQL: dict[str, str] = {
    "job1_trajectory_export": "\nUNION ALL\n".join(
        f"SELECT '{export}' AS export, {row}::BIGINT AS row, {item} AS item, {value}::DOUBLE AS value FROM (\n{catalog.SQL[name]}\n)"
        for export, name, row, items in _EXPORTED
        for item, value in items.items()
    ),
    "job2_umbrella_ingest": catalog.complete(f"""
WITH b AS (
  SELECT window_idx, greatest(0, least({_CONFIG["bins"] - 1}, floor((x - {_LOW!r}::DOUBLE) / {_WIDTH!r}::DOUBLE * {_CONFIG["bins"]})))::INT AS bin, count(*) AS k
  FROM cv WHERE isfinite(x) GROUP BY ALL
), s AS (
  SELECT window_idx, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi, any_value(w.val0) AS val0
  FROM cv JOIN windows w USING (window_idx) WHERE isfinite(x) GROUP BY window_idx
), p AS (
  SELECT window_idx, bin, k / n AS p FROM b JOIN s USING (window_idx)
), o AS (
  SELECT a.window_idx, sum(least(a.p, c.p)) AS overlap FROM p a JOIN p c ON c.window_idx = a.window_idx + 1 AND c.bin = a.bin GROUP BY a.window_idx
), m AS (
  SELECT window_idx, unnest([{{'measure': 'n', 'value': n::DOUBLE}}, {{'measure': 'mean', 'value': mean}}, {{'measure': 'std', 'value': std}}, {{'measure': 'lo', 'value': lo}},
    {{'measure': 'hi', 'value': hi}}, {{'measure': 'offset', 'value': (mean - val0) * {_STIFF!r}::DOUBLE}}, {{'measure': 'overlap', 'value': coalesce(overlap, 0)::DOUBLE}}], recursive := true)
  FROM s LEFT JOIN o USING (window_idx)
)
SELECT measure, window_idx, -1 AS bin, {{{{value}}}} AS value FROM m
UNION ALL SELECT 'histogram', window_idx, bin, k::DOUBLE FROM b"""),
}
