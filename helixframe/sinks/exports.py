"""K2. The nineteen tables of a batch export: how each is computed, and its columns as the files have them.

A table is a DataFrame of the columns below in order; a matrix has rows i, j, value and no header.
All come from one Session, so what several need is computed once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import sasa, structural
from helixframe.plans.registry import Session

#: Decimals of the files: matrices, areas and membranes have four, all else six.
MATRIX_DIGITS, AREA_DIGITS, DIGITS = 4, 4, 6


@dataclass(frozen=True)
class Export:
    """order: the columns that the rows stand in order of."""

    build: Callable[[Session, dict], DataFrame]
    order: tuple[str, ...] = ("frame",)
    digits: int = DIGITS
    matrix: bool = False


def _clusters(run: Session, p: dict) -> dict[str, DataFrame]:
    return run.get("clustering", **p.get("clustering", {}))


def _membrane(run: Session, p: dict):
    return run.get("membrane", **p.get("membrane", {}))


def _membrane_frames(run: Session, p: dict) -> DataFrame:
    """Without a box there is no area, and no column of it."""
    made = _membrane(run, p)
    shown = [F.col("thickness").alias("thickness_angstrom")] + ([F.col("apl").alias("apl_angstrom2")] if made.traj.cells is not None else [])
    return made.per_frame().select("frame", *shown)


def _leaflets(run: Session, p: dict) -> DataFrame:
    side = lambda name: F.max(F.when(F.col("leaflet") == name, F.col("density"))).alias(f"{name}_norm")
    return _membrane(run, p).density().groupBy("bin").agg(side("upper"), side("lower"))


def _geometry(run: Session, p: dict) -> DataFrame:
    """A column a series, named by its label, in the order of the series."""
    asked = p.get("geometry", {"pairs": [[0, 1]]})
    rows = run.get("geometry_series", **{k: [tuple(x) for x in v] if k in ("pairs", "triplets", "composites") else v for k, v in asked.items()})
    labels = [r.label for r in rows.filter(F.col("t") == rows.agg(F.min("t")).first()[0]).orderBy("series_idx").collect()]  # a row a series
    value = lambda n, label: F.max(F.when(F.col("series_idx") == n, F.col("value"))).alias(label)
    if not labels:
        return rows.select(F.col("t").alias("index")).limit(0)
    return rows.groupBy(F.col("t").alias("index")).agg(*[value(n, label) for n, label in enumerate(labels)])


def _atom_index(df: DataFrame, **named: Column) -> DataFrame:
    return df.select(F.col("atom_idx").alias("atom_index"), *[c.alias(n) for n, c in named.items()])


# The names of the files and of their columns.
EXPORTS: dict[str, Export] = {
    "rmsd": Export(lambda run, p: run.get("rmsd").select("frame", F.col("rmsd").alias("rmsd_angstrom"))),
    "rmsf": Export(lambda run, p: _atom_index(run.get("rmsf"), rmsf_angstrom=F.col("rmsf")), ("atom_index",)),
    "rg": Export(lambda run, p: run.get("radius_of_gyration").select("frame", F.col("rg").alias("rg_angstrom"))),
    "pca": Export(lambda run, p: run.get("pca").projection()),
    "pca_variance": Export(lambda run, p: run.get("pca").variance().select("component", "explained_variance"), ("component",)),
    "dccm": Export(lambda run, p: run.get("dccm"), ("i", "j"), MATRIX_DIGITS, True),
    "contacts": Export(lambda run, p: run.get("contacts", **p.get("contacts", {})).withColumnRenamed("freq", "value"), ("i", "j"), MATRIX_DIGITS, True),
    "mutual_information": Export(lambda run, p: run.get("mutual_information"), ("i", "j"), MATRIX_DIGITS, True),
    "prs_effectiveness": Export(lambda run, p: run.get("prs").select("atom_idx", "effectiveness"), ("atom_idx",)),
    "prs_sensitivity": Export(lambda run, p: run.get("prs").select("atom_idx", "sensitivity"), ("atom_idx",)),
    "sasa_per_residue": Export(
        lambda run, p: sasa.per_residue(run.get("sasa", **p.get("sasa", {}))).select("res_idx", "residue", F.col("mean_sasa").alias("mean_sasa_a2"), F.col("std_sasa").alias("std_sasa_a2")),
        ("res_idx",), AREA_DIGITS,
    ),
    "sasa_total": Export(lambda run, p: sasa.total(run.get("sasa", **p.get("sasa", {}))).select("frame", F.col("total_sasa").alias("total_sasa_a2")), digits=AREA_DIGITS),
    "membrane_per_frame": Export(_membrane_frames, digits=AREA_DIGITS),
    "membrane_order_params": Export(lambda run, p: _membrane(run, p).order().select("pair", F.col("label").alias("carbon"), "abs_scd"), ("pair",), AREA_DIGITS),
    "membrane_z_density": Export(_leaflets, ("bin",), AREA_DIGITS),
    "dihedrals": Export(lambda run, p: run.get("dihedral_summary").select("atom_idx", "res_name", "res_seq", "phi_mean", "psi_mean", "phi_std", "psi_std"), ("atom_idx",)),
    "clustering": Export(lambda run, p: _clusters(run, p)["assignments"].select(F.col("t").alias("frame"), F.col("cluster").alias("cluster_id"))),
    "cluster_populations": Export(lambda run, p: _clusters(run, p)["populations"].select(F.col("cluster").alias("cluster_id"), "population"), ("cluster_id",)),
    "geometry": Export(_geometry, ("index",)),
}
#: Columns that only give the order of the rows; the files do not have them.
ORDER_ONLY = {"sasa_per_residue": "res_idx", "membrane_order_params": "pair"}


def table(run: Session, name: str, params: dict | None = None) -> DataFrame:
    """The rows of one export, numbers as they are; params: by analysis, as the registry takes them."""
    if name not in EXPORTS:
        raise ValueError(f"unknown export {name!r}")
    return EXPORTS[name].build(run, params or {})


def tidy(df: DataFrame, name: str) -> DataFrame:
    """row, item, value: a row of the result a number, under the index that its rows have and its column's name.

    A matrix has the column's number as the item.  Text columns of a result are no rows.
    """
    export = EXPORTS[name]
    if export.matrix:
        return df.select(F.col("i").cast("long").alias("row"), F.col("j").cast("string").alias("item"), F.col("value").cast("double").alias("value"))
    key = export.order[0]
    numbers = [c for c, t in df.dtypes if c != key and t in ("double", "float", "int", "bigint", "smallint")]
    items = F.array(*[F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").cast("double").alias("value")) for c in numbers])
    return df.select(F.col(f"`{key}`").cast("long").alias("row"), F.inline(items))


def write_csv(df: DataFrame, name: str, path: str) -> None:
    """One folder of CSV, with the header that the file has and its decimals; nulls are NaN.

    Rows are written in their order, over as many files as a range partitioning of them makes; matrices
    are turned by their rows, a row of the matrix a line.
    """
    export = EXPORTS[name]
    number = lambda c: F.when(c.isNull(), "NaN").otherwise(F.format_string(f"%.{export.digits}f", c))
    if export.matrix:
        cells = F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda s: number(s["value"]))
        lines = df.groupBy("i").agg(F.array_join(cells, ",").alias("text"))
        lines.repartitionByRange("i").sortWithinPartitions("i").select("text").write.mode("overwrite").text(path)
        return
    ordered = df.repartitionByRange(*export.order).sortWithinPartitions(*export.order)
    shown = [number(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in ordered.dtypes if c != ORDER_ONLY.get(name)]
    ordered.select(*shown).write.mode("overwrite").option("header", True).csv(path)
