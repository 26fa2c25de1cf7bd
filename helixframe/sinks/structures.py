"""Structures as PDB text, and CSV exports of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.model import Trajectory

# Residues that are written as ATOM; all others are HETATM.
STANDARD_RESIDUES = [
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP",
    "TYR", "VAL", "HIE", "HID", "HIP", "CYX", "ASH", "GLH", "LYN", "CYM", "ACE", "NME", "NHE", "WAT", "HOH", "SOL", "TIP", "TIP3", "TP3",
]
# Residues that a region mask names by number.
PROTEIN_RESIDUES = [
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP",
    "TYR", "VAL", "HIE", "HID", "HIP", "CYX", "ASH", "GLH",
]


def _pad(text: Column, width: int, right: bool = False) -> Column:
    cut = F.substring(text, 1, width)
    return F.lpad(cut, width, " ") if right else F.rpad(cut, width, " ")


def is_hetero(res_name: Column) -> Column:
    return ~res_name.isin(STANDARD_RESIDUES)


def pdb_line(bfactor: Column) -> Column:
    """K3. The record of an atom from atom_idx, atom_name, res_name, chain_id, res_seq, element, x, y, z."""
    name = F.when(F.length("element") == 1, F.concat(F.lit(" "), _pad(F.col("atom_name"), 3))).otherwise(_pad(F.col("atom_name"), 4))
    return F.format_string(
        "%s%5d %s %s %s%4d    %8.3f%8.3f%8.3f  1.00%6.2f          %s",
        F.when(is_hetero(F.col("res_name")), "HETATM").otherwise("ATOM  "), F.col("atom_idx") + 1, name, _pad(F.col("res_name"), 3),
        _pad(F.col("chain_id"), 1), F.col("res_seq"), F.col("x"), F.col("y"), F.col("z"), bfactor, _pad(F.col("element"), 2, right=True),
    )


def pdb_lines(traj: Trajectory, frame: int, bfactors: DataFrame | None = None, bonds: DataFrame | None = None) -> DataFrame:
    """K3, K4, K5. line, text of one frame; bonds (a, b: atom_idx) that touch a hetero atom become CONECT records."""
    one = traj.where(traj.frames.filter(F.col("frame") == frame))
    if one.frames.isEmpty():
        raise ValueError(f"frame {frame} is out of range")
    rows = one.long.join(F.broadcast(traj.atoms), "atom_idx")  # the atoms of one frame
    b = F.lit(0.0)
    if bfactors is not None:
        rows = rows.join(F.broadcast(bfactors.select("atom_idx", F.col("bfactor").alias("__b"))), "atom_idx", "left")
        b = F.coalesce("__b", F.lit(0.0))
    n = traj.n_atoms
    lines = rows.select(F.col("atom_idx").cast("long").alias("line"), pdb_line(b).alias("text"))
    if bonds is not None:
        lines = lines.unionByName(_conect(traj, bonds))
    tail = traj.spark.createDataFrame([(10 * n + 10, "TER"), (10 * n + 11, "END")], "line long, text string")
    return lines.unionByName(tail)


def _conect(traj: Trajectory, bonds: DataFrame) -> DataFrame:
    het = traj.atoms.filter(is_hetero(F.col("res_name"))).select(F.col("atom_idx").alias("h"))
    touched = bonds.join(F.broadcast(het), (F.col("a") == F.col("h")) | (F.col("b") == F.col("h")), "left_semi")
    both = touched.select(F.col("a").alias("i"), F.col("b").alias("j")).unionByName(touched.select(F.col("b").alias("i"), F.col("a").alias("j")))
    partners = both.groupBy("i").agg(F.array_sort(F.collect_list("j")).alias("p"))
    fours = F.transform(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / 4).cast("int")), lambda k: F.slice("p", k * 4 + 1, 4))
    rows = partners.select("i", F.posexplode(fours).alias("k", "four"))
    ends = F.array_join(F.transform("four", lambda j: F.lpad((j + 1).cast("string"), 5, " ")), "")
    text = F.concat(F.lit("CONECT"), F.lpad((F.col("i") + 1).cast("string"), 5, " "), ends)
    return rows.select((F.lit(traj.n_atoms) + F.col("i") * 8 + F.col("k")).cast("long").alias("line"), text.alias("text"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file of line, text in order: a structure, not a corpus."""
    lines.repartition(1).sortWithinPartitions("line").select("text").write.text(path)


# ----------------------------------------------------------------------------------------------
# CSV


def _number(name: str, digits: int) -> Column:
    return F.when(F.col(name).isNull(), "NaN").otherwise(F.format_string(f"%.{digits}f", F.col(name)))


def export_wide(rmsd: DataFrame | None = None, rmsf: DataFrame | None = None, rg: DataFrame | None = None) -> DataFrame:
    """K1. frame and the given series side by side by index, six decimals, NaN where one has ended.

    RMSF is by atom but stands under the same index, as the format has it.
    """
    parts = []
    if rmsd is not None:
        parts.append(rmsd.select(F.col("frame").cast("long").alias("frame"), F.col("rmsd").alias("rmsd_angstrom")))
    if rmsf is not None:
        parts.append(rmsf.select(F.col("atom_idx").cast("long").alias("frame"), F.col("rmsf").alias("rmsf_angstrom")))
    if rg is not None:
        parts.append(rg.select(F.col("frame").cast("long").alias("frame"), F.col("rg").alias("rg_angstrom")))
    if not parts:
        raise ValueError("no series was computed")
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "frame", "full_outer")
    return out.select("frame", *[_number(c, 6).alias(c) for c in out.columns if c != "frame"])


def pivot_matrix(cells: DataFrame, n: int, digits: int = 4) -> DataFrame:
    """K2. i and columns c0..c(n-1) of a matrix of rows i, j, value, as text of four decimals."""
    wide = cells.groupBy("i").pivot("j", list(range(n))).agg(F.first("value"))
    return wide.select("i", *[F.format_string(f"%.{digits}f", F.coalesce(F.col(f"`{j}`"), F.lit(0.0))).alias(f"c{j}") for j in range(n)])


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.option("header", header).csv(path)


def batch_export(results: dict[str, DataFrame], folder: str, n_atoms: int = 0) -> list[str]:
    """K2. A CSV folder for each named result; matrices (rows i, j, value) have no header and four decimals."""
    written = []
    for name, df in results.items():
        if {"i", "j", "value"} <= set(df.columns):
            table = pivot_matrix(df, n_atoms).orderBy("i").drop("i")
            write_csv(table, f"{folder}/{name}.csv", header=False)
        else:
            digits = 4 if name.startswith(("sasa", "membrane")) else 6
            shown = [F.format_string(f"%.{digits}f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
            write_csv(df.select(*shown), f"{folder}/{name}.csv")
        written.append(f"{name}.csv")
    return written


# ----------------------------------------------------------------------------------------------
# Quantum regions


def region_atoms(traj: Trajectory, frame: int, serials: list[int]) -> DataFrame:
    """N24. serial and the atoms' data of the serials (from 1) that exist; none is an error."""
    wanted = traj.spark.createDataFrame([(s,) for s in serials], "serial int")
    one = traj.where(traj.frames.filter(F.col("frame") == frame))
    rows = one.long.join(F.broadcast(traj.atoms), "atom_idx").withColumn("serial", F.col("atom_idx") + 1).join(F.broadcast(wanted), "serial")
    if rows.isEmpty():
        raise ValueError("no serial names an atom")
    return rows.select("serial", "atom_name", "res_name", "res_seq", "chain_id", "element", "x", "y", "z")


def region_mask(region: DataFrame) -> DataFrame:
    """N24. mask, n_atoms: protein residues by number, then other residues by name."""
    protein = F.col("res_name").isin(PROTEIN_RESIDUES)
    told = region.agg(
        F.array_sort(F.collect_set(F.when(protein, F.col("res_seq")))).alias("numbers"),
        F.array_sort(F.collect_set(F.when(~protein, F.col("res_name")))).alias("names"), F.count("*").alias("n_atoms"),
    )
    numbered = F.when(F.size("numbers") > 0, F.array(F.concat(F.lit(":"), F.array_join(F.col("numbers").cast("array<string>"), ",")))).otherwise(F.array().cast("array<string>"))
    named = F.transform("names", lambda x: F.concat(F.lit(":"), x))
    return told.select(F.array_join(F.concat(numbered, named), " | ").alias("mask"), F.col("n_atoms").cast("int").alias("n_atoms"))


def append_to_region(region: DataFrame, ligand: DataFrame) -> DataFrame:
    """T8. region with a ligand's atoms (idx, element, x, y, z) under new serials, residue LIG 9999 of chain L."""
    top = region.agg(F.coalesce(F.max("serial"), F.lit(0)).alias("top"))
    added = ligand.crossJoin(F.broadcast(top)).select(  # one row
        (F.col("top") + 1 + F.col("idx")).cast("int").alias("serial"), F.concat(F.col("element"), (F.col("idx") + 1).cast("string")).alias("atom_name"),
        F.lit("LIG").alias("res_name"), F.lit(9999).cast("long").alias("res_seq"), F.lit("L").alias("chain_id"), "element", "x", "y", "z",
    )
    return region.unionByName(added)


def region_xyz(region: DataFrame, title: str = "QM region") -> DataFrame:
    """K11. line, text of a region as XYZ with six decimals."""
    at = F.format_string("%-2s %12.6f %12.6f %12.6f", F.col("element"), F.col("x"), F.col("y"), F.col("z"))
    rows = region.select((F.col("serial") + 1).cast("long").alias("line"), at.alias("text"))
    head = region.agg(F.count("*").cast("string").alias("text")).select(F.lit(0).cast("long").alias("line"), "text")
    spark = region.sparkSession
    return head.unionByName(spark.createDataFrame([(1, title)], "line long, text string")).unionByName(rows)


def region_orca(region: DataFrame) -> DataFrame:
    """K11. line, text of a region as an ORCA coordinate block of charge 0 and multiplicity 1."""
    at = F.format_string("  %-2s %12.6f %12.6f %12.6f", F.col("element"), F.col("x"), F.col("y"), F.col("z"))
    rows = region.select((F.col("serial") + 10).cast("long").alias("line"), at.alias("text"))
    top = region.agg(F.max("serial").alias("m")).select((F.col("m") + 11).cast("long").alias("line"), F.explode(F.array(F.lit("  end"))).alias("text"))
    end = region.agg(F.max("serial").alias("m")).select((F.col("m") + 12).cast("long").alias("line"), F.lit("end").alias("text"))
    head = region.sparkSession.createDataFrame(list(enumerate(["%coords", "  CTyp xyz", "  Charge 0", "  Mult 1", "  Units Angs", "  coords"])), "line long, text string")
    return head.unionByName(rows).unionByName(top).unionByName(end)
