"""Molecules as rows: the same operators over a column of SMILES, a molecule a row, in parallel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.ligand import forcefield, writers
from helixframe.ligand.molecule import Molecule, parse_smiles, to_smiles

PROPERTIES = T.StructType(
    [
        T.StructField("formula", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("n_atoms", T.IntegerType()),
        T.StructField("n_bonds", T.IntegerType()), T.StructField("n_rings", T.IntegerType()), T.StructField("torsions", T.IntegerType()),
        T.StructField("charge", T.IntegerType()), T.StructField("smiles_out", T.StringType()), T.StructField("error", T.StringType()),
    ]
)


def _safe(text: str | None, make: Callable[[Molecule], dict]) -> dict:
    """What make() gives of a parsed molecule; text that is no SMILES gives its error."""
    if text is None:
        return {"error": "no SMILES"}
    try:
        return make(parse_smiles(text))
    except (ValueError, IndexError) as e:
        return {"error": str(e)}


def properties(frame: DataFrame, column: str = "smiles") -> DataFrame:
    """frame with `properties` of each molecule; unreadable SMILES have only an error."""

    def one(m: Molecule) -> dict:
        return {
            "formula": m.formula(), "weight": round(m.weight(), 3), "n_atoms": len(m.atoms), "n_bonds": len(m.bonds), "n_rings": len(m.rings()),
            "torsions": writers.torsions(m), "charge": m.charge, "smiles_out": to_smiles(m), "error": None,
        }

    run = F.udf(lambda t: tuple(_safe(t, one).get(k) for k in PROPERTIES.names), PROPERTIES, useArrow=True)
    return frame.withColumn("properties", run(F.col(column)))


def minimised(frame: DataFrame, column: str = "smiles", hydrogens: bool = True, steps: int = 500) -> DataFrame:
    """frame with `xyz`, `energy` and `error`: generated and minimised coordinates as XYZ text."""
    schema = T.StructType([T.StructField("xyz", T.StringType()), T.StructField("energy", T.DoubleType()), T.StructField("error", T.StringType())])

    def one(m: Molecule) -> dict:
        m = m.laid_out()
        m = m.with_hydrogens() if hydrogens else m
        at, _, energy = forcefield.minimise(m, forcefield.generate_coordinates(m), steps)
        return {"xyz": writers.to_xyz(m, at), "energy": energy, "error": None}

    run = F.udf(lambda t: tuple(_safe(t, one).get(k) for k in schema.names), schema, useArrow=True)
    return frame.withColumn("m", run(F.col(column))).select("*", "m.*").drop("m")
