"""S3. Topologies: PDB, PSF and the sectioned parm7/prmtop text, as the atoms' table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from helixframe.model import atoms_frame
from helixframe.sources.structures import read_pdb


def parse_psf(text: str) -> list[tuple]:
    """Atoms of the !NATOM section: number, segment, residue, residue name, name, type."""
    lines = iter(text.splitlines())
    for line in lines:
        if m := re.match(r"\s*(\d+)\s+!NATOM", line):
            break
    else:
        raise ValueError("the PSF file has no atoms")
    out = []
    for k in range(int(m[1])):
        cells = next(lines, "").split()
        if len(cells) < 6:
            raise ValueError(f"atom {k + 1} of the PSF file is cut off")
        number = re.match(r"-?\d+", cells[2])
        out.append((k, cells[4], cells[3], cells[1][:1] or "A", int(number[0]) if number else k + 1, _element(cells[5], cells[4])))
    return out


def _sections(text: str) -> dict[str, list[str]]:
    """The values of each %FLAG section, cut by the width that its %FORMAT states."""
    out: dict[str, list[str]] = {}
    flag, width = "", 0
    for line in text.splitlines():
        if line.startswith("%FLAG"):
            flag = line[5:].strip()
            out[flag] = []
        elif line.startswith("%FORMAT"):
            m = re.search(r"\(\s*\d*\s*[aIiEeFf]\s*(\d+)", line)
            width = int(m[1]) if m else 0
        elif flag and width and not line.startswith("%"):
            out[flag] += [line[i : i + width].strip() for i in range(0, len(line.rstrip("\n")), width) if line[i : i + width].strip()]
    return out


def parse_parm7(text: str) -> list[tuple]:
    """Atoms by name and type; a residue begins at each of its pointers."""
    found = _sections(text)
    if "ATOM_NAME" not in found:
        raise ValueError("the topology has no atom names")
    names = found["ATOM_NAME"]
    labels, starts = found.get("RESIDUE_LABEL", []), [int(x) - 1 for x in found.get("RESIDUE_POINTER", [])]
    types = found.get("AMBER_ATOM_TYPE", names)
    numbers = [int(x) for x in found.get("ATOMIC_NUMBER", [])]
    out, residue = [], -1
    for k, name in enumerate(names):
        while residue + 1 < len(starts) and starts[residue + 1] <= k:
            residue += 1
        label = labels[residue] if 0 <= residue < len(labels) else "UNK"
        kind = _NUMBERED.get(numbers[k]) if k < len(numbers) else None
        out.append((k, name, label, "A", residue + 1 if residue >= 0 else k + 1, kind or _element(types[k] if k < len(types) else "", name)))
    return out


# Elements by atomic number.
_NUMBERED = {1: "H", 6: "C", 7: "N", 8: "O", 9: "F", 11: "Na", 12: "Mg", 15: "P", 16: "S", 17: "Cl", 19: "K", 20: "Ca", 26: "Fe", 30: "Zn", 35: "Br", 53: "I"}


def _element(kind: str, name: str) -> str:
    """The element of a force-field type: its own if it is one of two letters, else the name's first letter."""
    two = kind[:2].capitalize()
    if two in ("Cl", "Br", "Na", "Mg", "Zn", "Fe") and len(kind) <= 3:
        return two
    found = re.search("[A-Za-z]", name)
    return found[0].upper() if found else "C"


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """The atoms of a topology file by its suffix: pdb, psf, parm7 or prmtop."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "pdb":
        return read_pdb(spark, path).atoms
    parse = {"psf": parse_psf, "parm7": parse_parm7, "prmtop": parse_parm7}.get(kind)
    if parse is None:
        raise ValueError(f"unknown topology format {kind!r}")
    return atoms_frame(spark, parse(spark.read.text(path, wholetext=True).first()[0]))
