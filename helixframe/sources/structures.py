"""Text structures: PDB, XYZ, restraint blocks, docking output and receptors.

Lines are read by Spark with their number, so that what needs the order of lines (models, blocks) is
a running sum over one file's lines.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.model import Trajectory, atoms_frame, from_long
from helixframe.plans.tables import materialise


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), text of each line of the files at a path or glob."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return lines


def _cut(start: int, end: int) -> Column:
    """Columns start..end of a line, 0-based and half open, trimmed."""
    return F.trim(F.substring("text", start + 1, end - start))


def read_pdb(spark: SparkSession, path: str) -> Trajectory:
    """S2, S3, S8. A trajectory of PDB text: a frame a MODEL (one if there is none), atoms from the first.

    Frames of several files follow one another in the order of the files' names; all hold the same atoms, which are
    read from the first one.  A blank element is the first letter of the atom's name, a blank chain A, a blank residue UNK, a
    blank residue number the atom's own number.
    """
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = numbered_lines(spark, path)
    model = F.sum(F.when(F.col("text").startswith("MODEL"), 1).otherwise(0)).over(order)
    kept = lines.withColumn("model", model).filter(F.col("text").rlike("^(ATOM  |HETATM)"))
    first = F.min("model").over(Window.partitionBy("file"))
    at = F.row_number().over(Window.partitionBy("file", "model").orderBy("line")) - 1
    name = _cut(12, 16)
    rows = kept.select(
        "file", (F.col("model") - first).cast("long").alias("frame"), at.cast("int").alias("atom_idx"), name.alias("atom_name"),
        F.when(_cut(17, 20) == "", "UNK").otherwise(_cut(17, 20)).alias("res_name"),
        F.when(_cut(21, 22) == "", "A").otherwise(_cut(21, 22)).alias("chain_id"),
        F.coalesce(_cut(22, 26).try_cast("long"), at + 1).alias("res_seq"),
        F.when(_cut(76, 78) == "", F.regexp_extract(name, "[A-Z]", 0)).otherwise(_cut(76, 78)).alias("element"),
        *[_cut(30 + 8 * k, 38 + 8 * k).try_cast("double").alias(c) for k, c in enumerate("xyz")],
    )
    numbered = rows.join(_frame_numbers(rows.select("file", "frame").distinct()).withColumnRenamed("t", "number"), ["file", "frame"])
    atoms = numbered.filter("number = 0").select("atom_idx", "atom_name", "res_name", "chain_id", "res_seq", "element")
    return from_long(numbered.select(F.col("number").alias("frame"), "atom_idx", "x", "y", "z"), atoms)


def _frame_numbers(models: DataFrame) -> DataFrame:
    """file, frame and t, the number from 0 of each (file, frame): files in order of their names, frames from 0 within one."""
    sizes = models.groupBy("file").agg(F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row a file
    order = Window.partitionBy("file").orderBy("frame")
    return models.join(starts, "file").select("file", "frame", (F.col("start") + F.row_number().over(order) - 1).alias("t"))


def parse_xyz(text: str) -> list[tuple[str, float, float, float]]:
    """S9. The atoms of XYZ text: a count, a comment, then rows of at least four fields."""
    lines = text.splitlines()
    try:
        n = int(lines[0].strip())
    except (IndexError, ValueError):
        raise ValueError("the first line is no atom count") from None
    rows = lines[2 : 2 + n]
    if len(rows) < n:
        raise ValueError(f"{n} atoms are announced, {len(rows)} are there")
    out = []
    for k, row in enumerate(rows):
        cells = row.split()
        if len(cells) < 4:
            raise ValueError(f"atom row {k + 1} has {len(cells)} fields")
        try:
            out.append((cells[0], *map(float, cells[1:4])))
        except ValueError:
            raise ValueError(f"atom row {k + 1} has a cell that is no number") from None
    return out


def read_xyz(spark: SparkSession, path: str) -> Trajectory:
    """S2. A trajectory of XYZ text, one or more frames a file; atoms are residue UNK and read from the first frame.

    Files are parsed by the executors; their frames follow one another in the order of the files' names.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(batches):
        for b in batches:
            for file, text in zip(b.file, b.value):
                lines, at, k = text.splitlines(), 0, 0
                while at < len(lines) and lines[at].strip():
                    rows = parse_xyz("\n".join(lines[at : at + 2 + int(lines[at])] if lines[at].strip().isdigit() else lines[at:]))
                    coordinates = [float(v) for r in rows for v in r[1:]]
                    yield pd.DataFrame([(file, k, [r[0] for r in rows] if k == 0 else None, coordinates)], columns=["file", "frame", "names", "xyz"])
                    at, k = at + 2 + len(rows), k + 1

    frames = whole.mapInPandas(run, "file string, frame long, names array<string>, xyz array<double>")
    frames = materialise(frames.join(_frame_numbers(frames.select("file", "frame")), ["file", "frame"]), "xyz-frames")
    first = frames.filter("t = 0").first()
    if first is None:
        raise ValueError("no frame was read")
    atoms = atoms_frame(spark, [(k, n, "UNK", "A", k + 1, n) for k, n in enumerate(first.names)])
    return Trajectory(frames.select(F.col("t").alias("frame"), "xyz"), atoms)


# ----------------------------------------------------------------------------------------------
# Restraints


class RestraintReader:
    """The restraint blocks of lines that come one by one; see parse_restraints()."""

    def __init__(self, column: int = 1):
        self.blocks: list[dict] = []
        self.column, self._comment, self._now = column, "", None

    def line(self, line: str) -> None:
        bare = line.strip()
        if bare.startswith("#"):
            self._comment = bare.lstrip("#").strip()
        elif "&rst" in bare.lower():
            self._now = {"iat": [], "rstwt": [], "r2": 0.0, "rk2": 0.0, "comment": self._comment}
        elif self._now is not None and (bare.lower().startswith("&end") or bare == "/"):
            _close(self.blocks, self._now, self.column)
            self._now, self._comment = None, ""
        elif self._now is not None:
            _fields(self._now, bare)


def parse_restraints(text: str, column: int = 1) -> list[dict]:
    """S7. The restraint blocks of a text: &rst opens one, &end or / closes it; without atoms it is dropped.

    Each has block_idx, iat, rstwt (all of its weights), r2, rk2 (the first nonzero of r2, r3 and of
    rk2, rk3), the comment before it and a label: the sign of the second weight, and a column counted from `column`.
    A text without blocks is an error.
    """
    reader = RestraintReader(column)
    for line in text.splitlines():
        reader.line(line)
    if not reader.blocks:
        raise ValueError("no restraint block")
    return reader.blocks


def _fields(block: dict, line: str) -> None:
    for m in re.finditer(r"([a-zA-Z]\w*)\s*=\s*([^=]*?)(?=,?\s*[a-zA-Z]\w*\s*=|$)", line):
        name, cells = m[1].lower(), [c.strip() for c in m[2].split(",") if c.strip()]
        if name == "iat":
            block["iat"] += [int(c) for c in cells if re.fullmatch(r"[+-]?\d+", c)]
            continue
        try:
            numbers = [float(c) for c in cells]
        except ValueError:
            continue
        if name == "rstwt":
            block["rstwt"] += numbers
        elif name in ("r2", "r3", "rk2", "rk3") and numbers:
            key = "r2" if name[0:2] in ("r2", "r3") else "rk2"
            block[key] = block[key] or numbers[0]


def _close(blocks: list[dict], block: dict, column: int) -> None:
    if not block["iat"]:
        return
    n, at = len(block["iat"]), column + len(blocks)
    weights = block["rstwt"]
    sign = "−" if len(weights) == 2 and weights[1] < 0 else "+"
    block["label"] = f"r1{sign}r2 (col {at})" if n == 4 and len(weights) == 2 else f"CV col {at} ({n} atoms)"
    blocks.append({"block_idx": len(blocks), **block})


def read_restraints(spark: SparkSession, path: str) -> DataFrame:
    """A row a block of each restraint file."""
    schema = "file string, block_idx int, iat array<long>, rstwt array<double>, r2 double, rk2 double, comment string, label string"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [{"file": f, **x} for f, t in zip(b.file, b.value) for x in parse_restraints(t)]
            yield pd.DataFrame(rows, columns=["file", "block_idx", "iat", "rstwt", "r2", "rk2", "comment", "label"])

    return whole.mapInPandas(run, schema)


# ----------------------------------------------------------------------------------------------
# Docking output and receptors


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """S10. file, rank, affinity, rmsd_lb, rmsd_ub, coords of the models of docking output that have a coordinate."""
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = numbered_lines(spark, path)
    rank = F.sum(F.when(F.col("text").startswith("MODEL"), 1).otherwise(0)).over(order)
    inside = lines.withColumn("rank", rank.cast("int")).filter("rank > 0")
    cells = F.split(F.trim(F.regexp_extract("text", "^REMARK VINA RESULT:?(.*)$", 1)), "\\s+")
    result = F.col("text").startswith("REMARK VINA RESULT")
    number = lambda k: F.coalesce(F.max(F.when(result, F.get(cells, F.lit(k)).try_cast("double"))), F.lit(0.0))
    here = F.struct("line", *[F.coalesce(_cut(30 + 8 * k, 38 + 8 * k).try_cast("double"), F.lit(0.0)).alias(c) for k, c in enumerate("xyz")])
    is_atom = F.col("text").rlike("^(ATOM|HETATM)")
    packed = inside.groupBy("file", "rank").agg(
        number(0).alias("affinity"), number(1).alias("rmsd_lb"), number(2).alias("rmsd_ub"),
        F.array_sort(F.collect_list(F.when(is_atom, here))).alias("a"),
    )
    coords = F.transform("a", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z")))
    return packed.filter(F.size("a") > 0).select("file", "rank", "affinity", "rmsd_lb", "rmsd_ub", coords.alias("coords"))


def receptor_center(spark: SparkSession, path: str) -> DataFrame:
    """S11. x, y, z: the unweighted mean of the atoms that are no hydrogen by their element columns."""
    rows = numbered_lines(spark, path).filter(F.col("text").rlike("^(ATOM|HETATM)") & ~_cut(76, 78).isin("H", "HD"))
    return rows.agg(*[F.avg(_cut(30 + 8 * k, 38 + 8 * k).try_cast("double")).alias(c) for k, c in enumerate("xyz")])


def receptor_pdb(spark: SparkSession, path: str) -> DataFrame:
    """S12. file, line, text of a PDBQT receptor as PDB: its own records dropped, atom lines cut to 80 columns."""
    lines = numbered_lines(spark, path).filter(~F.col("text").rlike("^(ROOT|ENDROOT|BRANCH|ENDBRANCH|TORSDOF)"))
    text = F.when(F.col("text").rlike("^(ATOM|HETATM)"), F.substring("text", 1, 80)).otherwise(F.col("text"))
    return lines.select("file", "line", text.alias("text"))


def pose_pdb(spark: SparkSession, path: str, rank: int) -> DataFrame:
    """S12. file, line, text of one model (from 1) of each file of docking output, between a remark and END; no such model is an error."""
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = numbered_lines(spark, path)
    model = F.sum(F.when(F.col("text").startswith("MODEL"), 1).otherwise(0)).over(order)
    one = lines.withColumn("model", model).filter((F.col("model") == rank) & F.col("text").rlike("^(ATOM|HETATM)"))
    if one.isEmpty():
        raise ValueError(f"there is no model {rank}")
    files = one.groupBy("file").agg((F.min("line") - 1).alias("head"), (F.max("line") + 1).alias("tail"))
    head = files.select("file", F.col("head").alias("line"), F.lit(f"REMARK  Docked pose {rank}").alias("text"))
    tail = files.select("file", F.col("tail").alias("line"), F.lit("END").alias("text"))
    return one.select("file", "line", F.substring("text", 1, 80).alias("text")).unionByName(head).unionByName(tail)
