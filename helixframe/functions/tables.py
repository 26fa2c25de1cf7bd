"""Table functions over the lines of files, for SQL: restraint blocks, XYZ frames and docking poses.

Each takes a table of file, line, text, `PARTITION BY file ORDER BY line`, and reads a file's lines one after
another, holding no more than the block, frame or pose that it is in:

    SELECT * FROM xyz_atoms(TABLE(lines) PARTITION BY file ORDER BY line)

What is wrong with a file is a row of it with `error` and nothing else; the other files are read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from helixframe.sources.structures import RestraintReader


@udtf(returnType="file string, block_idx int, iat array<long>, rstwt array<double>, r2 double, rk2 double, comment string, label string, error string")
class RestraintBlocks:
    """S7. A row a block; a file without blocks is an error."""

    def __init__(self):
        self.file, self.reader, self.given = None, RestraintReader(), 0

    def eval(self, row: Row) -> Iterator[tuple]:
        self.file = row["file"]
        self.reader.line(row["text"] or "")
        yield from self._new()

    def _new(self) -> Iterator[tuple]:
        for b in self.reader.blocks[self.given :]:
            self.given += 1
            yield self.file, b["block_idx"], b["iat"], b["rstwt"], b["r2"], b["rk2"], b["comment"], b["label"], None

    def terminate(self) -> Iterator[tuple]:
        if self.file is not None and not self.given:
            yield self.file, *[None] * 7, "no restraint block"


@udtf(returnType="file string, frame long, atom_idx int, element string, x double, y double, z double, error string")
class XyzAtoms:
    """S9. A row an atom of each frame: a count, a comment, then rows of at least four fields.

    The first thing that is wrong ends the file; blank lines between frames are passed over.
    """

    def __init__(self):
        self.file, self.frame, self.wanted, self.have, self.failed = None, 0, None, 0, None

    def eval(self, row: Row) -> Iterator[tuple]:
        self.file = row["file"]
        text = row["text"] or ""
        if self.failed:
            return
        if self.wanted is None:
            if text.strip() or (self.frame == 0 and self.have == 0):
                try:
                    self.wanted, self.have = int(text.strip()), -1
                except ValueError:
                    yield self._fail("the first line is no atom count" if self.frame == 0 else f"frame {self.frame} has no atom count")
        elif self.have < 0:
            self.have = 0  # the comment
            self._next()
        else:
            cells = text.split()
            if len(cells) < 4:
                yield self._fail(f"atom row {self.have + 1} has {len(cells)} fields")
                return
            try:
                at = [float(c) for c in cells[1:4]]
            except ValueError:
                yield self._fail(f"atom row {self.have + 1} has a cell that is no number")
                return
            yield self.file, self.frame, self.have, cells[0], *at, None
            self.have += 1
            self._next()

    def _next(self) -> None:
        if self.have == self.wanted:
            self.frame, self.wanted = self.frame + 1, None

    def _fail(self, why: str) -> tuple:
        self.failed = why
        return self.file, None, None, None, None, None, None, why

    def terminate(self) -> Iterator[tuple]:
        if self.file is not None and not self.failed and self.wanted is not None:
            yield self._fail(f"{self.wanted} atoms are announced, {max(0, self.have)} are there")


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return 0.0


@udtf(returnType="file string, rank int, affinity double, rmsd_lb double, rmsd_ub double, coords array<struct<x double, y double, z double>>, error string")
class DockedPoses:
    """S10. A row a model that has a coordinate; numbers that are missing are zero; a file without models is an error."""

    def __init__(self):
        self.file, self.rank, self.given = None, 0, 0
        self.result, self.coords = [0.0] * 3, []

    def eval(self, row: Row) -> Iterator[tuple]:
        self.file, text = row["file"], row["text"] or ""
        if text.startswith("MODEL"):
            yield from self._pose()
            self.rank += 1
        elif not self.rank:
            return
        elif text.startswith("REMARK VINA RESULT"):
            cells = text[len("REMARK VINA RESULT") :].lstrip(":").split()
            self.result = [_number(c) for c in (cells + [""] * 3)[:3]]
        elif text.startswith(("ATOM", "HETATM")):
            self.coords.append(tuple(_number(text[k : k + 8]) for k in (30, 38, 46)))

    def _pose(self) -> Iterator[tuple]:
        if self.coords:
            self.given += 1
            yield self.file, self.rank, *self.result, self.coords, None
        self.result, self.coords = [0.0] * 3, []

    def terminate(self) -> Iterator[tuple]:
        yield from self._pose()
        if self.file is not None and not self.given:
            yield self.file, *[None] * 5, "no pose"


FUNCTIONS = {"restraint_blocks": RestraintBlocks, "xyz_atoms": XyzAtoms, "docked_poses": DockedPoses}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL by their names."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
