"""The table functions from SQL, over a table of several files, against the parsers of whole texts."""

from __future__ import annotations

import pytest

from helixframe.functions import tables
from helixframe.sources.structures import parse_restraints, parse_xyz, read_poses

RESTRAINTS = """# first distance
 &rst iat=0,
  iat=1,2,2,3, rstwt=1.,-1.,
  r2=-0.95, r3=-0.95, rk2=150.0, rk3=150.0,
 &end
 &rst
  iat=5,6
  r2=0., r3=2.5,
 /
 &rst
 &end
"""
XYZ = "2\nwater\nO 0 0 0\nH 1.5 0 -2e-1 extra\n2\n\nO 9 9 9\nH 8 8 8\n"
POSES = """REMARK before
MODEL 1
REMARK VINA RESULT:    -7.1      0.000      0.000
ATOM      1  C   UNL     1       1.000   2.000   3.500  0.00  0.00    +0.000 C
HETATM    2  N   UNL     1      -1.000   x       0.250  0.00  0.00    +0.000 N
ENDMDL
MODEL 2
REMARK VINA RESULT:    -6.5      1.5
ENDMDL
MODEL 3
ATOM      1  C   UNL     1       4.000   5.000   6.000  0.00  0.00    +0.000 C
ENDMDL
"""


@pytest.fixture
def lines(spark):
    tables.register(spark)

    def view(files: dict[str, str]):
        rows = [(f, k, t) for f, text in files.items() for k, t in enumerate(text.splitlines())]
        spark.createDataFrame(rows, "file string, line int, text string").repartition(3).createOrReplaceTempView("lines")

    return view


def query(spark, function, columns="*"):
    return spark.sql(f"SELECT {columns} FROM {function}(TABLE(lines) PARTITION BY file ORDER BY line)")


def test_restraints(spark, lines):
    lines({"a": RESTRAINTS, "none": "# nothing\nhere", "b": "&rst\niat=1,2,\n&end"})
    rows = query(spark, "restraint_blocks").orderBy("file", "block_idx").collect()
    want = parse_restraints(RESTRAINTS)
    got = [r for r in rows if r.file == "a"]
    assert [{k: r[k] for k in want[0]} for r in got] == want and len(want) == 2
    assert [(r.iat, r.error) for r in rows if r.file != "a"] == [([1, 2], None), (None, "no restraint block")]


def test_xyz(spark, lines):
    bad = {"short": "3\n\nO 0 0 0", "fields": "1\n\nO 0 0", "number": "1\n\nO 0 0 zero\nO 1 1 1", "count": "many\n\nO 0 0 0", "late": XYZ + "x\n"}
    lines({"ok": XYZ, **bad})
    rows = query(spark, "xyz_atoms").collect()
    ok = sorted((r.frame, r.atom_idx, r.element, r.x, r.y, r.z) for r in rows if r.file == "ok")
    first, second = parse_xyz(XYZ), parse_xyz("\n".join(XYZ.splitlines()[4:]))
    assert ok == [(f, k, *a) for f, atoms in enumerate((first, second)) for k, a in enumerate(atoms)]
    errors = {r.file: r.error for r in rows if r.error}
    assert set(errors) == set(bad) and "3 atoms are announced, 1 are there" == errors["short"]
    for name in ("short", "fields", "number", "count"):
        with pytest.raises(ValueError, match=errors[name]):
            parse_xyz(bad[name])
    assert sum(r.file == "late" and not r.error for r in rows) == 4


def test_poses(spark, lines, tmp_path):
    lines({"a": POSES, "none": "REMARK\n"})
    rows = query(spark, "docked_poses").orderBy("file", "rank").collect()
    assert [(r.file, r.rank, r.error) for r in rows] == [("a", 1, None), ("a", 3, None), ("none", None, "no pose")]
    (tmp_path / "a.pdbqt").write_text(POSES)
    want = read_poses(spark, f"{tmp_path}/a.pdbqt").orderBy("rank").collect()
    assert [tuple(r)[1:6] for r in rows[:2]] == [tuple(r)[1:6] for r in want]


def test_lateral_join_and_empty_table(spark, lines):
    lines({"a": XYZ, "b": XYZ})
    spark.createDataFrame([("a", "first run")], "file string, run string").createOrReplaceTempView("runs")
    joined = spark.sql("SELECT run, count(*) AS n FROM runs JOIN (SELECT * FROM xyz_atoms(TABLE(lines) PARTITION BY file ORDER BY line)) USING (file) GROUP BY run").first()
    assert tuple(joined) == ("first run", 4)
    spark.table("lines").limit(0).createOrReplaceTempView("lines")
    assert query(spark, "xyz_atoms").count() == 0
