from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helixframe.operators import structural
from helixframe.selection import compile_selection, resolve_mask
from helixframe.sinks import project
from helixframe.sinks import structures as sinks
from helixframe.sources import structures, umbrella
from tests.builders import make, noise

PDB = """HEADER    test
MODEL        1
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00           N
ATOM      2  CA  ALA A   1      11.639   6.071  -5.147  1.00  0.00           C
HETATM    3 ZN    ZN B  99       1.000   2.000   3.000  1.00  0.00          ZN
ATOM      4  H1  UNK             0.000   0.000   0.000
ENDMDL
MODEL        2
ATOM      1  N   ALA A   1      12.104   6.134  -6.504  1.00  0.00           N
ATOM      2  CA  ALA A   1      12.639   6.071  -5.147  1.00  0.00           C
HETATM    3 ZN    ZN B  99       2.000   2.000   3.000  1.00  0.00          ZN
ATOM      4  H1  UNK             1.000   0.000   0.000
ENDMDL
END
"""


def write(path, text) -> str:
    path.write_text(text)
    return str(path)


def test_pdb(spark, tmp_path):
    t = structures.read_pdb(spark, write(tmp_path / "a.pdb", PDB))
    assert (t.n_frames, t.n_atoms) == (2, 4)
    rows = t.atom_rows
    assert [(r.atom_name, r.res_name, r.chain_id, r.res_seq, r.element) for r in rows] == [
        ("N", "ALA", "A", 1, "N"), ("CA", "ALA", "A", 1, "C"), ("ZN", "ZN", "B", 99, "ZN"), ("H1", "UNK", "A", 4, "H"),
    ]
    assert t.frames.orderBy("frame").first().xyz[:3] == [11.104, 6.134, -6.504]
    assert structural.rmsd(t).filter("frame = 1").first().rmsd == pytest.approx(1)


def test_pdb_round_trip(spark, tmp_path):
    t = structures.read_pdb(spark, write(tmp_path / "a.pdb", PDB))
    bonds = spark.createDataFrame([(0, 1), (1, 2)] + [(2, 3)], "a int, b int")
    lines = [r.text for r in sinks.pdb_lines(t, 0, bonds=bonds).orderBy("line").collect()]
    assert lines[0] == "ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00           N"
    assert lines[2] == "HETATM    3 ZN   ZN  B  99       1.000   2.000   3.000  1.00  0.00          ZN"
    assert [x for x in lines if x.startswith("CONECT")] == ["CONECT    2    3", "CONECT    3    2    4", "CONECT    4    3"]
    assert lines[-2:] == ["TER", "END"]
    sinks.write_lines(sinks.pdb_lines(t, 1), str(tmp_path / "out"))
    again = structures.read_pdb(spark, str(tmp_path / "out"))
    assert again.frames.first().xyz == t.frames.filter("frame = 1").first().xyz
    b = spark.createDataFrame([(0, 7.5)], "atom_idx int, bfactor double")
    assert sinks.pdb_lines(t, 0, b).orderBy("line").first().text[60:66] == "  7.50"
    with pytest.raises(ValueError, match="out of range"):
        sinks.pdb_lines(t, 9)


def test_xyz(spark, tmp_path):
    text = "2\nfirst\nC 0 0 0\nO 1 2 3 extra\n2\nsecond\nC 1 0 0\nO 1 2 4\n"
    t = structures.read_xyz(spark, write(tmp_path / "a.xyz", text))
    assert (t.n_frames, t.n_atoms) == (2, 2) and t.atom_rows[1].element == "O"
    for bad, why in (("2\nc\nC 0 0\nO 1 1 1", "fields"), ("3\nc\nC 0 0 0\n", "announced"), ("x\n", "count"), ("1\nc\nC a b c", "number"), ("", "count")):
        with pytest.raises(ValueError, match=why):
            structures.parse_xyz(bad)


RST = """# first
 &rst
  iat=1,2,2,3,
  rstwt=1.,-1.,
  r1=-99., r2=0.0, r3=-0.95, r4=99.,
  rk2=0., rk3=150.0,
 &end
 &rst
  iat = 5, 6, r2=1.5, rk2=20
 /
 &rst
  r2=3.0
 &end
"""


def test_restraints(spark, tmp_path):
    a, b = structures.parse_restraints(RST)
    assert (a["iat"], a["rstwt"], a["r2"], a["rk2"], a["comment"]) == ([1, 2, 2, 3], [1.0, -1.0], -0.95, 150.0, "first")
    assert a["label"] == "r1−r2 (col 1)" and b["label"] == "CV col 2 (2 atoms)"
    assert structures.parse_restraints(RST.replace("-1.", "1."))[0]["label"] == "r1+r2 (col 1)"
    assert (b["iat"], b["r2"], b["rk2"], b["comment"]) == ([5, 6], 1.5, 20.0, "")
    with pytest.raises(ValueError, match="no restraint"):
        structures.parse_restraints("nothing")
    rows = structures.read_restraints(spark, write(tmp_path / "a.rst", RST)).orderBy("block_idx").collect()
    assert [list(r.iat) for r in rows] == [[1, 2, 2, 3], [5, 6]]


def test_umbrella_files(spark, tmp_path):
    (tmp_path / "00").mkdir()
    (tmp_path / "01").mkdir()
    write(tmp_path / "00/b.dat", "# head\n@ xmgrace\n\n1 0 0.5\n2 0 bad\n3 0 0.7\n")
    write(tmp_path / "00/a.dat", "  9   0   0.1\n")
    write(tmp_path / "01/a.dat", "1 0 1.5\n")
    windows = umbrella.window_table(spark, 2, 0.0, 1.0, f"{tmp_path}/{{window}}/*.dat")
    assert [(r.val0, r.cv_file[-8:]) for r in windows.orderBy("window_idx").collect()] == [(0.0, "00/*.dat"), (1.0, "01/*.dat")]
    got = umbrella.numbered(umbrella.read_cv_samples(spark, windows)).orderBy("window_idx", "sample_idx").collect()
    assert [(r.window_idx, r.x) for r in got] == [(0, 0.1), (0, 0.5), (0, 0.7), (1, 1.5)]
    with pytest.raises(ValueError, match="no sample"):
        umbrella.read_cv_samples(spark, windows, column=7)


VINA = """MODEL 1
REMARK VINA RESULT:    -7.5      0.000      0.000
ROOT
ATOM      1  C   LIG A   1       1.000   2.000   3.000  1.00  0.00     0.000 C
ATOM      2  HD  LIG A   1       4.000   5.000   6.000  1.00  0.00     0.000 HD
ENDROOT
ENDMDL
MODEL 2
REMARK VINA RESULT:    -6.1      1.250
ATOM      1  C   LIG A   1       7.000   8.000   9.000  1.00  0.00     0.000 C
ENDMDL
MODEL 3
ENDMDL
"""


def test_docking_output(spark, tmp_path):
    path = write(tmp_path / "out.pdbqt", VINA)
    rows = structures.read_poses(spark, path).orderBy("rank").collect()
    assert [(r.rank, r.affinity, r.rmsd_lb, r.rmsd_ub, len(r.coords)) for r in rows] == [(1, -7.5, 0, 0, 2), (2, -6.1, 1.25, 0, 1)]
    write(tmp_path / "out2.pdbqt", VINA.replace("7.000", "9.000"))
    pose = structures.pose_pdb(spark, f"{tmp_path}/out*.pdbqt", 2).orderBy("file", "line").collect()
    assert [r.text[:22] for r in pose] == ["REMARK  Docked pose 2", "ATOM      1  C   LIG A", "END"] * 2
    assert len({r.file for r in structures.read_poses(spark, f"{tmp_path}/out*.pdbqt").collect()}) == 2
    with pytest.raises(ValueError, match="no model"):
        structures.pose_pdb(spark, path, 9)
    kept = [r.text[:6] for r in structures.receptor_pdb(spark, path).orderBy("line").collect()]
    assert "ROOT" not in kept and "ATOM  " in kept


def test_several_files_are_frames_one_after_another(spark, tmp_path):
    for k, name in enumerate(("a", "b")):
        write(tmp_path / f"{name}.pdb", "\n".join(f"ATOM  {i:5d}  CA  ALA A{i:4d}    {k + i:8.3f}{0:8.3f}{0:8.3f}  1.00  0.00           C" for i in (1, 2, 3)) + "\nEND\n")
        write(tmp_path / f"{name}.xyz", "".join(f"2\n\nC {k}.0 0 {m}\nN 1 1 1\n" for m in range(2)))
    pdb = structures.read_pdb(spark, f"{tmp_path}/*.pdb")
    assert [(r.frame, len(r.xyz), r.xyz[0]) for r in pdb.frames.orderBy("frame").collect()] == [(0, 9, 1.0), (1, 9, 2.0)] and pdb.n_atoms == 3
    xyz = structures.read_xyz(spark, f"{tmp_path}/*.xyz")
    assert [(r.frame, r.xyz[0], r.xyz[2]) for r in xyz.frames.orderBy("frame").collect()] == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)]
    assert [r.atom_name for r in xyz.atom_rows] == ["C", "N"]


def test_frames_without_coordinates_count_for_nothing(spark):
    from helixframe.model import Trajectory, atoms_frame
    from helixframe.operators import structural

    atoms = atoms_frame(spark, [(0, "CA", "ALA", "A", 1, "C"), (1, "CB", "ALA", "A", 1, "C")])
    rows = [(0, [0.0] * 6), (1, None), (2, [1.0] * 6), (3, [1.0] * 3)]
    run = Trajectory(spark.createDataFrame(rows, "frame long, xyz array<double>"), atoms)
    assert run.n_frames == 2 and run.mean.tolist() == [0.5] * 6
    assert {r.atom_idx: r.rmsf for r in structural.rmsf(run).collect()} == pytest.approx({0: 0.75**0.5, 1: 0.75**0.5})


def test_receptor_center(spark, tmp_path):
    row = "ATOM      1  C   ALA A   1    %8.3f%8.3f%8.3f  1.00  0.00          %2s"
    text = "\n".join([row % (0, 0, 0, "C"), row % (2, 4, 6, "N"), row % (90, 90, 90, "H"), row % (90, 90, 90, "HD"), "REMARK"])
    c = structures.receptor_center(spark, write(tmp_path / "r.pdbqt", text)).first()
    assert (c.x, c.y, c.z) == (1, 2, 3)


# -- selections


def atoms(spark):
    rows = [("N", "ALA", "A", 1, "N"), ("CA", "ALA", "A", 1, "C"), ("HB1", "GLY", "A", 2, "H"), ("CA", "GLY", "B", 12, "C"), ("O", "UNL", "B", 145, "O")]
    return make(spark, [[[0, 0, 0]] * 5], rows).atoms


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("name CA", [1, 3]), ("name CA CB N", [0, 1, 3]), ("resname ALA and name CA", [1]), ("resid >= 10", [3, 4]), ("not (name CA or chain B)", [0, 2]),
        ("index 0:2", [0, 1, 2]), ("name H*", [2]), ("all", [0, 1, 2, 3, 4]), ("none", []), ("serial 1 5", [0, 4]), ("resid 1:2 and not type H", [0, 1]),
        ("name CA and resid < 5 or name O", [1, 4]), ("resid != 1", [2, 3, 4]), ("resid == 145", [4]),
    ],
)
def test_selection(spark, text, want):
    assert [r.atom_idx for r in atoms(spark).filter(compile_selection(text)).orderBy("atom_idx").collect()] == want


@pytest.mark.parametrize("text", ["", "name", "nome CA", "(name CA", "name CA)", "resid x", "resid >= x", "name CA and", "name CA &"])
def test_bad_selection(text):
    with pytest.raises(ValueError):
        compile_selection(text)


@pytest.mark.parametrize(("mask", "want"), [(":UNL", [5]), (":145,2", [3, 5]), ("@1,2,3", [1, 2, 3]), (":145 @1 junk", [1, 5]), (":gly", [3, 4]), ("@0,99,2", [2])])
def test_mask(spark, mask, want):
    assert [r.serial for r in resolve_mask(atoms(spark), mask).collect()] == want


def test_mask_of_nothing(spark):
    with pytest.raises(ValueError, match="names no atom"):
        resolve_mask(atoms(spark), ":XYZ")


# -- exports


def test_exports(spark, tmp_path):
    t = noise(spark, frames=4, atoms=6)
    wide = sinks.export_wide(rmsd=structural.rmsd(t), rmsf=structural.rmsf(t))
    rows = wide.orderBy("frame").collect()
    assert wide.columns == ["frame", "rmsd_angstrom", "rmsf_angstrom"] and len(rows) == 6
    assert rows[0].rmsd_angstrom == "0.000000" and rows[5].rmsd_angstrom == "NaN" and rows[5].rmsf_angstrom != "NaN"
    from helixframe.operators import correlation

    names = sinks.batch_export({"rmsd": structural.rmsd(t), "dccm": correlation.dccm(t)}, str(tmp_path), 6)
    assert names == ["rmsd.csv", "dccm.csv"]
    lines = [r.value for r in spark.read.text(f"{tmp_path}/dccm.csv").collect()]
    assert len(lines) == 6 and all(len(x.split(",")) == 6 for x in lines) and "1.0000" in lines[0]
    assert spark.read.option("header", True).csv(f"{tmp_path}/rmsd.csv").columns == ["frame", "rmsd"]


def test_regions(spark):
    rows = [("N", "ALA", "A", 7, "N"), ("C1", "UNL", "A", 9, "C"), ("CA", "HIE", "A", 3, "C")]
    t = make(spark, [[[0, 0, 0], [1, 1, 1], [2, 2, 2]]], rows)
    region = sinks.region_atoms(t, 0, [1, 2, 3, 44])
    told = sinks.region_mask(region).first()
    assert (told.mask, told.n_atoms) == (":3,7 | :UNL", 3)
    assert sinks.region_mask(sinks.region_atoms(t, 0, [2])).first().mask == ":UNL"
    with pytest.raises(ValueError, match="no serial"):
        sinks.region_atoms(t, 0, [77])
    text = [r.text for r in sinks.region_xyz(region).orderBy("line").collect()]
    assert text[:2] == ["3", "QM region"] and text[2].split() == ["N", "0.000000", "0.000000", "0.000000"]
    orca = [r.text.strip() for r in sinks.region_orca(region).orderBy("line").collect()]
    assert orca[0] == "%coords" and orca[-2:] == ["end", "end"] and len(orca) == 11


def test_project(spark, tmp_path):
    values = spark.createDataFrame([(0, 1.5), (1, None)], "frame long, v double")
    project.save(spark, str(tmp_path / "p"), {"selection": "all"}, {"thing": values}, {"topology": ("a.pdb", b"ATOM")})
    meta, results, files = project.load(spark, str(tmp_path / "p"))
    assert meta["selection"] == "all" and meta["stride"] == "1"
    assert results["thing"].filter("v is null").count() == 1
    assert bytes(files.first().data) == b"ATOM"
    assert [r.tool_id for r in project.analyses(spark, str(tmp_path / "p")).collect()] == ["thing"]
    assert project.as_json(values).filter(F.col("value").contains("1.5")).count() == 1


def test_saving_again_adds_to_a_project(spark, tmp_path, monkeypatch):
    """Other tools' results, settings and files stay; a save that is cut off changes nothing."""
    at = str(tmp_path / "p")
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    project.save(spark, at, {"selection": "all", "name": "first"}, {"a": one(1), "b": one(2)}, {"topology": ("a.pdb", b"A")})
    project.save(spark, at, {"selection": "name CA"}, {"b": one(3), "c": one(4)}, {"notes": ("n.txt", b"N")})
    show = lambda: {k: df.first().v for k, df in project.load(spark, at)[1].items()}
    meta, _, files = project.load(spark, at)
    assert show() == {"a": 1, "b": 3, "c": 4} and (meta["selection"], meta["name"]) == ("name CA", "first")
    assert {r.role for r in files.collect()} == {"topology", "notes"}
    broken = one(5).withColumn("v", F.raise_error(F.lit("cut off")).cast("int"))
    with pytest.raises(Exception, match="cut off"):
        project.save(spark, at, {"selection": "none"}, {"a": one(6), "b": broken})
    assert show() == {"a": 1, "b": 3, "c": 4} and project.load(spark, at)[0]["selection"] == "name CA"


def test_residues_around_an_atom(spark):
    from helixframe.selection import residue_mates, surroundings

    rows = [("X", "ALA", "A", k // 3, "C") for k in range(30)]
    table = make(spark, [[[0, 0, 0]] * 30], rows).atoms
    assert sorted(r.atom_idx for r in residue_mates(table, 13).collect()) == [12, 13, 14]
    assert sorted(r.atom_idx for r in surroundings(table, 13, 2).collect()) == list(range(9, 18))
