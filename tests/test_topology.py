from __future__ import annotations

import pytest

from helixframe.sources import topology

PSF = """PSF

       1 !NTITLE
 REMARKS x

       3 !NATOM
       1 PROA 5    ALA  N    NH1   -0.47       14.007           0
       2 PROA 5    ALA  CA   CT1    0.07       12.011           0
       3 IONS 7    CLA  CLA  CLA   -1.00       35.450           0

       1 !NBOND: bonds
"""
PARM = """%VERSION  VERSION_STAMP = V0001.000
%FLAG ATOM_NAME
%FORMAT(20a4)
N   CA  C   ZN
%FLAG RESIDUE_LABEL
%FORMAT(20a4)
ALA ZN
%FLAG RESIDUE_POINTER
%FORMAT(10I8)
       1       4
%FLAG AMBER_ATOM_TYPE
%FORMAT(20a4)
N3  CX  C   Zn
"""


def test_psf():
    rows = topology.parse_psf(PSF)
    assert [r[1:] for r in rows] == [("N", "ALA", "P", 5, "N"), ("CA", "ALA", "P", 5, "C"), ("CLA", "CLA", "I", 7, "Cl")]
    with pytest.raises(ValueError, match="no atoms"):
        topology.parse_psf("PSF")
    with pytest.raises(ValueError, match="cut off"):
        topology.parse_psf(PSF.split("       3 IONS")[0])


def test_parm7():
    assert [r[1:] for r in topology.parse_parm7(PARM)] == [
        ("N", "ALA", "A", 1, "N"), ("CA", "ALA", "A", 1, "C"), ("C", "ALA", "A", 1, "C"), ("ZN", "ZN", "A", 2, "Zn"),
    ]
    with pytest.raises(ValueError, match="no atom names"):
        topology.parse_parm7("%FLAG X")


def test_atoms_by_suffix(spark, tmp_path):
    (tmp_path / "a.psf").write_text(PSF)
    (tmp_path / "a.prmtop").write_text(PARM)
    assert topology.read_atoms(spark, f"{tmp_path}/a.psf").count() == 3
    assert topology.read_atoms(spark, f"{tmp_path}/a.prmtop").count() == 4
    with pytest.raises(ValueError, match="unknown topology"):
        topology.read_atoms(spark, "a.top")
