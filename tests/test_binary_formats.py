"""Binary readers against files written here by the formats' rules."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from helixframe.sources import binary
from tests.builders import noise

X = np.random.default_rng(8).normal(scale=9, size=(4, 13, 3)).astype(np.float32)


def fortran(payload: bytes, order: str) -> bytes:
    n = struct.pack(order + "i", len(payload))
    return n + payload + n


def dcd(x, order="<", cell=True) -> bytes:
    control = [len(x)] + [0] * 9 + [int(cell)] + [0] * 8 + [24]
    out = fortran(b"CORD" + struct.pack(order + "20i", *control), order)
    out += fortran(struct.pack(order + "i", 1) + b"title".ljust(80), order) + fortran(struct.pack(order + "i", x.shape[1]), order)
    for f in x:
        if cell:
            out += fortran(struct.pack(order + "6d", 30, 90, 31, 90, 90, 32), order)
        out += b"".join(fortran(f[:, k].astype(order + "f4").tobytes(), order) for k in range(3))
    return out


@pytest.mark.parametrize(("order", "cell"), [("<", True), (">", False)])
def test_dcd(order, cell):
    frames = list(binary.parse_dcd(dcd(X, order, cell)))
    assert np.array([f for f, _ in frames]) == pytest.approx(X.reshape(4, -1))
    assert (frames[0][1].tolist() if cell else frames[0][1]) == ([30, 31, 32] if cell else None)
    assert len(list(binary.parse_dcd(dcd(X, order, cell)[:-10]))) == 3  # the last frame is cut off
    with pytest.raises(ValueError, match="DCD"):
        list(binary.parse_dcd(b"nothing of the kind"))


def name(text: str) -> bytes:
    return struct.pack(">i", len(text)) + text.encode().ljust(-(-len(text) // 4) * 4, b"\0")


def netcdf(x, restart=False) -> bytes:
    n = x.shape[1]
    dims = [("frame", 0), ("atom", n), ("spatial", 3)]
    attribute = struct.pack(">2i", 12, 1) + name("units") + struct.pack(">2i", 2, 8) + b"angstrom"
    none = struct.pack(">2i", 0, 0)
    shape = [1, 2] if restart else [0, 1, 2]
    kind, width = (6, 8) if restart else (5, 4)
    variables = [("coordinates", shape, kind, n * 3 * width), ("cell_lengths", [2] if restart else [0, 2], 6, 24)]

    def header(begins):
        out = b"CDF\x01" + struct.pack(">i", 0 if restart else len(x)) + struct.pack(">2i", 10, len(dims))
        out += b"".join(name(d) + struct.pack(">i", s) for d, s in dims) + attribute + struct.pack(">2i", 11, len(variables))
        for (v, d, k, size), at in zip(variables, begins):
            out += name(v) + struct.pack(">i", len(d)) + struct.pack(f">{len(d)}i", *d) + none + struct.pack(">3i", k, size, at)
        return out

    start = len(header([0, 0]))
    out = header([start, start + variables[0][3]])
    for f in x[:1] if restart else x:
        out += f.astype(f">f{width}").tobytes() + struct.pack(">3d", 40, 41, 42)
    return out


def test_netcdf():
    frames = list(binary.parse_netcdf(netcdf(X)))
    assert np.array([f for f, _ in frames]) == pytest.approx(X.reshape(4, -1)) and frames[3][1].tolist() == [40, 41, 42]
    one = list(binary.parse_netcdf(netcdf(X, restart=True)))
    assert len(one) == 1 and one[0][0] == pytest.approx(X[0].ravel()) and one[0][1].tolist() == [40, 41, 42]
    assert len(list(binary.parse_netcdf(netcdf(X)[:-30]))) == 3
    with pytest.raises(ValueError, match="NetCDF"):
        list(binary.parse_netcdf(b"HDF5"))


def trr(x, kind="f") -> bytes:
    width, out = struct.calcsize(kind), b""
    for f in x:
        n = len(f)
        out += struct.pack(">3i", 1993, 13, 12) + b"GMX_trn_file"
        out += struct.pack(">13i", 0, 0, 9 * width, 0, 0, 0, 0, 3 * n * width, 3 * n * width, 0, n, 1, 0) + struct.pack(f">2{kind}", 0, 0)
        out += struct.pack(f">9{kind}", 3, 0, 0, 0, 4, 0, 0, 0, 5) + (f / 10).astype(f">f{width}").tobytes() + bytes(3 * n * width)
    return out


@pytest.mark.parametrize("kind", ["f", "d"])
def test_trr(kind):
    frames = list(binary.parse_trr(trr(X, kind)))
    assert np.array([f for f, _ in frames]) == pytest.approx(X.reshape(4, -1), rel=1e-5) and frames[0][1] == pytest.approx([30, 40, 50])
    assert len(list(binary.parse_trr(trr(X, kind)[:-4]))) == 3


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value: int, n: int) -> None:
        self.bits += format(value, f"0{n}b") if n else ""

    def three(self, v, n: int, sizes) -> None:
        big = (int(v[0]) * sizes[1] + int(v[1])) * sizes[2] + int(v[2])
        while n > 0:
            width = min(8, n)
            self.put(big & ((1 << width) - 1), width)
            big, n = big >> 8, n - width

    def bytes(self) -> bytes:
        return int(self.bits.ljust(-(-len(self.bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(self.bits) // 8), "big")


def xtc(x, small=20, precision=1000.0) -> bytes:
    """Runs of small differences wherever three or more atoms are near, plain positions elsewhere; the index grows and shrinks."""
    out = b""
    for f in x:
        at = np.rint(f / 10 * precision).astype(int)
        low, high = at.min(axis=0), at.max(axis=0)
        sizes, w, k, now, run_before = [int(s) for s in high - low + 1], Writer(), 0, small, 0
        full = (sizes[0] * sizes[1] * sizes[2]).bit_length()
        while k < len(at):
            reach = binary._MAGIC[now]
            run, previous = [], None
            # the second atom is stored in full, the first as its difference, then the others one after another
            if k + 1 < len(at) and (np.abs(at[k] - at[k + 1]) < reach // 2 - 1).all():
                run, previous = [at[k] - at[k + 1]], at[k]
                while k + 1 + len(run) < len(at) and len(run) < 8 and (np.abs(at[k + 1 + len(run)] - previous) < reach // 2 - 1).all():
                    run.append(at[k + 1 + len(run)] - previous)
                    previous = at[k + 1 + len(run) - 1]
            w.three(at[k + 1 if run else k] - low, full, sizes)
            step = (1 if k % 3 == 0 else -1) if run else 0
            if len(run) * 3 != run_before or step:
                w.put(1, 1)
                w.put(3 * len(run) + step + 1, 5)
                run_before = 3 * len(run)
            else:
                w.put(0, 1)
            for d in run:
                w.three(d + reach // 2, now, [reach] * 3)
            now += step
            k += 1 + len(run) if run else 1
        packed = w.bytes()
        out += struct.pack(">3if", 1995, len(at), 0, 0.0) + struct.pack(">9f", 3, 0, 0, 0, 4, 0, 0, 0, 5) + struct.pack(">i", len(at))
        out += struct.pack(">f", precision) + struct.pack(">3i", *low) + struct.pack(">3i", *high) + struct.pack(">2i", small, len(packed))
        out += packed.ljust(-(-len(packed) // 4) * 4, b"\0")
    return out


@pytest.mark.parametrize("spread", [0.3, 3.0, 30.0])
def test_xtc(spread):
    walk = np.cumsum(np.random.default_rng(2).normal(scale=spread, size=(3, 60, 3)), axis=1)
    frames = list(binary.parse_xtc(xtc(walk, small=26)))
    assert np.array([f for f, _ in frames]) == pytest.approx(walk.reshape(3, -1), abs=0.0051) and frames[0][1] == pytest.approx([30, 40, 50])
    assert len(list(binary.parse_xtc(xtc(walk, small=26)[:-8]))) == 2


def test_small_xtc_is_plain():
    few = X[:2, :5] / 10
    data = b"".join(struct.pack(">3if9fi", 1995, 5, 0, 0.0, *[0] * 9, 5) + f.astype(">f4").tobytes() for f in few)
    assert np.array([f for f, _ in binary.parse_xtc(data)]) == pytest.approx(X[:2, :5].reshape(2, -1), rel=1e-5)


def test_files_become_a_trajectory(spark, tmp_path):
    (tmp_path / "a.dcd").write_bytes(dcd(X[:3]))
    (tmp_path / "b.dcd").write_bytes(dcd(X[3:]))
    t = binary.read_trajectory(spark, f"{tmp_path}/*.dcd", noise(spark, atoms=13).atoms)
    assert [r.frame for r in t.frames.orderBy("frame").collect()] == [0, 1, 2, 3]
    assert t.frames.filter("frame = 3").first().xyz == pytest.approx(X[3].ravel())
    assert t.cells.filter("frame = 0").first()[1:] == (30, 31, 32)
    with pytest.raises(ValueError, match="unknown trajectory format"):
        binary.read_frames(spark, f"{tmp_path}/x.gro")


def test_window_snapshots(spark, tmp_path):
    from helixframe.operators import geometry
    from helixframe.sinks.structures import pdb_lines
    from helixframe.sources.umbrella import window_frames, window_table

    for k in range(2):
        (tmp_path / f"0{k}.ncrst").write_bytes(netcdf(X[k:], restart=True))
    atoms = noise(spark, atoms=13).atoms
    windows = window_table(spark, 2, 0.0, 1.0, rst_pattern=f"{tmp_path}/{{window}}.ncrst")
    t = window_frames(spark, windows, atoms)
    assert t.frames.filter("frame = 1").first().xyz == X[1].ravel().astype(float).tolist()
    assert pdb_lines(t, 1).count() == 15
    got = geometry.series(t, [(0, 1), (0, 99)], strict=False).filter("t = 0").orderBy("series_idx").collect()
    assert got[0].value == pytest.approx(np.linalg.norm(X[0, 0] - X[0, 1]), rel=1e-6) and got[1].value is None
    with pytest.raises(ValueError, match="no restart file"):
        window_frames(spark, window_table(spark, 2, 0.0, 1.0), atoms)
