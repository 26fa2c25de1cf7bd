"""Trajectories read by ranges of frames, against the parsers on whole files."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from helixframe.sources import binary, ranges
from tests.builders import noise
from tests.test_binary_formats import X, dcd, netcdf, trr, xtc

WALK = np.cumsum(np.random.default_rng(3).normal(scale=2.0, size=(23, 40, 3)), axis=1).astype(np.float32)


def small_xtc(x):
    return b"".join(struct.pack(">3if9fi", 1995, len(f), 0, 0.0, *[0] * 9, len(f)) + f.astype(">f4").tobytes() for f in x / 10)


FILES = {
    "dcd": dcd(WALK), "big.dcd": dcd(WALK, ">", False), "nc": netcdf(WALK), "restart.ncrst": netcdf(WALK, restart=True), "trr": trr(WALK), "wide.trr": trr(WALK, "d"),
    "xtc": xtc(WALK, small=26), "few.xtc": small_xtc(WALK[:, :5]),
}


def reads(data):
    return lambda at, n: data[at : at + n]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("cut", [0, 7])
def test_splits_find_each_frame_once(name, cut):
    """Any size of a split, also of files that were cut off: the frames of the whole file, in order."""
    kind, data = name.rsplit(".", 1)[-1], FILES[name][: len(FILES[name]) - cut]
    whole = list(binary.PARSERS[kind](data)) if not (cut and kind == "ncrst") else []
    for step in (60, 333, 1000, 10**6) if kind != "ncrst" else (10**6,):
        got = []
        for lo in range(0, len(data), step):
            starts, ends = ranges.frames_in(kind, reads(data), len(data), lo, lo + step)
            assert all(lo <= s < lo + step and s < e <= len(data) for s, e in zip(starts, ends))
            prefix = ranges.LAYOUTS[kind](reads(data), len(data)).prefix
            for s, e in zip(starts, ends):
                got += list(binary.PARSERS[kind](prefix + data[s:e]))
        if cut and kind == "ncrst":
            continue
        assert len(got) == len(whole), (name, step)
        for (x, c), (y, d) in zip(got, whole):
            assert (x == y).all() and (c is None) == (d is None) and (c is None or (c == d).all())


def test_magic_numbers_among_the_data_are_no_frames():
    """Velocities that look like headers, with the right number of atoms, but lead nowhere."""
    frames = []
    for f in WALK[:6]:
        n = len(f)
        decoy = (struct.pack(">3i", 1993, 13, 12) + b"GMX_trn_file" + struct.pack(">13i", *[0] * 7, 12 * n, 0, 0, n, 1, 0)).ljust(12 * n, b"\1")
        head = struct.pack(">3i", 1993, 13, 12) + b"GMX_trn_file"
        head += struct.pack(">13i", 0, 0, 36, 0, 0, 0, 0, 12 * n, 12 * n, 0, n, 1, 0) + struct.pack(">2f", 0, 0)
        frames.append(head + struct.pack(">9f", 3, 0, 0, 0, 4, 0, 0, 0, 5) + (f / 10).astype(">f4").tobytes() + decoy)
    data = b"".join(frames)
    starts = [s for lo in range(0, len(data), 100) for s in ranges.frames_in("trr", reads(data), len(data), lo, lo + 100)[0]]
    assert starts == [k * len(frames[0]) for k in range(6)]


@pytest.mark.parametrize("name", ["dcd", "nc", "trr", "xtc"])
def test_as_the_whole_file_reader(spark, tmp_path, name):
    for k, part in enumerate((WALK[:9], WALK[9:])):
        made = {"dcd": dcd, "nc": netcdf, "trr": trr, "xtc": lambda x: xtc(x, small=26)}[name](part)
        (tmp_path / f"run{k}.{name}").write_bytes(made)
    path = f"{tmp_path}/*.{name}"
    whole = [r.xyz for r in binary.read_frames(spark, path).orderBy("file", "at").collect()]
    index = ranges.frame_index(spark, path, split_bytes=700)
    assert index.count() > 4
    got = {r.frame: r.xyz for r in ranges.read_frames(index, name).collect()}
    assert [got[k] for k in range(23)] == whole and len(got) == 23
    some = ranges.read_frames(index, name, stride=4, first=3, last=20).collect()
    assert sorted(r.frame for r in some) == [3, 7, 11, 15, 19] and all(r.xyz == whole[r.frame] for r in some)
    t = binary.read_trajectory(spark, path, noise(spark, atoms=40).atoms, stride=5)
    assert [(r.frame, r.xyz) for r in t.frames.orderBy("frame").collect()] == [(k, whole[5 * k]) for k in range(5)]
    assert t.cells.count() == 5


def test_a_stride_reads_its_frames_only(spark, tmp_path):
    """What lies between the wanted frames may be anything."""
    data = bytearray(dcd(WALK))
    layout = ranges.LAYOUTS["dcd"](reads(bytes(data)), len(data))
    for k in range(23):
        if k % 6:
            a = layout.first + k * layout.step
            data[a : a + layout.step] = b"\xff" * layout.step
    (tmp_path / "a.dcd").write_bytes(bytes(data))
    t = binary.read_trajectory(spark, f"{tmp_path}/a.dcd", noise(spark, atoms=40).atoms, stride=6)
    assert [r.xyz for r in t.frames.orderBy("frame").collect()] == [WALK[k].ravel().astype(float).tolist() for k in (0, 6, 12, 18)]


def test_a_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file of 600 frames of 300,000 atoms, 2.2 GB: many tasks index it, a stride reads four frames."""
    n, frames = 300_000, 600
    with open(tmp_path / "long.dcd", "wb") as f:
        head = dcd(np.zeros((0, n, 3), np.float32), cell=False)
        f.write(head)
        for k in range(frames):
            for axis in range(3):
                f.write(struct.pack("<if", 4 * n, k + axis / 4))
                f.seek(4 * n - 4, 1)
                f.write(struct.pack("<i", 4 * n))
    size = (tmp_path / "long.dcd").stat().st_size
    assert size > 2**31
    index = ranges.frame_index(spark, f"{tmp_path}/long.dcd")
    assert index.count() == -(-size // ranges.SPLIT_BYTES)
    assert index.selectExpr("sum(size(offsets))").first()[0] == frames
    got = ranges.read_frames(index, "dcd", stride=150)
    assert got.rdd.getNumPartitions() >= 4
    rows = {r.frame: r.x for r in got.selectExpr("frame", "slice(xyz, 1, 4) AS x").collect()}
    assert rows == {k: [k, k + 0.25, k + 0.5, 0.0] for k in (0, 150, 300, 450)}


def test_errors_and_empty_files(spark, tmp_path):
    (tmp_path / "a.trr").write_bytes(b"")
    assert ranges.frame_index(spark, f"{tmp_path}/a.trr").count() == 0
    (tmp_path / "b.xtc").write_bytes(b"no such thing at all, but long enough to look like one" * 3)
    with pytest.raises(Exception, match="no XTC frame"):
        ranges.frame_index(spark, f"{tmp_path}/b.xtc").count()
    (tmp_path / "c.dcd").write_bytes(dcd(X)[:60])
    with pytest.raises(Exception, match="c.dcd"):
        ranges.frame_index(spark, f"{tmp_path}/c.dcd").count()
    with pytest.raises(ValueError, match="no frame"):
        binary.read_trajectory(spark, f"{tmp_path}/a.trr", noise(spark).atoms)
    with pytest.raises(ValueError, match="unknown trajectory format"):
        ranges.frame_index(spark, f"{tmp_path}/x.gro")
    with pytest.raises(ValueError, match="stride"):
        ranges.read_frames(ranges.frame_index(spark, f"{tmp_path}/a.trr"), "trr", stride=0)
