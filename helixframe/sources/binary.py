"""S2. Binary trajectories: DCD, NetCDF-3 (trajectories and restarts), TRR and XTC.

The parsers decode bytes; sources.ranges cuts files of any size into ranges of frames for them, and
read_frames() gives them small files whole.  Reading stops at a frame that ends too early, as a run that
was cut off leaves it.  Lengths are in Å.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.model import Trajectory
from helixframe.plans.tables import materialise

#: A frame: 3N coordinates, and three cell lengths or None.
Frame = tuple[np.ndarray, np.ndarray | None]


# ----------------------------------------------------------------------------------------------
# DCD


def parse_dcd(data: bytes) -> Iterator[Frame]:
    """Fortran records of either byte order; x, y and z are single precision."""
    for order in "<>":
        if len(data) >= 8 and struct.unpack(order + "i", data[:4])[0] == 84 and data[4:8] == b"CORD":
            break
    else:
        raise ValueError("no DCD header")

    def record(at: int) -> tuple[bytes | None, int]:
        if at + 4 > len(data):
            return None, at
        n = struct.unpack_from(order + "i", data, at)[0]
        end = at + 8 + n
        return (data[at + 4 : at + 4 + n], end) if end <= len(data) else (None, at)

    head, at = record(0)
    control = struct.unpack(order + "20i", head[4:84])
    if control[8]:
        raise ValueError("DCD files with fixed atoms are not read")
    _, at = record(at)
    count, at = record(at)
    n = struct.unpack(order + "i", count[:4])[0]
    while True:
        cell = None
        if control[10]:
            box, at = record(at)
            if box is None:
                return
            cell = np.frombuffer(box, order + "f8")[[0, 2, 5]].astype(float)
        axes = []
        for _ in range(3):
            part, at = record(at)
            if part is None or len(part) != 4 * n:
                return
            axes.append(np.frombuffer(part, order + "f4"))
        yield np.stack(axes, axis=1).astype(float).ravel(), cell


# ----------------------------------------------------------------------------------------------
# NetCDF-3

# The format's tags and types.
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12
_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


class _NetCdf:
    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2):
            raise ValueError("no NetCDF-3 file")
        self.data, self.at, self.wide = data, 4, data[3] == 2
        self.records = self.int()
        self.dims = [(self.name(), self.int()) for _ in range(self.list(_DIMENSION))]
        self.attributes()
        self.vars = {}
        for _ in range(self.list(_VARIABLE)):
            name = self.name()
            dims = [self.int() for _ in range(self.int())]
            self.attributes()
            kind, size = self.int(), self.int()
            begin = struct.unpack_from(">q" if self.wide else ">i", data, self.at)[0]
            self.at += 8 if self.wide else 4
            self.vars[name] = (dims, _TYPES[kind], size, begin)
        moving = [v for v in self.vars.values() if v[0] and self.dims[v[0][0]][1] == 0]
        self.stride = sum(v[2] for v in moving)
        if len(moving) == 1:  # a single record variable is not padded
            self.stride = int(np.prod([self.dims[d][1] for d in moving[0][0][1:]])) * np.dtype(moving[0][1]).itemsize

    def int(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.data, self.at - 4)[0]

    def list(self, tag: int) -> int:
        found, n = self.int(), self.int()
        if found not in (0, tag):
            raise ValueError("a list of the NetCDF header is out of place")
        return n

    def name(self) -> str:
        n = self.int()
        self.at += -(-n // 4) * 4
        return self.data[self.at - -(-n // 4) * 4 :][:n].decode()

    def attributes(self) -> None:
        for _ in range(self.list(_ATTRIBUTE)):
            self.name()
            size = np.dtype(_TYPES[self.int()]).itemsize
            n = self.int()
            self.at += -(-size * n // 4) * 4

    def array(self, name: str, record: int | None = None) -> np.ndarray | None:
        """A variable, or one record of it; None where the file ends too early."""
        if name not in self.vars:
            return None
        dims, kind, _, begin = self.vars[name]
        shape = [self.dims[d][1] for d in dims]
        if record is not None:
            shape, begin = shape[1:], begin + record * self.stride
        n = int(np.prod(shape)) if shape else 1
        if begin + n * np.dtype(kind).itemsize > len(self.data):
            return None
        return np.frombuffer(self.data, kind, n, begin).astype(float)


def parse_netcdf(data: bytes) -> Iterator[Frame]:
    """coordinates and cell_lengths of each record, or the single frame of a restart."""
    f = _NetCdf(data)
    if "coordinates" not in f.vars:
        raise ValueError("the NetCDF file has no coordinates")
    if f.dims[f.vars["coordinates"][0][0]][1] != 0:
        yield f.array("coordinates"), f.array("cell_lengths")
        return
    k = 0
    while (f.records < 0 or k < f.records) and (xyz := f.array("coordinates", k)) is not None:
        yield xyz, f.array("cell_lengths", k)
        k += 1


# ----------------------------------------------------------------------------------------------
# TRR and XTC

# Magic numbers, Å in a nanometre.
_TRR, _XTC, _NM = 1993, 1995, 10.0
# The sizes of small differences by index.
_MAGIC = [0] * 9 + [
    8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096,
    5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280,
    416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983,
    13316085, 16777216,
]


def parse_trr(data: bytes) -> Iterator[Frame]:
    """Frames that have positions; others are passed over."""
    at = 0
    while at + 24 <= len(data):
        magic, _, n = struct.unpack_from(">3i", data, at)
        if magic != _TRR:
            raise ValueError(f"no TRR frame at byte {at}")
        at += 12 + -(-n // 4) * 4
        if at + 52 > len(data):
            return
        sizes = struct.unpack_from(">10i", data, at)
        natoms = struct.unpack_from(">i", data, at + 40)[0]
        box_size, x_size = sizes[2], sizes[7]
        width = box_size // 9 if box_size else x_size // max(1, 3 * natoms)
        body = at + 52 + 2 * width
        end = body + sum(sizes)
        if end > len(data):
            return
        kind = f">f{width}"
        cell = None
        if box_size:
            box = np.frombuffer(data, kind, 9, body).astype(float).reshape(3, 3) * _NM
            cell = np.linalg.norm(box, axis=1)
        if x_size:
            start = body + sum(sizes[:7])
            yield np.frombuffer(data, kind, 3 * natoms, start).astype(float) * _NM, cell
        at = end


class _Bits:
    """Bits of a byte string, most significant first."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def three(self, n: int, sizes: list[int]) -> np.ndarray:
        """Three numbers below their sizes out of n bits, whose bytes come least significant first."""
        v = shift = 0
        while n > 0:
            width = min(8, n)
            v |= self.take(width) << shift
            shift, n = shift + 8, n - width
        v, c = divmod(v, sizes[2])
        a, b = divmod(v, sizes[1])
        return np.array([a, b, c])


def _xtc_coordinates(n: int, low: np.ndarray, high: np.ndarray, small: int, packed: bytes) -> np.ndarray:
    """The whole-number coordinates of a frame: full positions, each followed by a run of small differences."""
    # One big number is cut slowly; a window of bytes at a time keeps the work linear.
    bits = _Bits(packed) if len(packed) <= 4096 else _Windowed(packed)
    sizes = [int(h - lo + 1) for lo, h in zip(low, high)]
    wide = max(sizes) > 0xFFFFFF
    full = int(np.prod([int(s) for s in sizes], dtype=object)).bit_length()
    out, k, run = np.empty((n, 3), np.int64), 0, 0
    while k < n:
        at = np.array([bits.take(s.bit_length()) for s in sizes]) if wide else bits.three(full, sizes)
        at = at + low
        step = 0
        if bits.take(1):
            run = bits.take(5)
            step = run % 3
            run, step = run - step, step - 1
        if run:
            reach, previous = _MAGIC[small], at
            for r in range(0, run, 3):
                near = bits.three(small, [reach] * 3) + previous - reach // 2
                out[k] = near
                k += 1
                if r == 0:  # the second atom of a run is the one that was stored in full
                    out[k] = at
                    k += 1
                previous = near
        else:
            out[k] = at
            k += 1
        small += step
    return out


class _Windowed(_Bits):
    """The same, holding no more than a few bytes as a number."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        first, end = self.at >> 3, (self.at + n + 7) >> 3
        v = int.from_bytes(self.data[first:end], "big") >> (8 * end - self.at - n)
        self.at += n
        return v & ((1 << n) - 1)


def parse_xtc(data: bytes) -> Iterator[Frame]:
    at = 0
    while at + 52 <= len(data):
        magic = struct.unpack_from(">i", data, at)[0]
        if magic != _XTC:
            raise ValueError(f"no XTC frame at byte {at}")
        box = np.frombuffer(data, ">f4", 9, at + 16).astype(float).reshape(3, 3) * _NM
        n = struct.unpack_from(">i", data, at + 52)[0] if at + 56 <= len(data) else -1
        at += 56
        if n < 0:
            return
        if n <= 9:
            if at + 12 * n > len(data):
                return
            xyz = np.frombuffer(data, ">f4", 3 * n, at).astype(float)
            at += 12 * n
        else:
            if at + 36 > len(data):
                return
            precision = struct.unpack_from(">f", data, at)[0]
            low, high = (np.array(struct.unpack_from(">3i", data, at + o)) for o in (4, 16))
            small, size = struct.unpack_from(">2i", data, at + 28)
            at += 36
            if at + size > len(data):
                return
            xyz = _xtc_coordinates(n, low, high, small, data[at : at + size]).ravel() / precision
            at += -(-size // 4) * 4
        yield xyz * _NM, np.linalg.norm(box, axis=1)


# ----------------------------------------------------------------------------------------------

PARSERS = {"dcd": parse_dcd, "nc": parse_netcdf, "ncrst": parse_netcdf, "trr": parse_trr, "xtc": parse_xtc}


def read_frames(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """file, at, xyz, cell of the frames of small files at a path or glob, a task a file; the kind is the suffix if not given."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind not in PARSERS:
        raise ValueError(f"unknown trajectory format {kind!r}")
    parse = PARSERS[kind]

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                for k, (xyz, cell) in enumerate(parse(data)):
                    rows.append((name, k, xyz, cell))
                    if len(rows) * len(xyz) >= 4_000_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, at long, xyz array<double>, cell array<double>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "at", "xyz", "cell"])


def read_trajectory(spark: SparkSession, path: str, atoms: DataFrame, kind: str | None = None, stride: int = 1, first: int = 0, last: int | None = None) -> Trajectory:
    """Every stride-th of the frames first..last (last not included) of all files in the order of their names, numbered
    from 0; no frame is an error.

    Files are read by many tasks each (sources.ranges); what is wanted is written out once, as columns.
    """
    from helixframe.sources import ranges

    kind = kind or path.rsplit(".", 1)[-1].lower()
    found = materialise(ranges.read_frames(ranges.frame_index(spark, path, kind), kind, stride, first, last), "frames")
    if found.isEmpty():
        raise ValueError(f"no frame in {path}")
    numbered = found.withColumn("frame", F.expr(f"(frame - {int(first)}L) div {int(stride)}L"))
    cells = None
    if not numbered.filter("cell is not null").isEmpty():
        cells = numbered.select("frame", *[F.col("cell")[k].alias(c) for k, c in enumerate("abc")])
    return Trajectory(numbered.select("frame", "xyz"), atoms, cells)
