"""S2. Trajectory files of any size, read by many tasks: an index of frames first, then ranges of frames.

A file is cut into splits of bytes.  The first job finds the frames that begin in each split, a task a
split, and reads headers only: of formats with frames of one size (DCD, NetCDF-3) by arithmetic, of
others (TRR, XTC) by hopping from header to header, after the first one in the split has been found by
its magic number, the file's number of atoms and the header that follows.  The index is a small table
(file, split, offsets), so frames get their numbers over all files from the counts of the splits, and
a stride or a range of frames is a filter on it: frames that are not wanted are never read.  The
second job reads and decodes what is wanted, adjacent frames at once.

Files are listed by Spark and opened by pyarrow's file systems (local or shared folders, HDFS, object
stores); binary.read_frames() reads small files whole through Spark on any other.

A frame that a cut-off file does not hold whole is no frame; bytes after the last one are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.sources import binary

#: Bytes of a split, and of adjacent frames that are read at once.
SPLIT_BYTES, READ_BYTES = 64 << 20, 16 << 20
#: Tasks of a job at most; beyond, tasks take several splits.
MAX_TASKS = 20_000
#: Bytes of a header that are looked at first.
HEAD_BYTES = 64 << 10

Read = Callable[[int, int], bytes]


@dataclass
class Layout:
    """prefix: what a decoder needs before frames.  Frames of one size: first offset, size and number; else hop gives ends."""

    prefix: bytes = b""
    first: int = 0
    step: int = 0
    frames: int = 0
    hop: Callable[[int], tuple[int, bool] | None] | None = None
    magic: bytes = b""


def opened(path: str):
    """A file's size and its positional reads."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        system, name = fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    else:
        system, name = fs.FileSystem.from_uri(path)
    file = system.open_input_file(name)
    return file, file.size(), lambda at, n: file.read_at(n, at)


def _dcd(read: Read, size: int) -> Layout:
    head = read(0, 8)
    order = next((o for o in "<>" if len(head) == 8 and struct.unpack(o + "i", head[:4])[0] == 84 and head[4:] == b"CORD"), None)
    if order is None:
        raise ValueError("no DCD header")
    length = lambda at: struct.unpack(order + "i", read(at, 4))[0]
    control = struct.unpack(order + "20i", read(8, 80))
    if control[8]:
        raise ValueError("DCD files with fixed atoms are not read")
    at = 92
    at += 8 + length(at)
    atoms = struct.unpack(order + "i", read(at + 4, 4))[0]
    first = at + 8 + length(at)
    cell = 8 + length(first) if control[10] and first + 4 <= size else 0
    step = cell + 3 * (8 + 4 * atoms)
    return Layout(read(0, first), first, step, max(0, (size - first) // step))


def _netcdf(read: Read, size: int) -> Layout:
    n = HEAD_BYTES
    while True:
        data = read(0, min(n, size))
        try:
            f = binary._NetCdf(data)
            break
        except (struct.error, UnicodeDecodeError):
            if n >= size:
                raise ValueError("the NetCDF header is cut off") from None
            n *= 4
    if "coordinates" not in f.vars:
        raise ValueError("the NetCDF file has no coordinates")
    dims, kind, _, begin = f.vars["coordinates"]
    if f.dims[dims[0]][1] != 0:
        return Layout(b"", 0, size, 1)
    first = min(v[3] for v in f.vars.values() if v[0] and f.dims[v[0][0]][1] == 0)
    width = int(np.prod([f.dims[d][1] for d in dims[1:]])) * np.dtype(kind).itemsize
    there = max(0, (size - begin - width) // f.stride + 1)
    return Layout(read(0, first), first, f.stride, there if f.records < 0 else min(f.records, there))


def _trr_hop(read: Read, size: int, at: int) -> tuple[int, bool, int] | None:
    """The end of the frame at an offset, whether it has positions, and its atoms."""
    head = read(at, 12)
    if len(head) < 12:
        return None
    magic, _, n = struct.unpack(">3i", head)
    if magic != binary._TRR or not 0 <= n < 256:
        return None
    body = at + 12 + -(-n // 4) * 4
    rest = read(body, 52)
    if len(rest) < 52:
        return None
    sizes, atoms = struct.unpack_from(">10i", rest), struct.unpack_from(">i", rest, 40)[0]
    if min(sizes) < 0 or atoms <= 0:
        return None
    width = sizes[2] // 9 if sizes[2] else sizes[7] // (3 * atoms)
    return body + 52 + 2 * width + sum(sizes), sizes[7] > 0, atoms


def _xtc_hop(read: Read, size: int, at: int) -> tuple[int, bool, int] | None:
    head = read(at, 92)
    if len(head) < 56 or struct.unpack_from(">i", head)[0] != binary._XTC:
        return None
    atoms = struct.unpack_from(">i", head, 52)[0]
    if atoms < 0 or atoms != struct.unpack_from(">i", head, 4)[0]:
        return None
    if atoms <= 9:
        return at + 56 + 12 * atoms, True, atoms
    if len(head) < 92:
        return None
    packed = struct.unpack_from(">i", head, 88)[0]
    return (at + 92 + -(-packed // 4) * 4, True, atoms) if packed >= 0 else None


def _hopping(magic: int, name: str, hop):
    def layout(read: Read, size: int) -> Layout:
        first = hop(read, size, 0)
        if size and first is None:
            if len(head := read(0, 4)) < 4 or struct.unpack(">i", head)[0] != magic:
                raise ValueError(f"no {name} frame at byte 0")
            return Layout()
        atoms = first[2] if first else 0

        def step(at: int) -> tuple[int, bool] | None:
            found = hop(read, size, at)
            return found[:2] if found and found[2] == atoms else None

        return Layout(hop=step, magic=struct.pack(">i", magic))

    return layout


LAYOUTS = {
    "dcd": _dcd, "nc": _netcdf, "ncrst": _netcdf, "trr": _hopping(binary._TRR, "TRR", _trr_hop), "xtc": _hopping(binary._XTC, "XTC", _xtc_hop),
}


def _first_from(layout: Layout, read: Read, size: int, lo: int, hi: int) -> int | None:
    """The first frame that begins in lo..hi: a header whose successor is one too, or that ends the file."""
    if lo == 0:
        return 0
    at = lo
    while at < hi:
        block = read(at, min(HEAD_BYTES, hi + 3 - at))
        k = block.find(layout.magic)
        while k >= 0:
            if (at + k) % 4 == 0 and at + k < hi and (found := layout.hop(at + k)):
                # Of a file that was cut off the last header has no whole frame, and none is begun by it.
                if found[0] == size or (found[0] < size and (layout.hop(found[0]) or size - found[0] < 92)):
                    return at + k
            k = block.find(layout.magic, k + 1)
        if len(block) < 4:
            return None
        at += len(block) - 3
    return None


def frames_in(kind: str, read: Read, size: int, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """The offsets and ends of the frames that begin in lo..hi of a file and that it holds whole."""
    layout = LAYOUTS[kind](read, size)
    if layout.hop is None:
        if not layout.step:
            return [], []
        a, b = (max(0, min(layout.frames, -(-(x - layout.first) // layout.step))) for x in (lo, hi))
        starts = [layout.first + k * layout.step for k in range(a, b)]
        return starts, [min(size, s + layout.step) for s in starts]
    starts, ends = [], []
    at = _first_from(layout, read, size, lo, hi) if size else None
    while at is not None and at < min(hi, size):
        found = layout.hop(at)
        if found is None:
            if len(read(at, 4)) == 4 and read(at, 4) != layout.magic:
                raise ValueError(f"no frame at byte {at}")
            break
        if found[0] > size:
            break
        if found[1]:
            starts.append(at)
            ends.append(found[0])
        at = found[0]
    return starts, ends


def _spread(df: DataFrame) -> DataFrame:
    """A row a task, as far as there are tasks enough."""
    return df.repartition(max(1, min(MAX_TASKS, df.count())))


def frame_index(spark: SparkSession, path: str, kind: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, lo, start, offsets, ends of the splits that frames begin in; start numbers the first over all files, in order of their names."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind not in LAYOUTS:
        raise ValueError(f"unknown trajectory format {kind!r}")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")  # contents are not read
    splits = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("lo"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size, lo in zip(*(c.to_pylist() for c in b.columns)):
                file, _, read = opened(name)
                with file:
                    try:
                        starts, ends = frames_in(kind, read, size, lo, lo + split_bytes)
                    except (ValueError, struct.error) as e:  # struct.error: a header that ends too early
                        raise ValueError(f"{name}: {e}") from e
                whole = [pa.array([name]), pa.array([lo]), pa.array([starts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(whole, names=["file", "lo", "offsets", "ends"])

    found = binary.materialise(_spread(splits).mapInArrow(run, "file string, lo long, offsets array<long>, ends array<long>"), "frame-index").filter(F.size("offsets") > 0)
    before = Window.orderBy("file", "lo").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    counts = found.select("file", "lo", F.size("offsets").cast("long").alias("n"))
    starts = counts.select("file", "lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return found.join(starts, ["file", "lo"])


def read_frames(index: DataFrame, kind: str, stride: int = 1, first: int = 0, last: int | None = None) -> DataFrame:
    """frame, xyz, cell of every stride-th of the frames first..last (last not included), numbered as the index does.

    Only the bytes of these frames are read.
    """
    if stride < 1:
        raise ValueError("a stride is 1 at least")
    parse = binary.PARSERS[kind]
    numbered = F.transform(F.col("offsets"), lambda o, i: F.struct((F.col("start") + i).alias("frame"), o.alias("a"), F.get("ends", i).alias("b")))
    inside = lambda s: (s["frame"] >= first) & ((s["frame"] - first) % stride == 0) & (F.lit(True) if last is None else s["frame"] < last)
    wanted = index.select("file", F.filter(numbered, inside).alias("w")).filter(F.size("w") > 0)
    wanted = wanted.select("file", *[F.col(f"w.{c}").alias(c) for c in ("frame", "a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, frames, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                file, size, read = opened(name)
                with file:
                    prefix = LAYOUTS[kind](read, size).prefix
                    k = 0
                    while k < len(frames):
                        end = k + 1
                        while end < len(frames) and a[end] == b[end - 1] and b[end] - a[k] <= READ_BYTES:
                            end += 1
                        got = list(parse(prefix + read(a[k], b[end - 1] - a[k])))
                        if len(got) != end - k:
                            raise ValueError(f"{name}: {len(got)} frames where {end - k} were counted")
                        yield _batch(frames[k:end], got)
                        k = end

    return _spread(wanted).mapInArrow(run, "frame long, xyz array<double>, cell array<double>")


def _batch(frames: list[int], got: list[binary.Frame]) -> pa.RecordBatch:
    doubles = pa.list_(pa.float64())
    columns = [pa.array(frames, pa.int64()), pa.array([x for x, _ in got], doubles), pa.array([c for _, c in got], doubles)]
    return pa.RecordBatch.from_arrays(columns, names=["frame", "xyz", "cell"])
