"""Umbrella windows and the collective-variable files of their samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.model import Trajectory
from helixframe.plans.tables import materialise
from helixframe.sources.binary import read_frames


def window_table(spark: SparkSession, n: int, low: float, high: float, cv_pattern: str | None = None, rst_pattern: str | None = None) -> DataFrame:
    """window_idx, val0, cv_file, rst_file of n evenly spaced windows; {window} in a pattern is the two-digit number."""
    named = lambda p: F.lit(None).cast("string") if p is None else F.replace(F.lit(p), F.lit("{window}"), F.lpad(F.col("id").cast("string"), 2, "0"))
    val0 = F.lit(low) + F.lit(high - low) * F.col("id") / F.lit(float(max(n - 1, 1)))
    return spark.range(n).select(F.col("id").cast("int").alias("window_idx"), val0.alias("val0"), named(cv_pattern).alias("cv_file"), named(rst_pattern).alias("rst_file"))


def read_cv_samples(spark: SparkSession, windows: DataFrame, column: int = 2) -> DataFrame:
    """window_idx, file, line and x of the windows' files, each name a glob or a path.

    Blank lines and lines that begin with # or @ are skipped, as are cells that are no numbers.  A
    window without any number is an error.
    """
    rows = windows.select("window_idx", "cv_file").orderBy("window_idx").collect()  # a row a window
    parts = []
    for r in rows:
        lines = spark.read.text(r.cv_file, wholetext=True).select(
            F.lit(r.window_idx).alias("window_idx"), F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text")
        )
        parts.append(lines)
    out = reduce(DataFrame.unionByName, parts)
    text = F.trim(F.regexp_replace("text", "\\s+", " "))
    cell = F.get(F.split(text, " "), F.lit(column))
    kept = out.filter(~(text == "") & ~text.startswith("#") & ~text.startswith("@"))
    samples = kept.select("window_idx", "file", "line", cell.try_cast("double").alias("x")).filter("x is not null")
    have = {r[0] for r in samples.select("window_idx").distinct().collect()}
    if missing := [r.window_idx for r in rows if r.window_idx not in have]:
        raise ValueError(f"no sample in the files of window {missing[0]}")
    return samples


def numbered(samples: DataFrame) -> DataFrame:
    """Samples with sample_idx, their order within a window by file and line."""
    from pyspark.sql import Window

    order = Window.partitionBy("window_idx").orderBy("file", "line")
    return samples.select("window_idx", (F.row_number().over(order) - 1).cast("long").alias("sample_idx"), "x")


def window_frames(spark: SparkSession, windows: DataFrame, atoms: DataFrame, kind: str | None = None) -> Trajectory:
    """S5, P5. The first frame of each window's restart file, as a trajectory whose frame is the window.

    Coordinates are kept in single precision, as restart snapshots are.  A window without a file is an error.
    """
    rows = windows.select("window_idx", "rst_file").orderBy("window_idx").collect()  # a row a window
    if missing := [r.window_idx for r in rows if not r.rst_file]:
        raise ValueError(f"window {missing[0]} has no restart file")
    parts = []
    for r in rows:
        first = read_frames(spark, r.rst_file, kind).filter("at = 0").orderBy("file").limit(1)
        parts.append(first.select(F.lit(r.window_idx).cast("long").alias("frame"), F.transform("xyz", lambda v: v.cast("float").cast("double")).alias("xyz"), "cell"))
    frames = materialise(reduce(DataFrame.unionByName, parts), "windows")
    found = {r.frame for r in frames.select("frame").collect()}
    if missing := [r.window_idx for r in rows if r.window_idx not in found]:
        raise ValueError(f"the restart file of window {missing[0]} holds no frame")
    cells = frames.filter("cell is not null").select("frame", *[F.col("cell")[k].alias(c) for k, c in enumerate("abc")])
    return Trajectory(frames.select("frame", "xyz"), atoms, cells)
