"""Per-frame measures over frames that arrive as a stream; each is stateless."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.model import Trajectory
from helixframe.operators import structural
from helixframe.plans.primitives import map_frames


def stream_radius_of_gyration(frames: DataFrame, atoms: DataFrame) -> DataFrame:
    """frame, rg of a streaming frame, xyz."""
    return structural.radius_of_gyration(Trajectory(frames, atoms))


def stream_rmsd(frames: DataFrame, atoms: DataFrame, reference: list[float]) -> DataFrame:
    """frame, rmsd against a given reference; a stream has no first frame to look up."""
    at = np.array(reference, float)

    def make(number, x):
        return {"frame": number, "rmsd": np.sqrt(((x - at) ** 2).sum(axis=1) / (x.shape[1] / 3))}

    return map_frames(Trajectory(frames, atoms), "frame long, rmsd double", make)


def windowed_mean(values: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, mean, n of a measure by windows of event time, late rows dropped after the watermark.

    A time without a zone is taken as a timestamp first, since watermarks need one.
    """
    timed = values.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = timed.groupBy(F.window(time, width)).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "mean", "n")
