"""2.11. Means, fluctuations and covariance of frames that arrive as a stream, kept as state.

The state of a run is the count, mean and summed squared deviations (or their products) of its frames so
far; frames that arrive are summed up by themselves and then merged into it pairwise, so no sum of squares
loses digits however long the run is.  A run's frames are dealt over `shards`, each with a state of its
own, so that one long run does not pass through one task; merged() adds the shards' states up.

State is in Spark's state store and survives a restart from the query's checkpoint.  It takes the RocksDB
provider (spark.sql.streaming.stateStore.providerClass).  Frames without a coordinate for each atom count for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Coordinates whose products are kept at most; a state of 1,500 squared doubles is 18 MB.
MAX_PRODUCTS = 1_500
SHARDS = 8

Moments = tuple[int, np.ndarray, np.ndarray]
STATE = "n long, mean binary, m2 binary"
OUTPUT = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("m2", T.ArrayType(T.DoubleType())),
])


def of_frames(x: np.ndarray, products: bool) -> Moments:
    mean = x.mean(axis=0)
    d = x - mean
    return len(x), mean, (d.T @ d).ravel() if products else (d * d).sum(axis=0)


def merge(a: Moments | None, b: Moments, products: bool) -> Moments:
    """The moments of both sets of frames."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    between = (np.outer(gap, gap).ravel() if products else gap * gap) * (a[0] * b[0] / n)
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + between


class _Running(StatefulProcessor):
    def __init__(self, products: bool):
        self.products = products

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = None
        if self.state.exists():
            n, mean, m2 = self.state.get()
            now = n, np.frombuffer(mean), np.frombuffer(m2)
        for frames in rows:
            if len(frames):
                now = merge(now, of_frames(np.stack(frames["xyz"].to_numpy()), self.products), self.products)
        if now is not None:
            self.state.update((now[0], now[1].tobytes(), now[2].tobytes()))
            yield pd.DataFrame({"run": [key[0]], "shard": [key[1]], "n": [now[0]], "mean": [now[1].tolist()], "m2": [now[2].tolist()]})

    def close(self) -> None:
        pass


def running_moments(frames: DataFrame, n_atoms: int, products: bool = False, shards: int = SHARDS) -> DataFrame:
    """run, shard, n, mean, m2 of a stream of run, frame, xyz: for each shard that frames arrived for, its state so far.

    m2 holds the summed squared deviations of the 3N coordinates, or with `products` those of each two, row by row.
    Write it with output mode update; the last row of a shard is its state.
    """
    if products and 3 * n_atoms > MAX_PRODUCTS:
        raise ValueError(f"products of {3 * n_atoms} coordinates; at most {MAX_PRODUCTS} are kept, analyse a selection")
    whole = frames.filter(F.size("xyz") == 3 * n_atoms)
    dealt = whole.select(F.col("run").cast("string").alias("run"), F.pmod(F.xxhash64("frame"), F.lit(shards)).cast("int").alias("shard"), F.col("xyz").cast("array<double>").alias("xyz"))
    return dealt.groupBy("run", "shard").transformWithStateInPandas(_Running(products), OUTPUT, outputMode="Update", timeMode="None")


def merged(states: DataFrame, products: bool = False) -> DataFrame:
    """run, n, mean, m2 of the states (run, shard, n, mean, m2), one a shard."""

    def run(t: pa.Table) -> pa.Table:
        now = None
        for n, mean, m2 in sorted(zip(t["n"].to_pylist(), t["mean"].to_pylist(), t["m2"].to_pylist()), key=lambda r: r[0]):
            now = merge(now, (n, np.array(mean), np.array(m2)), products)
        lists = pa.list_(pa.float64())
        return pa.table({"run": t["run"][:1], "n": pa.array([now[0]]), "mean": pa.array([now[1].tolist()], lists), "m2": pa.array([now[2].tolist()], lists)})

    return states.select("run", "n", "mean", "m2").groupBy("run").applyInArrow(run, "run string, n long, mean array<double>, m2 array<double>")


def latest(rows: DataFrame) -> DataFrame:
    """Of rows that were written batch by batch, the last of each shard: the one of most frames."""
    last = F.max_by(F.struct("n", "mean", "m2"), "n").alias("s")
    return rows.groupBy("run", "shard").agg(last).select("run", "shard", "s.n", "s.mean", "s.m2")


def rmsf(moments: DataFrame) -> DataFrame:
    """run, atom_idx, rmsf of merged moments without products."""
    variance = lambda k: F.get("m2", k)
    atoms = F.sequence(F.lit(0), (F.size("m2") / 3).cast("int") - 1)
    at = moments.select("run", "n", "m2", F.explode(atoms).alias("atom_idx"))
    total = variance(F.col("atom_idx") * 3) + variance(F.col("atom_idx") * 3 + 1) + variance(F.col("atom_idx") * 3 + 2)
    return at.select("run", "atom_idx", F.sqrt(total / F.col("n")).alias("rmsf"))


def covariance(moments: DataFrame) -> DataFrame:
    """run, i, j, value of merged moments with products."""
    width = F.size("mean")
    cells = moments.select("run", "n", width.alias("w"), F.posexplode("m2").alias("k", "v"))
    return cells.select("run", F.expr("k div w").cast("int").alias("i"), (F.col("k") % F.col("w")).alias("j"), (F.col("v") / F.col("n")).alias("value"))
