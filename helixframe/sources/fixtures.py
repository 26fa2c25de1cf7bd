"""Trajectories, windows and states bound to the synthetic tables, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.model import Trajectory, atoms_frame

N_ATOMS, N_WINDOWS = 21, 30
RESIDUES = ("ALA", "GLY", "SER", "LEU", "LYS", "ASP", "VAL")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trajectory(spark: SparkSession, sf_dir: str) -> Trajectory:
    """Each embedding is a frame: 21 atoms from its first 63 components, scaled by 20."""
    rows = read(spark, sf_dir, "embeddings")
    xyz = F.transform(F.slice("embedding", 1, 3 * N_ATOMS), lambda v: v.cast("double") * 20.0)
    cells = rows.select(
        F.col("vec_id").alias("frame"), (F.lit(60.0) + F.col("vec_id") % 7).alias("a"),
        (F.lit(60.0) + F.col("vec_id") % 5).alias("b"), F.lit(80.0).alias("c"),
    )
    return Trajectory(rows.select(F.col("vec_id").alias("frame"), xyz.alias("xyz")), atoms(spark), cells)


def atoms(spark: SparkSession) -> DataFrame:
    return atoms_frame(spark, [(k, ("N", "CA", "C")[k % 3], RESIDUES[k // 3], "A", k // 3 + 1, ("N", "C", "C")[k % 3]) for k in range(N_ATOMS)])


def part_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The atoms of a longer chain: an atom a part, by its key, dealt over residues and chains as above."""
    k = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    seq = F.floor(k / 3)
    return read(spark, sf_dir, "part").select(
        k.cast("int").alias("atom_idx"), pick(("N", "CA", "C"), k).alias("atom_name"), pick(RESIDUES, seq).alias("res_name"),
        F.when(F.col("p_size") % 2 == 0, "A").otherwise("B").alias("chain_id"), (seq + 1).alias("res_seq"), pick(("N", "C", "C"), k).alias("element"),
    )


#: Heads of the molecules that are bound to the parts.
HEADS = ["C", "CC", "c1ccccc1", "C(=O)O", "[NH4+]", "CCl", "Cc1ccccc1", "C1CC1CC(N)C(=O)O", "c1cc[nH]c1", "CCOC(=O)c1ccncc1", "O=C=O", "C#N"]


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id, smiles: a molecule a part, a head by its key and a tail of carbons by its size."""
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("p_partkey") % len(HEADS) + 1).cast("int"))
    tail = F.repeat(F.lit("C"), F.col("p_size") % 4)
    whole = F.when(head.isin("[NH4+]", "O=C=O"), head).otherwise(F.concat(tail, head))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("mol_id"), whole.alias("smiles"))


def windows(spark: SparkSession) -> DataFrame:
    from helixframe.sources.umbrella import window_table

    return window_table(spark, N_WINDOWS, -0.8, 2.1)


def cv_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """window_idx, sample_idx, x: events dealt over the windows, spread about their centres."""
    return samples_of(read(spark, sf_dir, "events").select("event_id", "value"), windows(spark))


def samples_of(events: DataFrame, windows: DataFrame, n_windows: int = N_WINDOWS) -> DataFrame:
    """The same of any events (event_id, value) and windows (window_idx, val0); events without an id have no window."""
    dealt = events.select((F.col("event_id") % n_windows).cast("int").alias("window_idx"), F.col("event_id").alias("sample_idx"), "value")
    joined = dealt.join(F.broadcast(windows.select("window_idx", "val0")), "window_idx")  # a row a window
    return joined.select("window_idx", "sample_idx", (F.col("val0") + (F.col("value") - 50.0) / 250.0).alias("x"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, state: the events in the order of time and id, as the alphabetical number of their type, a null one last."""
    from helixframe.plans.primitives import dense_index

    events = read(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    kinds = events.select("event_type").distinct()  # a row a type, all numbered in one task
    number = F.row_number().over(Window.orderBy(F.col("event_type").asc_nulls_last())) - 1
    numbered = kinds.select(F.col("event_type").alias("kind"), number.alias("state"))
    keyed = events.join(numbered, F.col("event_type").eqNullSafe(F.col("kind"))).select(F.col("state").cast("int").alias("state"), "us", "event_id")
    return dense_index(keyed, "us", "t", bucket=3_600_000_000, then=("event_id",)).select("t", "state")
