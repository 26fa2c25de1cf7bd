"""Job 1: export the analyses of a trajectory, all tables of one project in one run.

Reads the trajectory that the table `embeddings` is bound to, computes every table that the
configuration names (any of the nineteen of helixframe.sinks.exports), and writes

  OUT/values   Parquet, a row a number (row, item, value), partitioned by export
  OUT/csv/NAME CSV with the columns and decimals of the files that users exchange, if asked for

Only the partitions of the exports that ran are replaced, so exports may be run apart or again; the
same tables and configuration leave the same rows.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.registry import Session
from helixframe.sinks import exports
from helixframe.sources import fixtures
from jobs.common import command, defaults, log, write_partitions


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> DataFrame:
    """Run the job; the values of all exports that OUT then holds."""
    config = defaults(__file__) if config is None else config
    names = list(dict.fromkeys(config["exports"]))
    if unknown := [n for n in names if n not in exports.EXPORTS]:
        raise ValueError(f"unknown export {unknown[0]!r}")
    traj = fixtures.trajectory(spark, tables)
    log.info("read %s/embeddings.parquet: %d frames of %d atoms", tables, traj.n_frames, traj.n_atoms)
    session = Session(traj)
    shared = []
    if {"sasa_per_residue", "sasa_total"} <= set(names):  # most of the work, and two exports of it
        shared.append(session.get("sasa", **config["analyses"].get("sasa", {})).persist(StorageLevel.DISK_ONLY))
    try:
        for name in names:
            made = exports.table(session, name, config["analyses"])
            if config["csv"]:  # read twice, computed once
                made = made.persist(StorageLevel.DISK_ONLY)
            write_partitions(exports.tidy(made, name).withColumn("export", F.lit(name)), f"{out}/values", "export")
            if config["csv"]:
                exports.write_csv(made, name, f"{out}/csv/{name}")
                made.unpersist()
    finally:
        for df in shared:
            df.unpersist()
    values = read(spark, out)
    for r in values.groupBy("export").count().orderBy("export").collect():  # a row an export
        log.info("wrote %s/values/export=%s: %d rows", out, r.export, r["count"])
    return values


def read(spark: SparkSession, out: str) -> DataFrame:
    """export, row, item, value of all that OUT holds."""
    return spark.read.schema("row long, item string, value double, export string").parquet(f"{out}/values").select("export", "row", "item", "value")


if __name__ == "__main__":
    command(__doc__.split("\n\n")[0], __file__, "folder that holds embeddings.parquet", run)
