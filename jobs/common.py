"""What the jobs share: configuration, logging, the command line, tables read back."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def defaults(module_file: str) -> dict:
    """The configuration that stands beside a job's module."""
    return json.loads(Path(module_file).with_suffix(".json").read_text(encoding="utf-8"))


def configuration(spark: SparkSession, module_file: str, path: str | None) -> dict:
    """The job's own configuration, with what the file at the path, which may be remote, says instead."""
    own = defaults(module_file)
    if path is None:
        return own
    given = json.loads(spark.read.text(path, wholetext=True).first().value)
    if extra := set(given) - set(own):
        raise ValueError(f"the configuration has an unknown entry {sorted(extra)[0]!r}")
    return own | given


def write_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replace the partitions that the rows are of and leave others; the same rows again leave the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def command(description: str, module_file: str, tables_help: str, run: Callable[[SparkSession, str, str, dict], object]) -> None:
    """A job's command line; the session lives here alone."""
    args = argparse.ArgumentParser(description=description)
    args.add_argument("--tables", required=True, help=tables_help)
    args.add_argument("--out", required=True, help="folder of the output, which may be remote")
    args.add_argument("--config", help=f"JSON file with what to change of {Path(module_file).stem}.json")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(Path(module_file).stem).getOrCreate()
    try:
        run(spark, given.tables, given.out, configuration(spark, module_file, given.config))
    finally:
        spark.stop()
