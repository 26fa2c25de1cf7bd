"""Job 2: take in the samples of a running umbrella-sampling campaign and keep its windows' state current.

Sampling goes on for weeks and adds files; what users ask each day is whether the windows have sampled
enough: how many samples each has, their mean and spread, how far the mean is pulled from the
window's centre, and how much neighbouring windows overlap, without which no free energy can be
computed.  The job reads the files of the table `events` as a stream with a checkpoint, so that a run
takes only files that no run has taken, and keeps

  OUT/samples   Parquet, the samples (window_idx, sample_idx, x), partitioned by batch and window
  OUT/partials  Parquet, the count, mean, squared deviations, range and histogram of each window in each batch
  OUT/report    Parquet, one number a row (window_idx, bin, value), partitioned by measure
  OUT/checkpoint the stream's own

The report is made of the partials, whose number grows with the batches and windows and not with the
samples; means and squared deviations of batches are combined pairwise, so no sum of squares loses digits.  A batch
that is run again replaces its own partitions, so a run that was cut off is made good by the next.

Samples without a window or a finite value are left out; those beyond the histogram's range count in
its end bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.expr import bin_index
from helixframe.operators import mbar
from helixframe.sources import fixtures
from helixframe.sources.umbrella import window_table
from jobs.common import command, defaults, log, write_partitions

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
PARTIALS = "batch long, window_idx int, bin int, n long, mean double, m2 double, lo double, hi double"
MEASURES = ("n", "mean", "std", "lo", "hi", "offset", "overlap", "histogram")


def _windows(spark: SparkSession, config: dict) -> DataFrame:
    w = config["windows"]
    return window_table(spark, w["n"], w["low"], w["high"]).select("window_idx", "val0")


def _bin(x: Column, config: dict) -> Column:
    """The histogram's bins: the windows' range and a margin on either side."""
    w = config["windows"]
    return bin_index(x, F.lit(w["low"] - config["margin"]), F.lit(w["high"] - w["low"] + 2 * config["margin"]), config["bins"])


def partials(samples: DataFrame, config: dict) -> DataFrame:
    """window_idx, bin, n, mean, m2, lo, hi of the samples: the state of a batch, at most a row a window and bin."""
    placed = samples.withColumn("bin", _bin(F.col("x"), config))
    made = placed.groupBy("window_idx", "bin").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    return made.select("window_idx", "bin", "n", "mean", (F.col("v") * F.col("n")).alias("m2"), "lo", "hi")


def combined(parts: DataFrame, *keys: str) -> DataFrame:
    """keys, n, mean, m2, lo, hi: the partials of the keys as one.

    Squared deviations add up, and so do those of the parts' means from the mean of all.
    """
    whole = Window.partitionBy(*keys)
    n, weighted = F.sum("n").over(whole), F.sum(F.col("n") * F.col("mean")).over(whole)
    rows = parts.withColumn("__mean", weighted / n)
    gap = F.col("mean") - F.col("__mean")
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("__mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def report(parts: DataFrame, windows: DataFrame, config: dict) -> DataFrame:
    """measure, window_idx, bin (-1 of what concerns a whole window), value.

    offset: the mean less the window's centre, in standard deviations that the bias alone would give.
    overlap: the share of samples that a window's histogram and the next one's have in common.
    """
    state = combined(parts, "window_idx")
    by_bin = parts.groupBy("window_idx", "bin").agg(F.sum("n").alias("k"))
    share = by_bin.join(state.select("window_idx", "n"), "window_idx").select("window_idx", "bin", "k", (F.col("k") / F.col("n")).alias("p"))
    after = share.select((F.col("window_idx") - 1).alias("window_idx"), "bin", F.col("p").alias("q"))
    common = share.join(after, ["window_idx", "bin"]).groupBy("window_idx").agg(F.sum(F.least("p", "q")).alias("overlap"))
    stiff = (mbar.beta(config["temperature"]) * config["force"]) ** 0.5
    both = state.join(windows, "window_idx").join(common, "window_idx", "left")
    numbers = {
        "n": F.col("n").cast("double"), "mean": F.col("mean"), "std": F.sqrt(F.col("m2") / F.col("n")), "lo": F.col("lo"), "hi": F.col("hi"),
        "offset": (F.col("mean") - F.col("val0")) * stiff, "overlap": F.coalesce("overlap", F.lit(0.0)),
    }
    rows = both.select("window_idx", F.lit(-1).alias("bin"), F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in numbers.items()])))
    bins = by_bin.select("window_idx", "bin", F.lit("histogram").alias("measure"), F.col("k").cast("double").alias("value"))
    return rows.unionByName(bins)


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> DataFrame:
    """Take in what is new under TABLES/events.parquet and renew the report; the report."""
    config = defaults(__file__) if config is None else config
    windows = _windows(spark, config)
    taken = []

    def take(batch: DataFrame, number: int) -> None:
        events = batch.select("event_id", "value")
        samples = fixtures.samples_of(events, windows, config["windows"]["n"]).filter(F.col("window_idx").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
        write_partitions(samples.withColumn("batch", F.lit(number).cast("long")), f"{out}/samples", "batch", "window_idx")
        stored = spark.read.schema("sample_idx long, x double, batch long, window_idx int").parquet(f"{out}/samples").filter(F.col("batch") == number)
        write_partitions(partials(stored, config).withColumn("batch", F.lit(number).cast("long")), f"{out}/partials", "batch")
        n = spark.read.schema(PARTIALS).parquet(f"{out}/partials").filter(F.col("batch") == number).agg(F.sum("n")).first()[0] or 0
        taken.append(n)
        log.info("batch %d: took %d samples", number, n)

    # A pattern that only this name matches: a stream of one file, where the table is no folder, must be a pattern's.
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{tables}/events.parque[t]")
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("read %s/events.parquet: %d new samples in %d batches", tables, sum(taken), len(taken))
    # Also if nothing was new: the run before may have been cut off between its last batch and the report.
    if _there(spark, f"{out}/partials"):
        parts = spark.read.schema(PARTIALS).parquet(f"{out}/partials")
        write_partitions(report(parts, windows, config), f"{out}/report", "measure")
    made = read(spark, out)
    log.info("wrote %s/report: %d rows", out, made.count())
    return made


def _there(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def read(spark: SparkSession, out: str) -> DataFrame:
    """measure, window_idx, bin, value of the report in OUT; no rows if there is none."""
    if not _there(spark, f"{out}/report"):
        return spark.createDataFrame([], "measure string, window_idx int, bin int, value double")
    return spark.read.schema("window_idx int, bin int, value double, measure string").parquet(f"{out}/report").select("measure", "window_idx", "bin", "value")


if __name__ == "__main__":
    command(__doc__.split("\n\n")[0], __file__, "folder that holds events.parquet", run)
