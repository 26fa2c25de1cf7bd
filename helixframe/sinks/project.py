"""K7, S14. Projects: settings, results and small files kept together in one folder of tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.tables import fresh_path

DEFAULTS = {"selection": "name CA", "stride": "1"}


def save(spark: SparkSession, path: str, meta: dict[str, str], results: dict[str, DataFrame], files: dict[str, tuple[str, bytes]] | None = None) -> None:
    """Write meta(key, value), analyses(tool_id, table, schema, ran_at), a table a result, embedded_files(role, filename, data).

    What the project holds of other tools, keys and roles stays; a tool's new result replaces its older one.  Each
    save writes its results to tables of their own first and names them in `analyses` last, so a save
    that is cut off leaves the older results as they were.  Results are tables, so nulls stay nulls, and any size is stored.
    """
    now = int(time.time())
    had = _rows(spark, f"{path}/meta", _META)
    told = {r.tool_id: tuple(r) for r in _rows(spark, f"{path}/analyses", _ANALYSES)}
    created = {"created_at": str(now), **DEFAULTS, **{r.key: r.value for r in had}, **meta}
    for name, df in results.items():
        place = f"results/{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{place}")
        told[name] = (name, place, json.dumps(df.schema.jsonValue()), now)
    kept = {r.role: tuple(r) for r in _rows(spark, f"{path}/embedded_files", _FILES)} | {role: (role, name, data) for role, (name, data) in (files or {}).items()}
    spark.createDataFrame(list(kept.values()), _FILES).coalesce(1).write.mode("overwrite").parquet(f"{path}/embedded_files")
    spark.createDataFrame(sorted(created.items()), _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    spark.createDataFrame(sorted(told.values()), _ANALYSES).coalesce(1).write.mode("overwrite").parquet(f"{path}/analyses")


_META, _ANALYSES, _FILES = "key string, value string", "tool_id string, place string, schema_json string, ran_at long", "role string, filename string, data binary"


def _rows(spark: SparkSession, path: str, schema: str) -> list:
    """The rows of one of a project's small tables; none if it is not there."""
    try:
        return spark.read.schema(schema).parquet(path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def load(spark: SparkSession, path: str) -> tuple[dict[str, str], dict[str, DataFrame], DataFrame]:
    """Meta with its defaults, the results by tool, and the embedded files."""
    meta = DEFAULTS | {r.key: r.value for r in spark.read.parquet(f"{path}/meta").collect()}
    tools = spark.read.parquet(f"{path}/analyses").select("tool_id", "place").collect()
    return meta, {t.tool_id: spark.read.parquet(f"{path}/{t.place}") for t in tools}, spark.read.parquet(f"{path}/embedded_files")


def analyses(spark: SparkSession, path: str) -> DataFrame:
    """S15. The stored analyses and when they ran."""
    return spark.read.parquet(f"{path}/analyses").select("tool_id", F.col("ran_at"))


def as_json(df: DataFrame) -> DataFrame:
    """A result's rows as JSON lines, for other programs."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def scratch(spark: SparkSession) -> str:
    return fresh_path(spark, "project")
