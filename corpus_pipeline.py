"""The corpus pipeline: stages that each read the documents which the stage before kept.

Toxic documents go, one document of each near-duplicate class stays, documents with benchmark
passages go, secrets in the remaining texts are replaced, and the result is what share of each
document to take so that languages and qualities are mixed to their targets.

Null and empty texts pass every stage; rows that repeat an id are documents of their own, of which
copies go in the second stage; rows without an id pass all stages; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, jaccard, mixing, queries, secrets, toxicity
from helixframe.llm.common import materialise, table
from helixframe.plans.tables import discard, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not predict to be toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets replaced in their texts and n_chars, if there is one, counted anew."""
    clean = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))
    return clean.select([F.col(f"`{c}`") for c in docs.columns])


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = mixing.language_quality(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled, queries.MIX_TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("mixing to target weights", mix_to_targets),
]

#: A trained tagger, a recursive join and an iterative fit are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what a stage wrote on its way goes when its documents are written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        paths: list[str] = []
        with scope(spark, paths):
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{k}", paths)
        discard(spark, before)
        before = paths
    return STAGES[-1][1](spark, docs, sf_dir)
