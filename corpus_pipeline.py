"""From raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from splitsight.llm import lines, mixing, near_dedup, packing, quality
from splitsight.llm.common import fresh, table
from splitsight.session import scratch_path


def screen_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels of the documents given."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "score")
    return quality.score(docs, model, out=score).filter(F.col(score) >= 0.5).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines they keep; n_chars follows the text."""
    kept = lines.drop_lines(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.packing_report(docs)


STAGES = [
    ("quality classifier", screen_quality),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # a fitted classifier, sketches and random rounding are no SQL; tests hold them to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
