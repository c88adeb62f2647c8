"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellhour.llm import decontaminate, packing, prob_minhash, substring_dedup
from cellhour.llm import toxicity as toxic
from cellhour.llm.shared import stored
from cellhour.session import small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`docs` but for these ids; rows with a null doc_id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the labels it learns from are those of the documents given."""
    scored = toxic.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document of the least doc_id stays."""
    return without(docs, prob_minhash.classes(docs).where("class_id <> doc_id"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that an earlier document has are cut out; n_chars follows the text."""
    done = substring_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without(docs, decontaminate.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def in_small_batches(stage: Stage) -> Stage:
    """The stage, with a bound on what a task hands to Python at a time: on one executor the stages' leftovers add up."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES: list[tuple[str, Stage]] = [(name, in_small_batches(stage)) for name, stage in (
    ("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring),
    ("decontamination", decontamination), ("packing", pack))]

#: No SQL can say what a classifier rejects or how sequences are packed; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
