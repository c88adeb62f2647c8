"""The labelled rows that a classifier learns from: a bounded sample, drawn by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int):
    """crc32 of the id's digits modulo `modulus`; null ids give null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def sample(labels: DataFrame, label: str, modulus: int, held_out: int, per_label: int) -> tuple[DataFrame, list[int]]:
    """At most `per_label` rows (doc_id, label) of each label that may be learnt from, and how many there are.

    A doc_id with several labels takes the largest; null ids and labels other
    than 0 and 1 are no examples.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IN (0, 1)").where(remainder(modulus) != held_out)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), [counts.get(0, 0), counts.get(1, 0)]


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents of a sample; the sample is bounded, so it is sent to where the documents are."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), "doc_id"))
