"""Benchmark items found inside documents, by containment of their shingles.

Items are partitioned by size (powers of two of their number of different
five-word shingles). An item keeps a bottom-s MinHash sketch: its s shingles of
least hash, s fixed for its size class so that it outnumbers twice the shingles
a match may lack. A document that holds `threshold` of an item's shingles
lacks few of them, so it must hold most of the sketch; such pairs are then
verified by exact containment of the shingles themselves. Only DataFrame
functions are used.

Words are runs of letters and digits, in lower case. Defined results: null and
empty texts hold nothing; items of fewer than `size` words have no shingle and
match nothing; rows with a null doc_id or item_id are left out; rows that repeat
an id are compared one by one, and a pair of ids keeps the counts of its best
containment, of equal ones those of the larger text; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Sketch rows that are sent to every executor; above this many the join shuffles instead.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(column: Column, size: int, make) -> Column:
    """`make` of every `size` consecutive words; an empty array where there are fewer."""
    starts = F.when(F.size(column) >= size, F.sequence(F.lit(1), F.size(column) - size + 1))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: make(F.slice(column, i, size)))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sketches(items: DataFrame, threshold: float, size: int) -> DataFrame:
    """(item_id, n, lacks, sketch): an item's shingles, how many a match may lack, and its least hashes."""
    split = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        "item_id", words(F.col("text")).alias("words"))
    held = split.select("item_id", F.array_distinct(shingles(F.col("words"), size, lambda w: F.array_join(w, " ")))
                        .alias("shingles")).where("size(shingles) > 0")
    n = F.size("shingles")
    upper = F.pow(2, F.floor(F.log2(n)) + 1) - 1
    lack = lambda of: of - F.ceil(of * threshold - 1e-9)
    hashes = F.array_sort(F.transform("shingles", lambda s: F.xxhash64(F.split(s, " "))))
    return held.select("item_id", "shingles", n.alias("n"), lack(n).cast("int").alias("lacks"),
                       F.slice(hashes, 1, (2 * lack(upper) + 1).cast("int")).alias("sketch"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every pair at or above `threshold`."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    sketch = stored(sketches(items.select("item_id", "text"), threshold, size), "sketches")
    rows = sketch.select("item_id", "lacks", F.size("sketch").alias("s"), F.explode("sketch").alias("hash"))
    n_rows = rows.count()
    probe = texts.select("doc_id", words(F.col("text")).alias("words")).select(
        "doc_id", F.explode(shingles(F.col("words"), size, lambda w: F.xxhash64(w))).alias("hash"))
    hits = probe.join(small(rows, n_rows), "hash").groupBy("doc_id", "item_id", "s", "lacks").agg(
        F.count_distinct("hash").alias("hits"))
    pairs = stored(hits.where("hits >= s - lacks").groupBy("doc_id").agg(
        F.collect_set("item_id").alias("items")), "candidates")
    held = texts.join(pairs, "doc_id").select(
        "doc_id", "items", words(F.col("text")).alias("words")).select(
        "doc_id", "items", F.array_distinct(shingles(F.col("words"), size, lambda w: F.array_join(w, " "))).alias("held"))
    found = held.select("doc_id", "held", F.explode("items").alias("item_id")).join(
        small(sketch.select("item_id", "shingles", "n"), n_rows), "item_id").select(
        "doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"),
        F.size(F.array_intersect("shingles", "held")).cast("long").alias("n_found"))
    met = found.where(F.col("n_found") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))
    best = F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_found")).alias("best")
    return met.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_shingles", "best.n_found", "best.containment")
