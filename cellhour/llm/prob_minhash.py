"""Near-duplicate classes by ProbMinHash signatures.

A document is a set of five-word shingles, which all weigh the same, since a link
is a matter of sets: how often a document repeats a passage does not change its
buckets. Each shingle sends arrivals of a Poisson process with its weight as
rate to random registers; a register keeps its first arrival. A shingle stops
once its next arrival is later than all registers' arrivals, so long documents
cost about one arrival a shingle. Two signatures agree in a register with the
probability Jaccard similarity of the two sets.

Documents of equal words fold into one first. Bands of registers give buckets;
in a bucket, documents are compared with a leader first. Pairs that then still
lie in different classes of one bucket are compared too, but for those that what
each holds alone and lacks of the leader rules out, so every link between
documents of one bucket counts. A link is an exact Jaccard similarity
of the shingle sets of `threshold` or more; classes are connected components.

Defined results: one row per doc_id with class_id, the least doc_id of its
class; a document without words (null, empty or white space) is a class of its
own; one of fewer than five words has one shingle, all its words; rows that share a
doc_id are one document, so all its texts are linked to each other; rows with a
null doc_id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellhour.session import small_batches

from .components import components
from .shared import stored
from .text import U64, mix, prefix_hash, shingle_hashes, slices, span_hash, word_hashes

REGISTERS = 64
BAND = 4
SIZE = 5
#: Longs of a parity sketch: a bit for each class of shingles, set where a document holds an odd number of them.
PARITY = 8


def shingle_sets(words: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, document) of the different shingles of each document, in order."""
    shingles, doc = shingle_hashes(words, firsts, size)
    order = np.lexsort((shingles, doc))
    shingles, doc = shingles[order], doc[order]
    fresh = np.append(True, (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    return shingles[fresh], doc[fresh]


def signatures(shingles: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """For each document and register, the shingle of the earliest arrival."""
    earliest = np.full(n_docs * m, np.inf)
    owner = np.zeros(n_docs * m, dtype=U64)
    latest = np.full(n_docs, np.inf)
    live, when, turn = np.arange(len(shingles)), np.zeros(len(shingles)), 0
    while len(live):
        turn += 1
        draw = mix(shingles[live] + U64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        when = when - np.log((((draw >> U64(11)).astype(np.float64)) + 0.5) / (1 << 53)) / weight[live]
        early = when < latest[doc[live]]
        live, when, draw = live[early], when[early], draw[early]
        place = doc[live] * m + (mix(draw) % U64(m)).astype(np.int64)
        np.minimum.at(earliest, place, when)
        won = earliest[place] == when
        owner[place[won]] = shingles[live[won]]
        latest = earliest.reshape(n_docs, m).max(axis=1)
        again = when < latest[doc[live]]
        live, when = live[again], when[again]
    return owner.reshape(n_docs, m)


def _described(size: int, m: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, last, data, offsets in slices(batch):
                words, firsts = word_hashes(data, offsets)
                shingles, doc = shingle_sets(words, firsts, size)
                owner = signatures(shingles, doc, np.ones(len(doc)), last - first, m)
                some = np.diff(firsts) > 0
                whole = [whole_hash(w, firsts)[some] for w in (words, mix(words ^ U64(0xA5A5A5A5A5A5A5A5)))]
                owner = owner[some]
                joined = owner.reshape(len(owner), m // BAND, BAND)
                bands = np.full(joined.shape[:2], np.arange(m // BAND), dtype=U64)
                for i in range(BAND):
                    bands = mix(bands * U64(0x9E3779B97F4A7C15) + joined[:, :, i])
                flat = pa.array(bands.ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1, dtype=np.int32) * (m // BAND)), flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:last][some].astype(np.int64)), pa.array(whole[0]), pa.array(whole[1]),
                     pa.array(np.bincount(doc, minlength=last - first)[some].astype(np.int64)), lists],
                    ["doc_id", "high", "low", "size", "bands"])
    return rows


def parities(shingles: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, PARITY) sketches. Two of them differ in no more bits than their shingle sets in shingles."""
    bit = (mix(shingles) >> U64(32)) % U64(64 * PARITY)
    out = np.zeros(n * PARITY, dtype=U64)
    np.bitwise_xor.at(out, doc.astype(np.int64) * PARITY + (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return out.view(np.int64).reshape(n, PARITY)


def whole_hash(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Hash of all words of each document."""
    return span_hash(prefix_hash(words), firsts[:-1], firsts[1:]).view(np.int64)


def _sets(size: int):
    """Shingle sets; of the texts of one doc_id, those of the content that the node stands for."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            high = batch.column("high").to_numpy(zero_copy_only=False)
            for first, last, data, offsets in slices(batch):
                words, firsts = word_hashes(data, offsets)
                meant = np.flatnonzero(whole_hash(words, firsts) == high[first:last])
                shingles, doc = shingle_sets(words, firsts, size)
                cut = np.searchsorted(doc, np.arange(last - first + 1))
                odd = parities(shingles, doc, last - first)[meant]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:last][meant].astype(np.int64)),
                     pa.array([shingles[cut[i]:cut[i + 1]].tobytes() for i in meant], pa.binary())]
                    + [pa.array(np.ascontiguousarray(odd[:, i])) for i in range(PARITY)],
                    ["doc_id", "shingles"] + [f"odd{i}" for i in range(PARITY)])
    return rows


def _common(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingles that the two documents of each pair share."""
    for part in parts:
        common = []
        for a, b in zip(part["set_a"], part["set_b"]):
            x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
            if len(y) < len(x):
                x, y = y, x
            at = np.searchsorted(y, x)
            common.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0)
        yield pd.DataFrame({"a": part["a"], "b": part["b"], "common": np.array(common, dtype=np.int64)})


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, held = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("shingles").to_pylist()
        flat = np.frombuffer(b"".join(held), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, [len(h) // 8 for h in held])), pa.array(flat)], ["doc_id", "shingle"])


class Bucketed:
    """Documents that share a bucket with others: their buckets, sizes and shingle sets.

    A doc_id in here is that of a node, which stands for the text of content `high` in the rows of doc_id `first`.
    """

    def __init__(self, texts: DataFrame, only: DataFrame, threshold: float, size: int):
        self.threshold = threshold
        exploded = only.select("doc_id", F.explode("bands").alias("band"))
        shared = exploded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        held = stored(exploded.join(shared, "band").select("band", "doc_id", "n"), "shared")
        members = held.groupBy("doc_id").agg(F.sum("n").alias("company"))
        self.buckets = stored(held.join(members, "doc_id").select("band", "doc_id", "n", "company"), "buckets")
        # What shares a bucket grows with the corpus, so these joins never broadcast it.
        named = members.join(only, "doc_id").select("doc_id", "first", "high")
        self.sets = stored(texts.withColumnRenamed("doc_id", "first").join(named.hint("merge"), "first").select(
            "doc_id", "high", "text").mapInArrow(
            _sets(size), "doc_id long, shingles binary" + "".join(f", odd{i} long" for i in range(PARITY))), "sets")
        self.known = stored(only.join(members, "doc_id", "left_semi").select("doc_id", "size"), "known")

    def leaders(self, buckets: DataFrame) -> DataFrame:
        """Each bucket's document that meets the most others over all its buckets: the middle of a group of copies."""
        return buckets.groupBy("band").agg(F.min(F.struct((-F.col("company")).alias("c"), "doc_id")).alias("leader")).select(
            "band", F.col("leader.doc_id").alias("leader"))

    def common(self, pairs: DataFrame) -> DataFrame:
        one, two = (self.sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "set_a", "set_b").mapInPandas(
            _common, "a long, b long, common long")

    def edges(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose exact similarity reaches the threshold; sizes rule others out before shingles are read."""
        t = self.threshold
        one, two = (self.known.select(F.col("doc_id").alias(x), F.col("size").alias(f"size_{x}")) for x in "ab")
        near = pairs.join(one, "a").join(two, "b").where(
            F.least("size_a", "size_b") >= t * F.greatest("size_a", "size_b") - 1e-9).select("a", "b")
        return self.common(near).join(one, "a").join(two, "b").where(
            F.col("common") >= t * (F.col("size_a") + F.col("size_b") - F.col("common")) - 1e-9).select("a", "b")

    def star_pairs(self) -> DataFrame:
        """Each document with the leaders of its buckets."""
        return self.buckets.join(self.leaders(self.buckets), "band").where("doc_id <> leader").select(
            F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()

    def open_pairs(self, groups: DataFrame, tested: DataFrame) -> DataFrame:
        """Pairs of one bucket, yet of two groups, that are not ruled out by what they cannot share.

        For documents A, B and the bucket's leader P: the shingles that A alone
        holds (u), and those of P that A lacks (r), give |A xor B| >= u_A + u_B +
        |r_A - r_B|, while a link needs |A xor B| <= (|A| + |B|) (1 - t) / (1 + t),
        and |B| <= |A| / t. So u_A alone rules most documents out; then the bound
        falls apart into one number for each document, which is held against the
        best of its bucket, by an aggregate, before any pair is made. The bits in
        which two parity sketches differ are a lower bound of |A xor B| as well.
        """
        share = (1 - self.threshold) / (1 + self.threshold)
        held = self.buckets.where("n > 2").join(groups, "doc_id", "left").select(
            "band", "doc_id", "company", F.coalesce("group", "doc_id").alias("group"))

        def split(rows: DataFrame) -> DataFrame:
            kinds = rows.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high"))
            return rows.join(kinds.where("low <> high").select("band"), "band")

        held = stored(split(held), "open")
        among = held.select("doc_id").distinct()
        alone = (self.sets.join(among, "doc_id", "left_semi").mapInArrow(_exploded, "doc_id long, shingle long")
                 .groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
                 .groupBy("doc_id").agg(F.count("*").alias("alone")))
        sizes = self.known.select("doc_id", "size")
        able = among.join(sizes, "doc_id").join(alone, "doc_id", "left").select(
            "doc_id", "size", F.coalesce("alone", F.lit(0)).alias("alone")).where(
            F.col("alone") <= share * (1 + 1 / self.threshold) * F.col("size") + 1e-9)
        odds = [f"odd{i}" for i in range(PARITY)]
        sketched = able.join(self.sets.select("doc_id", *odds), "doc_id")
        held = stored(split(held.join(sketched, "doc_id")), "able")
        led = held.join(self.leaders(held), "band")
        pivots = stored(self.common(led.where("doc_id <> leader").select(
            F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()), "pivots")
        numbers = (led.join(sizes.select(F.col("doc_id").alias("leader"), F.col("size").alias("leader_size")), "leader")
                   .join(pivots.select(F.col("a").alias("leader"), F.col("b").alias("doc_id"), "common"),
                         ["leader", "doc_id"], "left"))
        lacks = F.when(F.col("doc_id") == F.col("leader"), 0).otherwise(F.col("leader_size") - F.col("common"))
        # What the leader alone holds, every other member lacks of it: it counts there.
        own = F.when(F.col("doc_id") == F.col("leader"), 0).otherwise(F.col("alone")) - share * F.col("size")
        rated = stored(numbers.select("band", "doc_id", "group", "size", lacks.alias("lacks"), own.alias("own"), *odds), "rated")
        best = rated.groupBy("band").agg(F.min(F.col("own") - F.col("lacks")).alias("best"))
        far = rated.join(best, "band").where(F.col("own") + F.col("lacks") + F.col("best") <= 1e-9).select(
            "band", "doc_id", "group", "size", "lacks", "own", *odds)
        other = rated.select("band", *[F.col(c).alias(f"{c}_b") for c in rated.columns if c != "band"])
        apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in odds), F.lit(0))
        met = far.join(other, "band").where(
            (F.col("group") != F.col("group_b")) & (F.col("lacks_b") <= F.col("lacks"))
            & (F.col("own") + F.col("own_b") + F.col("lacks") - F.col("lacks_b") <= 1e-9)
            & (apart <= share * (F.col("size") + F.col("size_b")) + 1e-9))
        return met.select(F.least("doc_id", "doc_id_b").alias("a"), F.greatest("doc_id", "doc_id_b").alias("b")) \
            .distinct().join(tested, ["a", "b"], "left_anti")


def grouped(pairs: Bucketed, known: DataFrame) -> DataFrame:
    """(doc_id, group) of the documents with a link, which may be one of `known` (a, b)."""
    tested = stored(pairs.star_pairs(), "pairs")
    near = components(pairs.edges(tested).unionByName(known)).select(F.col("node").alias("doc_id"), F.col("label").alias("group"))
    groups = stored(near, "groups")
    more = pairs.edges(stored(pairs.open_pairs(groups, tested), "pairs"))
    a = groups.select(F.col("doc_id").alias("a"), F.col("group").alias("ga"))
    b = groups.select(F.col("doc_id").alias("b"), F.col("group").alias("gb"))
    merged = components(more.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")))
    fresh = merged.select(F.col("node").alias("doc_id"), F.col("node").alias("group"))
    known = groups.union(fresh.join(groups.select("doc_id"), "doc_id", "left_anti"))
    return known.join(merged.withColumnRenamed("node", "group"), "group", "left").select(
        "doc_id", F.coalesce("label", "group").alias("group"))


def nodes(described: DataFrame) -> DataFrame:
    """(high, low, first, node) of each content: the least doc_id that has it, and the node that stands for it.

    The node is that doc_id; but of several contents with one least doc_id, all but the least have their hash.
    """
    firsts = described.groupBy("high", "low").agg(F.min("doc_id").alias("first"))
    heads = firsts.groupBy("first").agg(F.min(F.struct("high", "low")).alias("head"))
    return firsts.join(heads, "first").select(
        "high", "low", "first", F.when(F.struct("high", "low") == F.col("head"), F.col("first")).otherwise(F.col("high")).alias("node"))


def classes(docs: DataFrame, threshold: float = 0.8, size: int = SIZE, m: int = REGISTERS) -> DataFrame:
    """(doc_id, class_id) of every document."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    described = stored(texts.mapInArrow(
        _described(size, m), "doc_id long, high long, low long, size long, bands array<long>"),
        "signatures")
    contents = stored(nodes(described), "contents")
    copies = described.select("doc_id", "high", "low").join(contents, ["high", "low"]).select("doc_id", "node")
    only = stored(described.join(contents, ["high", "low"]).where("doc_id = first").select(
        F.col("node").alias("doc_id"), "first", "high", "size", "bands").dropDuplicates(["doc_id"]), "texts")
    # A document's texts are one document: each is linked to that of the least node.
    ofs = stored(copies.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("most")), "documents")
    several = ofs.where("node <> most").select("doc_id", F.col("node").alias("a"))
    same = copies.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    groups = stored(grouped(Bucketed(texts, only, threshold, size), same), "linked").withColumnRenamed("doc_id", "node")
    least = groups.join(contents, "node").groupBy("group").agg(F.min("first").alias("class_id"))
    # Documents without words are not described.
    first = (ofs.select("doc_id", "node").join(groups.join(least, "group").select("node", "class_id"), "node", "left")
             .select("doc_id", F.coalesce("class_id", "node").alias("first")))
    return (texts.select("doc_id").distinct().join(first, "doc_id", "left")
            .select("doc_id", F.coalesce("first", "doc_id").alias("class_id")))
