"""Quality classifier: random-indexing word vectors, pooled, then a small network.

Every token has a fixed sparse random vector; a token's word vector is the sum of
the random vectors of its neighbours over all documents. Tokens fall into a
fixed number of hash buckets, so the table of word vectors has one size for any
corpus. A document is the mean of its tokens' vectors, weighted by rarity, and
of the random vectors themselves; a two-layer network in numpy maps that to a
probability, whose temperature is fitted on a part of the sample kept back from training.

Tokens are runs of letters, of digits and of other signs in lower case, with
marks for a word in capitals and for a word repeated. Defined results: null,
empty and blank texts are the zero vector and get the network's score for it;
without examples of both labels every score is the share of label 1 (0 without
labels); rows that repeat a doc_id are scored one by one; a null doc_id has
held_out null; input columns with the name of an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import remainder, sample, texts_of
from .text import U64, class_runs, lower_hashes, mix, slices

#: Bounds of the model: labelled rows of each label, buckets, and length of a word vector.
PER_LABEL = 8_000
BUCKETS = 1 << 14
DIMENSIONS = 32
NONZERO = 4
REACH = 2
HIDDEN = 32
LEAST_STEPS = 1_000
SLICE = 1 << 20  # sums of floats depend on where a slice ends, so scores keep to this one
MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.7
ADDED = ["held_out", "score", "predicted"]
CAPITALS, REPEATED = 0, 1  # buckets kept for the two marks


def random_vectors() -> np.ndarray:
    """A sparse vector of ones and minus ones for each bucket, from a fixed seed."""
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
    for row in out:
        at = rng.choice(DIMENSIONS, NONZERO, replace=False)
        row[at] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every token in order, marks after the token they belong to."""
    starts, ends, kind, doc = class_runs(data, offsets)
    hashed = lower_hashes(data, starts, ends)
    upper = np.append(0, np.cumsum((data >= ord("A")) & (data <= ord("Z"))))
    capitals = (kind == 1) & (ends - starts > 1) & (upper[ends] - upper[starts] == ends - starts)
    letters = np.flatnonzero(kind == 1)
    repeated = np.zeros(len(starts), dtype=bool)
    repeated[letters[1:]] = (hashed[letters[1:]] == hashed[letters[:-1]]) & (doc[letters[1:]] == doc[letters[:-1]])
    bucket = 2 + (mix(hashed) % U64(BUCKETS - 2)).astype(np.int64)
    at = np.arange(len(starts))
    order = np.concatenate([at * 3, at[capitals] * 3 + 1, at[repeated] * 3 + 2])
    sort = np.argsort(order, kind="stable")
    bucket = np.concatenate([bucket, np.full(capitals.sum(), CAPITALS), np.full(repeated.sum(), REPEATED)])
    return bucket[sort], np.concatenate([doc, doc[capitals], doc[repeated]])[sort]


def word_vectors(docs: DataFrame, random: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour sums and token counts of all buckets over all documents; the table's size is fixed.

    Each part of the corpus sends one row for each bit of the table it touched, so sums stay in Spark.
    """
    where = [np.stack([np.flatnonzero(r) for r in random]), None]
    where[1] = np.take_along_axis(random, where[0], axis=1)
    step = 64

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMENSIONS)
        count = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch, size=SLICE):
                bucket, doc = tokens(data, offsets)
                count += np.bincount(bucket, minlength=BUCKETS)
                for gap in range(1, REACH + 1):
                    a, b = bucket[:-gap], bucket[gap:]
                    same = doc[:-gap] == doc[gap:]
                    a, b = a[same], b[same]
                    for i in range(NONZERO):
                        for to, of in ((a, b), (b, a)):
                            total += np.bincount(to * DIMENSIONS + where[0][of, i], where[1][of, i], len(total))
        table = total.reshape(-1, step * DIMENSIONS)
        for at in range(len(table)):
            if count[at * step:(at + 1) * step].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int32()), pa.array([table[at].tobytes()], pa.binary()),
                     pa.array([count[at * step:(at + 1) * step].tobytes()], pa.binary())], ["at", "total", "count"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for at, total, count in zip(*[batch.column(c).to_pylist() for c in ("at", "total", "count")]):
                held = sums.setdefault(at, [np.zeros(step * DIMENSIONS), np.zeros(step, dtype=np.int64)])
                held[0] += np.frombuffer(total)
                held[1] += np.frombuffer(count, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s[0].tobytes() for s in sums.values()], pa.binary()),
             pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], ["at", "total", "count"])

    kind = "at int, total binary, count binary"
    rows = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(part, kind)
            .repartition("at").mapInArrow(add, kind).collect())
    total, count = np.zeros((BUCKETS // step, step * DIMENSIONS)), np.zeros((BUCKETS // step, step), dtype=np.int64)
    for r in rows:
        total[r["at"]] = np.frombuffer(r["total"])
        count[r["at"]] = np.frombuffer(r["count"], np.int64)
    return total.reshape(BUCKETS, DIMENSIONS), count.ravel()


@dataclass
class Network:
    """The pooled vectors' table, and the layers on top."""

    table: np.ndarray  # per bucket: its word vector beside its random vector, times its rarity
    rarity: np.ndarray
    layers: tuple[np.ndarray, ...] | None = None
    shift: np.ndarray | float = 0.0
    spread: np.ndarray | float = 1.0
    temperature: float = 1.0
    share: float = 0.0

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each document: weighted mean vector, and how long and how varied the document is."""
        bucket, doc = tokens(data, offsets)
        n = len(offsets) - 1
        out = np.zeros((n, self.table.shape[1] + 2), dtype=np.float64)
        mass = np.bincount(doc, self.rarity[bucket], minlength=n)
        cut = np.searchsorted(doc, np.arange(n + 1))
        full = np.flatnonzero(np.diff(cut))
        if len(full):
            sums = np.zeros((len(full), self.table.shape[1]))
            step = 1 << 16
            for first in range(0, len(bucket), step):  # a bounded number of vectors at a time
                piece = slice(first, first + step)
                docs, heads = np.unique(doc[piece], return_index=True)
                sums[np.searchsorted(full, docs)] += np.add.reduceat(self.table[bucket[piece]], heads, axis=0)
            out[full, :-2] = sums / mass[full, None]
        out[:, -2] = np.log1p(np.diff(cut))
        pairs = np.unique(doc * BUCKETS + bucket)
        out[:, -1] = np.bincount(pairs // BUCKETS, minlength=n) / np.maximum(np.diff(cut), 1)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(((x - self.shift) / self.spread) @ w1 + b1, 0.0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, turns: int = 60) -> None:
        """Adam on the weighted log loss over nine tenths; the temperature comes from the last tenth."""
        rng = np.random.default_rng(5)
        order = rng.permutation(len(x))
        back, front = order[: max(1, len(x) // 10)], order[max(1, len(x) // 10):]
        if len(set(y[front])) < 2:
            return
        self.shift, self.spread = x[front].mean(axis=0), x[front].std(axis=0) + 1e-6
        layers = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        first, second, turn = [0 * p for p in layers], [0 * p for p in layers], 0
        for _ in range(max(turns, LEAST_STEPS * 256 // len(front))):
            rng.shuffle(front)
            for rows in np.array_split(front, max(1, len(front) // 256)):
                turn += 1
                inner = ((x[rows] - self.shift) / self.spread) @ layers[0] + layers[1]
                live = np.maximum(inner, 0.0)
                p = 1.0 / (1.0 + np.exp(-np.clip(live @ layers[2] + layers[3], -30, 30)))
                error = weight[rows] * (p - y[rows]) / weight[rows].sum()
                back_in = (error[:, None] * layers[2]) * (inner > 0)
                slopes = [((x[rows] - self.shift) / self.spread).T @ back_in + 1e-4 * layers[0], back_in.sum(axis=0),
                          live.T @ error + 1e-4 * layers[2], np.array([error.sum()])]
                for i, g in enumerate(slopes):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    layers[i] = layers[i] - 3e-3 * (first[i] / (1 - 0.9 ** turn)) / (
                        np.sqrt(second[i] / (1 - 0.999 ** turn)) + 1e-8)
        self.layers = tuple(layers)
        z = self.logits(x[back])

        def loss(t: float) -> float:
            return float((weight[back] * np.logaddexp(0.0, -np.where(y[back] == 1, z, -z) / t)).sum())

        self.temperature = min(np.geomspace(0.5, 8.0, 41), key=loss)


def _features(network: Network):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [network.pooled(data, offsets) for _, _, data, offsets in slices(batch, size=SLICE)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("label"),
                     pa.array([r.tobytes() for part in out for r in part], pa.binary())], ["doc_id", "label", "x"])
    return rows


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    """Word vectors over all documents, and a network from the bounded sample."""
    random = random_vectors()
    total, count = word_vectors(docs, random)
    length = np.sqrt((total * total).sum(axis=1, keepdims=True))
    vectors = total / np.maximum(length, 1.0)
    rarity = 1.0 / np.sqrt(1.0 + count / max(1.0, count.sum() / BUCKETS))
    table = np.concatenate([vectors, random], axis=1) * rarity[:, None]
    chosen, n = sample(labels, label, MODULUS, HELD_OUT, PER_LABEL)
    network = Network(table.astype(np.float32), rarity, share=n[1] / max(1, sum(n)))
    rows = texts_of(docs, chosen).select("doc_id", "label", "text").mapInArrow(
        _features(network), "doc_id long, label int, x binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    if len(set(y.tolist())) == 2:
        x = np.stack([np.frombuffer(r["x"]) for r in rows])
        used = np.bincount(y.astype(int), minlength=2)
        weight = np.where(y == 1, n[1] / used[1], n[0] / used[0])
        network.train(x, y, weight / weight.mean())
    return network


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """`docs` with held_out, score and predicted."""
    shown = F.struct(*[F.col(f"`{c}`") for c in docs.columns])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [network.score(network.pooled(data, offsets)) for _, _, data, offsets in slices(batch, size=SLICE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("given"), batch.column("held_out"),
                 pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["given", "held_out", "score"])

    given = docs.select(F.col("text").cast("string").alias("text"), shown.alias("given"),
                        (remainder(MODULUS) == HELD_OUT).alias("held_out"))
    schema = T.StructType([given.schema["given"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType())])
    kept = [F.col(f"given.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return given.mapInArrow(score, schema).select(
        *kept, "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
