"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The vocabulary is learnt from the labelled sample: words (runs of letters, in
lower case) that tell the labels apart by chi-square. Their document frequencies are
counted over all documents. The examples, in vectors of these words, lie in an
inverted index cut into blocks; each word's list has the largest weight in each
block. A document adds these bounds up, visits blocks from the largest bound
on, and stops when no block can hold a nearer example than those it has, so the
neighbours are exact over these words. Most documents hold none of them and have
no neighbour; README says how many, and what all words would cost. Votes count by nearness and by how much each label was
thinned out in the sample, and are then calibrated on the examples themselves,
each left out of its own neighbours.

Defined results: null and empty texts, and texts with none of the words, score
the share of label 1 among such examples; ties in similarity go to the smaller
doc_id; without examples of both labels every score is the share of label 1 (0
without labels); rows that repeat a doc_id are scored one by one; a null doc_id
has held_out null; input columns with the name of an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import remainder, sample, texts_of
from .text import U64, class_runs, lower_hashes, slices

#: Bounds of the model: labelled rows of each label, and words.
PER_LABEL = 6_000
MOST_WORDS = 2_048
#: Words whose chi-square is below this share of the largest are chance.
LEAST_SHARE = 0.03
#: And those below this value too: one word in some thirty million passes it by chance.
LEAST_CHI = 30.0
NEIGHBOURS = 15
BLOCK = 64
MODULUS, HELD_OUT = 5, 0
ADDED = ["held_out", "score", "predicted", "neighbours"]


def word_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, document, count) of the different words of each document, by document."""
    starts, ends, kind, doc = class_runs(data, offsets)
    letters = kind == 1
    word, doc = lower_hashes(data, starts[letters], ends[letters]), doc[letters]
    return counted(word, doc)


def counted(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((word, doc))
    word, doc = word[order], doc[order]
    at = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else doc
    return word[at], doc[at], np.diff(np.append(at, len(doc)))


@dataclass
class Vocabulary:
    words: np.ndarray  # sorted hashes
    weight: np.ndarray  # inverse document frequency

    def __post_init__(self):
        self.first_bits = np.zeros(1 << 16, dtype=bool)
        self.first_bits[(self.words >> U64(48)).astype(np.int64)] = True

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, document, unit weight) of the known words of each document."""
        starts, ends, kind, doc = class_runs(data, offsets)
        letters = kind == 1
        word, doc = lower_hashes(data, starts[letters], ends[letters]), doc[letters]
        likely = self.first_bits[(word >> U64(48)).astype(np.int64)]
        word, doc = word[likely], doc[likely]
        at = np.searchsorted(self.words, word)
        known = self.words[np.minimum(at, len(self.words) - 1)] == word if len(self.words) else np.zeros(len(at), bool)
        number, doc, count = counted(at[known].astype(U64), doc[known])
        number = number.astype(np.int64)
        weight = (1.0 + np.log(count)) * self.weight[number]
        length = np.sqrt(np.bincount(doc, weight * weight, minlength=len(offsets)))
        return number, doc, weight / length[doc]


@dataclass
class Index:
    """Examples in blocks, by word: for each word its blocks, their largest weight and the block's entries."""

    ids: np.ndarray
    labels: np.ndarray
    lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def build(ids: np.ndarray, labels: np.ndarray, number: np.ndarray, row: np.ndarray, weight: np.ndarray) -> Index:
        lists = {}
        order = np.lexsort((row, number))
        number, row, weight = number[order], row[order], weight[order]
        for word in np.unique(number):
            a, b = np.searchsorted(number, [word, word + 1])
            block = row[a:b] // BLOCK
            heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            lists[int(word)] = (block[heads], np.maximum.reduceat(weight[a:b], heads),
                                np.append(heads, b - a), row[a:b] % BLOCK, weight[a:b])
        return Index(ids, labels, lists)

    def nearest(self, number: np.ndarray, weight: np.ndarray, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(similarity, example) of the nearest examples of positive similarity, but for document `own`."""
        bound = np.zeros(-(-len(self.ids) // BLOCK))
        used = [(self.lists[w], x) for w, x in zip(number.tolist(), weight.tolist()) if w in self.lists]
        for (blocks, most, *_), x in used:
            bound[blocks] += x * most
        best_s, best_e = np.zeros(0), np.zeros(0, np.int64)
        for block in np.argsort(-bound, kind="stable"):
            worst = best_s[NEIGHBOURS - 1] if len(best_s) >= NEIGHBOURS else 0.0
            if bound[block] <= 0 or bound[block] < worst - 1e-12:
                break
            score = np.zeros(BLOCK)
            for (blocks, _, ends, rows, weights), x in used:
                at = np.searchsorted(blocks, block)
                if at < len(blocks) and blocks[at] == block:
                    score[rows[ends[at]:ends[at + 1]]] += x * weights[ends[at]:ends[at + 1]]
            hit = np.flatnonzero(score > 0)
            example = block * BLOCK + hit
            if own is not None:
                other = self.ids[example] != own
                hit, example = hit[other], example[other]
            s, e = np.append(best_s, np.round(score[hit], 12)), np.append(best_e, example)
            keep = np.lexsort((self.ids[e], -s))[:NEIGHBOURS]
            best_s, best_e = s[keep], e[keep]
        return best_s, best_e


@dataclass
class Model:
    vocabulary: Vocabulary
    index: Index
    thinned: np.ndarray  # rows that an example of each label stands for
    prior: float
    unknown: float  # share of label 1 where no word is known
    scale: tuple[float, float] = (1.0, 0.0)

    def vote(self, near: np.ndarray, example: np.ndarray) -> float:
        """Log odds of label 1 by nearness, with one example's weight of the prior."""
        weight = self.thinned[self.index.labels[example]] * near / (1.05 - np.minimum(near, 1.0))
        for_ = float(weight[self.index.labels[example] == 1].sum()) + self.prior
        against = float(weight[self.index.labels[example] == 0].sum()) + 1.0 - self.prior
        return float(np.log(for_ / against))

    def score(self, number: np.ndarray, weight: np.ndarray, own: int | None) -> tuple[float, np.ndarray]:
        near, example = self.index.nearest(number, weight, own)
        if not len(near):
            return self.unknown, example
        slope, shift = self.scale
        return float(1.0 / (1.0 + np.exp(-np.clip(slope * self.vote(near, example) + shift, -30, 30)))), example


def _word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for first, last, data, offsets in slices(batch):
            word, doc, _ = word_counts(data, offsets)
            kinds, at = np.unique(word, return_inverse=True)
            ones = np.bincount(at, label[first:last][doc], minlength=len(kinds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds.view(np.int64)), pa.array(ones), pa.array(np.bincount(at, minlength=len(kinds)) - ones)],
                ["word", "ones", "zeros"])


def learn_words(examples: DataFrame, n: list[int]) -> np.ndarray:
    """Hashes of the words that tell the labels apart best."""
    totals = examples.mapInArrow(_word_totals, "word long, ones long, zeros long").groupBy("word").agg(
        F.sum("ones").alias("a"), F.sum("zeros").alias("b"))
    c, d = F.lit(n[1]) - F.col("a"), F.lit(n[0]) - F.col("b")
    a, b = F.col("a"), F.col("b")
    cross = (a * d - b * c).cast("double")
    chi = F.lit(float(sum(n))) * cross * cross / ((a + b) * (c + d)).cast("double") / F.lit(float(n[0] * n[1]))
    top = (totals.where(a + b < sum(n)).withColumn("chi", chi).orderBy(F.desc("chi"), "word").limit(MOST_WORDS)
           .select("word", "chi").toPandas())
    if top.empty:
        return np.zeros(0, dtype=U64)
    kept = top.loc[top["chi"] >= max(LEAST_CHI, LEAST_SHARE * top["chi"].max()), "word"]
    return np.sort(kept.to_numpy(np.int64).view(U64))


def document_frequencies(docs: DataFrame, words: np.ndarray) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many hold each word; one small row for each part of the table."""
    flat = Vocabulary(words, np.ones(len(words)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, _, data, offsets in slices(batch):
                held += np.bincount(flat.vectors(data, offsets)[0], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(words))), pa.array(np.append(n, held))], ["at", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "at long, n long").groupBy("at").agg(
        F.sum("n").alias("n")).toPandas().sort_values("at")["n"].to_numpy()
    return (int(sums[0]), sums[1:]) if len(sums) else (0, np.zeros(len(words), np.int64))


def _vector_rows(vocabulary: Vocabulary):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, weight = [], []
            for first, last, data, offsets in slices(batch):
                n, doc, w = vocabulary.vectors(data, offsets)
                cut = np.searchsorted(doc, np.arange(last - first + 1))
                number += [n[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]
                weight += [w[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(number, pa.list_(pa.int64())),
                 pa.array(weight, pa.list_(pa.float64()))], ["doc_id", "label", "number", "weight"])
    return rows


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Vocabulary, index and calibration; everything kept is bounded by PER_LABEL and MOST_WORDS."""
    chosen, n = sample(labels, label, MODULUS, HELD_OUT, PER_LABEL)
    chosen = texts_of(docs, chosen).dropDuplicates(["doc_id"])
    held = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    used = [held.get(0, 0), held.get(1, 0)]
    prior = n[1] / max(1, sum(n))
    words = learn_words(chosen.select("text", "label"), used) if min(used) else np.zeros(0, dtype=U64)
    total, held_by = document_frequencies(docs, words)
    vocabulary = Vocabulary(words, np.log((1.0 + total) / (1.0 + held_by)) + 1.0)
    rows = chosen.select("doc_id", "label", "text").mapInArrow(
        _vector_rows(vocabulary), "doc_id long, label int, number array<long>, weight array<double>").toPandas()
    known = rows["number"].map(len) > 0
    thinned = np.array([n[y] / max(1, used[y]) for y in (0, 1)])
    blank = thinned[rows.loc[~known, "label"].to_numpy(int)]
    ones = rows.loc[~known, "label"].to_numpy(int) == 1
    rows = rows[known]
    # Examples of like words share blocks, so that block bounds tell them apart.
    rows = rows.assign(lead=[tuple(x) for x in rows["number"]]).sort_values(["lead", "doc_id"]).reset_index(drop=True)
    sizes = rows["number"].map(len).to_numpy(int)
    join = lambda c, kind: np.concatenate([np.zeros(0, kind), *[np.asarray(x, kind) for x in rows[c]]])
    index = Index.build(rows["doc_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64),
                        join("number", np.int64), np.repeat(np.arange(len(rows)), sizes), join("weight", np.float64))
    unknown = float((blank[ones].sum() + prior) / (blank.sum() + 1.0)) if sum(n) else 0.0
    model = Model(vocabulary, index, thinned, prior, unknown)
    model.scale = calibrated(model, rows)
    return model


def calibrated(model: Model, rows: pd.DataFrame) -> tuple[float, float]:
    """Slope and shift that turn left-out votes of examples into probabilities, by damped Newton steps."""
    votes, labels = [], []
    for number, weight, doc, y in zip(rows["number"], rows["weight"], rows["doc_id"], rows["label"]):
        near, example = model.index.nearest(np.asarray(number, np.int64), np.asarray(weight), doc)
        if len(near):
            votes.append(model.vote(near, example))
            labels.append(y)
    y = np.array(labels, dtype=float)
    if len(set(labels)) < 2:
        return 1.0, 0.0
    x = np.stack([np.array(votes), np.ones(len(votes))], 1)
    weight = model.thinned[y.astype(int)]
    beta = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - (beta - [1.0, 0.0])
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        beta = beta + np.linalg.solve(hessian, gradient)
    return float(max(beta[0], 0.05)), float(beta[1])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with held_out, score, predicted, and the neighbours' ids, labels and similarities as evidence."""
    ids, labels = model.index.ids, model.index.labels
    shown = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    evidence = pa.struct([("doc_id", pa.int64()), ("label", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, near = [], []
            own = batch.column("doc_id").to_pylist()
            for first, last, data, offsets in slices(batch):
                number, doc, weight = model.vocabulary.vectors(data, offsets)
                cut = np.searchsorted(doc, np.arange(last - first + 1))
                for row in range(first, last):
                    a, b = cut[row - first], cut[row - first + 1]
                    if a == b:
                        scores.append(model.unknown)
                        near.append([])
                        continue
                    s, example = model.score(number[a:b], weight[a:b], own[row])
                    scores.append(s)
                    near.append([{"doc_id": i, "label": y} for i, y in zip(ids[example].tolist(), labels[example].tolist())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("given"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array(near, pa.list_(evidence))], ["given", "held_out", "score", "neighbours"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        shown.alias("given"), (remainder(MODULUS) == HELD_OUT).alias("held_out"))
    pair = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType())])
    schema = T.StructType([given.schema["given"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType()), T.StructField("neighbours", T.ArrayType(pair))])
    out = given.mapInArrow(score, schema)
    kept = [F.col(f"given.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return out.select(*kept, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
