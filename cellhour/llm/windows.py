"""Windows that occur more than once, brought together by content.

A window is `window` consecutive items (bytes or words) of one document. Its
least hash over the `gram`-item strings inside it is its key: equal windows have
equal keys wherever they stand, and neighbouring windows mostly share one, so a
document falls into runs of windows with one key. Only runs whose key occurs
again anywhere can hold a repeated window. Runs of equal content fold into one
class by an aggregate, so that only the first run of a class moves: the method that
looks for windows decides that run, and its other places take their spans from the answer.

Runs are of one class if the 64-bit hashes of their key and of their whole content
are equal: among n runs, with at most k contents to a key, n * k / 2^65 pairs of
different runs are expected to be taken for one. Inside a class nothing else is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellhour.session import small_batches

from .shared import stored
from .text import U64, mix, prefix_hash, slices, span_hash, word_hashes

LONGEST_RUN = 256
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64))

Items = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def bytes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUES[data], offsets


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(data, offsets)


@dataclass(frozen=True)
class Shape:
    """What counts as an item, a window and a gram (a power of two below `window`)."""

    items: Items
    window: int
    gram: int
    within: bool = False  # whether windows of one document are compared with each other


def least_grams(items: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """All gram hashes, and for each start of a window the least one inside the window."""
    grams, width = items, 1
    while width < shape.gram:
        grams = grams[:-width] * U64(0xD6E8FEB86659FD93) + grams[width:]
        width *= 2
    grams = mix(grams)
    least, reach, width = grams, shape.window - shape.gram + 1, 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return grams, np.minimum(least[: len(least) - (reach - width)], least[reach - width:])


def holds_repeat(grams: np.ndarray, least: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a run may hold one window twice.

    Such a run is periodic, so its key stands at the start of one of its windows
    and once more, further on, at the end of one.
    """
    reach = len(grams) - len(least)
    opens = np.append(np.flatnonzero(grams[: len(least)] == least), len(grams))
    closes = np.append(-1, np.flatnonzero(grams[reach:] == least))
    first = opens[np.searchsorted(opens[:-1], start)]
    last = closes[np.searchsorted(closes[1:], end)]
    return (first < end) & (last >= start) & (last + reach > first)


def runs(items: np.ndarray, firsts: np.ndarray, shape: Shape, content: bool) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, key, may hold a window twice, content hash or none) of every run."""
    n_windows = np.maximum(np.diff(firsts) - shape.window + 1, 0)
    none = np.zeros(0, np.int64)
    if not n_windows.any():
        return none, none, none, none, none.astype(bool), none
    grams, least = least_grams(items, shape)
    begin, stop = firsts[:-1], firsts[:-1] + n_windows
    steps = np.zeros(len(items) + 1, dtype=np.int8)
    full = n_windows > 0
    steps[begin[full]] += 1
    steps[stop[full]] -= 1
    inside = np.cumsum(steps[: len(least)], dtype=np.int8).astype(bool)
    fresh = np.ones(len(least), dtype=bool)
    fresh[1:] = least[1:] != least[:-1]
    fresh[begin[full]] = True
    at = np.flatnonzero(fresh & inside)
    doc = np.searchsorted(begin[full], at, side="right") - 1
    end = np.minimum(np.append(at[1:], len(items)), stop[full][doc])
    twice = holds_repeat(grams, least, at, end) if shape.within else np.zeros(len(at), dtype=bool)
    pieces = -(-(end - at) // LONGEST_RUN)
    if (pieces > 1).any():
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(at, pieces) + part * LONGEST_RUN
        end = np.minimum(np.repeat(end, pieces), start + LONGEST_RUN)
        doc, key, twice = np.repeat(doc, pieces), np.repeat(least[at], pieces), np.repeat(twice, pieces)
    else:
        start, key = at, least[at]
    rows = np.flatnonzero(full)[doc]
    inner = span_hash(prefix_hash(items), start, end + shape.window - 1) if content else none
    return rows, start - begin[rows], end - start, key.view(np.int64), twice, inner.view(np.int64)


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _key_counts(shape: Shape):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch):
                _, _, _, key, twice, _ = runs(*shape.items(data, offsets), shape, False)
                key, n = np.unique(np.append(key, key[twice]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
    return count


def _run_rows(shape: Shape):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, last, data, offsets in slices(batch):
                doc, start, n, key, twice, content = runs(*shape.items(data, offsets), shape, True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(content), pa.array(ids[first:last][doc].astype(np.int64)),
                     pa.array(start), pa.array(n.astype(np.int32)), pa.array(twice)],
                    ["key", "content", "doc_id", "start", "n", "twice"])
    return rows


@dataclass(frozen=True)
class Repeats:
    """`runs`: all runs whose key occurs again, with the hash of their content.
    `firsts`: the first run of every class, the classes of its key, and whether it has `others`."""

    runs: DataFrame
    firsts: DataFrame

    def others(self, answers: DataFrame) -> DataFrame:
        """The places of an answered class besides its first, which `answers` has as doc_id and start."""
        first = answers.select("key", "content", F.col("doc_id").alias("first_doc"), F.col("start").alias("first_start"))
        return self.runs.join(first, ["key", "content"]).where("doc_id <> first_doc OR start <> first_start")


def repeated(docs: DataFrame, shape: Shape) -> Repeats:
    """Runs that may hold a window found elsewhere. Rows with a null doc_id take no part."""
    small_batches(docs.sparkSession)
    texts = _numbered(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    keys = (texts.mapInArrow(_key_counts(shape), "key long, n long")
            .groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    found = (texts.mapInArrow(_run_rows(shape), "key long, content long, doc_id long, start long, n int, twice boolean")
             .join(keys, "key"))
    found = stored(found, "runs")
    classes = found.groupBy("key", "content").agg(
        F.min(F.struct("doc_id", "start", "n")).alias("first"), (F.count("*") > 1).alias("others"))
    classes = stored(classes, "classes")
    kinds = classes.groupBy("key").agg(F.count("*").alias("kinds"))
    return Repeats(found, classes.join(kinds, "key").select("key", "content", "kinds", "others", "first.*"))


def with_content(docs: DataFrame, firsts: DataFrame, shape: Shape, raw: bool) -> DataFrame:
    """The runs with what they hold: their bytes, or their items' hashes (`raw` false).

    Of rows that share a doc_id, only those that hold the run at its place count.
    """
    told = ["shard", "split", "key", "content", "others", "start", "n"]
    wanted = firsts.groupBy("doc_id").agg(F.collect_list(F.struct(*told)).alias("wanted"))
    joined = _numbered(docs).join(wanted, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            lists = batch.column("wanted")
            ends = lists.offsets.to_numpy()
            runs_ = {c: lists.values.field(i).to_numpy(zero_copy_only=False) for i, c in enumerate(told)}
            for first, last, data, offsets in slices(batch):
                items, bounds = shape.items(data, offsets)
                row = np.repeat(np.arange(first, last), np.diff(ends[first:last + 1]))
                of = np.arange(ends[first], ends[last])
                a = bounds[row - first] + runs_["start"][of]
                b = a + runs_["n"][of] + shape.window - 1
                held = np.flatnonzero(b <= bounds[row - first + 1])
                inner = span_hash(prefix_hash(items), a[held], b[held]).view(np.int64)
                held = held[inner == runs_["content"][of[held]]]
                of, blob = of[held], data if raw else items
                texts = [blob[x:y].tobytes() for x, y in zip(a[held].tolist(), b[held].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(runs_[c][of]) for c in told], pa.array(ids[row[held]].astype(np.int64)),
                     pa.array(texts, pa.binary())], [*told, "doc_id", "held"])

    return joined.select("doc_id", "text", "wanted").mapInArrow(
        cut, "shard long, split boolean, key long, content long, others boolean, start long, n int, doc_id long, held binary")


def sharded(firsts: DataFrame, per_shard: int, per_key: int) -> tuple[DataFrame, bool]:
    """Runs dealt to shards of about `per_shard`; a key of more than `per_key` is split over several.

    Also whether any key was split.
    """
    total, most = firsts.agg(F.count("*"), F.max("kinds")).first()
    shards = max(1, -(-total // per_shard))
    parts = F.ceil(F.col("kinds") / per_key)
    dealt = firsts.withColumn("split", parts > 1).withColumn(
        "shard", F.pmod(F.xxhash64("key", F.pmod("content", parts)), F.lit(shards)))
    return dealt, (most or 0) > per_key


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.append(True, starts[1:] > reach[:-1])
    return starts[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(reach) - 1)]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each row of `docs` as (doc_id, text, rest, spans); a document's spans are fewer than its items."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    held = F.struct(*rest) if rest else F.lit(True)
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    shown = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        held.alias("rest"))
    return shown.join(lists, "doc_id", "left").select("doc_id", "text", "rest", "spans")


def unpacked(df: DataFrame, docs: DataFrame, text: str, added: list[str]) -> DataFrame:
    """The columns of `docs` in their order, then the added ones, which win over columns of the same name."""
    place = {"doc_id": F.col("doc_id"), "text": F.col(text).alias("text")}
    kept = [place.get(c, F.col(f"rest.`{c}`").alias(c)) for c in docs.columns if c not in added]
    return df.select(*kept, *added)


def span_lists(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merged spans of each row of the column `spans`."""
    lists = batch.column("spans")
    none = np.zeros(0, np.int64)
    ends = lists.offsets.to_numpy()
    start, end = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    for row in range(batch.num_rows):
        a, b = ends[row], ends[row + 1]
        yield merged_spans(start[a:b], end[a:b]) if lists[row].is_valid and b > a else (none, none)
