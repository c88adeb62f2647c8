"""Removal of long byte strings that occur earlier, by suffix arrays.

Runs of windows that can repeat are dealt to shards by content. Each shard sorts
the suffixes of its runs by Larsson-Sadakane refinement, gets the common
prefixes of neighbours by Kasai's rule and so groups equal windows. Of runs with one
content, the first stands for all: every window of the others is one that it has
earlier. Keys with very many runs are split over several shards; the windows that such
shards still hold as new are merged across shards in sorted order by binary search.

Defined results: a null text is empty; rows with a null doc_id keep all bytes;
rows that share a doc_id count as one document, so what one of them loses all of
them lose at the same place; an empty table gives an empty result; columns of
the input that have the name of an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import windows
from .shared import stored

#: A shard's arrays take some 60 bytes of memory for each byte of its runs, in every Python worker at once.
RUNS_PER_SHARD = 4_096
RUNS_PER_KEY = 8_192
ADDED = ["kept", "n_bytes", "n_removed", "n_spans", "removed"]
FOUND = "kind int, key long, content long, doc_id long, start long, end long, window binary"
REMOVED, NEW, ANSWER = range(3)  # kinds of a shard's rows
PLACE = np.int32  # a place in a shard's bytes


def suffix_array(text: np.ndarray, string: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes; each ends with its string, and a string's end sorts by the string's number.

    text: byte values; string: the string that holds each position; ends: the end of each string.
    """
    n, step = len(text), 7
    stop = ends[string]
    place = np.arange(n, dtype=PLACE)
    first = np.zeros(n, dtype=np.int64)
    for i in range(step):  # the first seven symbols, an end below every byte
        at = place + PLACE(i)
        first <<= 9
        first |= np.where(at < stop, text[np.minimum(at, PLACE(n - 1))].astype(np.int16) + np.int16(1), np.int16(0))
    order = np.argsort(first, kind="stable").astype(PLACE)
    rank = np.empty(n, dtype=PLACE)
    open_at, rank[order] = _regroup(first[order], place)
    del first, at
    while len(open_at):
        suffix = order[open_at]
        ahead = suffix + PLACE(step)
        both = rank[suffix].astype(np.int64)
        both *= 2 * n + 2
        both += np.where(ahead < stop[suffix], rank[np.minimum(ahead, PLACE(n - 1))], -1 - string[suffix])
        both += n + 1
        sort = np.argsort(both, kind="stable")
        order[open_at] = suffix[sort]
        still, fresh = _regroup(both[sort], open_at)
        rank[suffix[sort]] = fresh
        open_at, step = still, 2 * step
    return order


def _regroup(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that are still tied, and for each place the first place of its group."""
    fresh = np.append(True, keys[1:] != keys[:-1])
    head = np.maximum.accumulate(np.where(fresh, at, 0))
    alone = fresh & np.append(fresh[1:], True)
    return at[~alone], head


def common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, ends: np.ndarray,
                    string: np.ndarray, counts: np.ndarray, enough: int) -> np.ndarray:
    """Common prefix, up to `enough`, of the first `counts` suffixes of each string with those before them in order.

    Kasai's rule: the value falls by one at most from a suffix to the next of
    its string. All strings are walked at once, a position at a time.
    """
    n = len(text)
    before = np.full(n, -1, dtype=PLACE)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=PLACE)
    reach = np.zeros(len(begins), dtype=PLACE)
    for t in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > t)
        i = begins[live] + t
        j = before[i]
        h = np.where(j < 0, 0, np.maximum(reach[live] - 1, 0))
        room = np.minimum(enough, np.minimum(ends[live] - i, np.where(j < 0, 0, ends[string[j]] - j)))
        grow = np.flatnonzero(h < room)
        while len(grow):
            same = text[i[grow] + h[grow]] == text[j[grow] + h[grow]]
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < room[grow]]
        reach[live] = h
        out[i] = h
    return out


def shard_spans(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Spans of windows that start earlier in the shard; for split keys also the windows that do not.

    Of a run that stands for others, also its whole: what a later place of its class loses.
    """
    rows = rows.drop_duplicates(["doc_id", "start", "held"])  # rows of one doc_id hold a run once
    held = rows["held"].to_numpy()
    lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
    text = np.frombuffer(b"".join(held), dtype=np.uint8)
    ends = np.cumsum(lengths).astype(PLACE)
    begins = ends - lengths.astype(PLACE)
    string = np.repeat(np.arange(len(held), dtype=PLACE), lengths)
    counts = rows["n"].to_numpy(np.int64)
    doc, start = rows["doc_id"].to_numpy(np.int64), rows["start"].to_numpy(np.int64)
    order = suffix_array(text, string, ends)
    prefix = common_prefixes(text, order, begins, ends, string, counts, window)
    offset = np.arange(len(text), dtype=PLACE) - begins[string]
    is_window = offset < counts[string]
    sorted_windows = order[is_window[order]]
    del order
    owner = string[sorted_windows]
    group = np.cumsum(prefix[sorted_windows] < window, dtype=PLACE) - PLACE(1)
    del prefix
    at = start[owner] + offset[sorted_windows]
    by_age = np.lexsort((at, doc[owner])).astype(PLACE)
    older = np.append(False, (np.diff(doc[owner][by_age]) != 0) | (np.diff(at[by_age]) != 0))[:len(at)]
    age = np.empty(len(at), dtype=PLACE)
    age[by_age] = np.cumsum(older, dtype=PLACE)  # one age for one place, whichever row of the doc_id it is from
    del at, by_age, older
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    seen = np.zeros(len(text), dtype=bool)
    seen[sorted_windows] = age > np.minimum.reduceat(age, heads)[group]
    hit = np.flatnonzero(seen)
    fresh = np.append(True, (hit[1:] != hit[:-1] + 1) | (string[hit[1:]] != string[hit[:-1]])) if len(hit) else hit
    first = hit[fresh.astype(bool)] if len(hit) else hit
    last = hit[np.append(np.flatnonzero(fresh)[1:] - 1, len(hit) - 1)] if len(hit) else hit
    spans = pd.DataFrame({"kind": REMOVED, "key": None, "content": None, "doc_id": doc[string[first]],
                          "start": start[string[first]] + offset[first],
                          "end": start[string[first]] + offset[last] + window, "window": None})
    sorted_in = np.bincount(owner, minlength=len(held))  # a run is answered by the windows that stand in the order
    stands = np.flatnonzero(rows["others"].to_numpy(bool) & (sorted_in == counts))
    spans = pd.concat([spans, pd.DataFrame({
        "kind": ANSWER, "key": rows["key"].to_numpy()[stands], "content": rows["content"].to_numpy()[stands],
        "doc_id": doc[stands], "start": start[stands], "end": start[stands] + counts[stands] + window - 1,
        "window": None})])
    split = rows["split"].to_numpy(bool)
    new = np.flatnonzero(is_window & ~seen & split[string])
    if not len(new):
        return spans
    blob = text.tobytes()
    return pd.concat([spans, pd.DataFrame({
        "kind": NEW, "key": None, "content": None, "doc_id": doc[string[new]], "start": start[string[new]] + offset[new],
        "end": start[string[new]] + offset[new] + window, "window": [blob[i:i + window] for i in new]})])


def _merge(window: int):
    """Of sorted windows, those that start elsewhere than the first of their kind, found by binary search."""
    def later(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, first = b"", (0, 0)
        for part in parts:
            if not len(part):
                continue
            runs, places = part["window"].to_numpy().astype(f"S{window}"), part[["doc_id", "start"]].to_numpy(np.int64)
            of = places[np.searchsorted(runs, runs, side="left")]
            of[part["window"].to_numpy() == before] = first
            before, first = part["window"].iloc[-1], tuple(of[-1])
            yield part.loc[(places != of).any(axis=1), ["doc_id", "start", "end"]]
    return later


def duplicate_spans(docs: DataFrame, window: int = 100) -> DataFrame:
    """(doc_id, start, end) of byte spans made of windows that start in a smaller doc_id, or earlier in the same."""
    shape = windows.Shape(windows.bytes_of, window, 32 if window > 48 else 8, within=True)
    found = windows.repeated(docs, shape)
    dealt, any_split = windows.sharded(found.firsts, RUNS_PER_SHARD, RUNS_PER_KEY)
    held = windows.with_content(docs, dealt, shape, raw=True)
    local = stored(held.groupBy("shard").applyInPandas(lambda rows: shard_spans(rows, window), FOUND), "shards")
    others = found.others(local.where(F.col("kind") == ANSWER)).select(
        "doc_id", "start", (F.col("start") + F.col("n") + window - 1).alias("end"))
    spans = local.where(F.col("kind") == REMOVED).select("doc_id", "start", "end").unionByName(others)
    if not any_split:
        return spans
    across = (local.where(F.col("kind") == NEW).select("doc_id", "start", "end", "window")
              .repartitionByRange("window").sortWithinPartitions("window", "doc_id", "start")
              .mapInPandas(_merge(window), "doc_id long, start long, end long"))
    return spans.unionByName(across)


def dedup(docs: DataFrame, window: int = 100) -> DataFrame:
    """`docs` with what is left of each text (`kept`, bytes), its counts and the removed byte spans."""
    given = windows.with_spans(docs, duplicate_spans(docs, window))
    rest = given.schema["rest"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, gone, n, spans = [], [], [], [], []
            texts = batch.column("text").fill_null("").cast(pa.large_binary())
            for text, (start, end) in zip(texts, windows.span_lists(batch)):
                raw = text.as_buffer().to_pybytes()
                inside = start < len(raw)  # another row of the doc_id can be longer
                start, end = start[inside], np.minimum(end[inside], len(raw))
                if len(start):
                    cuts = [0, *np.stack([start, end], 1).ravel().tolist(), len(raw)]
                    kept.append(b"".join([raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])]))
                else:
                    kept.append(raw)
                size.append(len(raw))
                gone.append(int((end - start).sum()))
                n.append(len(start))
                spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())])
            pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), batch.column("rest"), pa.array(kept, pa.binary()),
                 pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(spans, pa.list_(pair))], ["doc_id", "text", "rest", *ADDED])

    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), rest,
                           T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                           T.StructField("removed", T.ArrayType(pair))])
    return windows.unpacked(given.mapInArrow(apply, schema), docs, "text", ADDED)
