"""Removal of passages that an earlier document has, by relative Lempel-Ziv parsing.

Runs of word windows that can repeat are dealt to reference blocks by content.
Within a block, documents are taken in order of doc_id: each run is factored
greedily against what earlier documents of the block hold, found by an index of
their windows and extended word by word. A factor of a whole window or more is a
duplicate span. The windows that straddle the end of a factor are each looked up
before parsing goes on. Of runs with one content, the first is parsed for all: later
documents lose the whole, its own document's other places what it loses itself. Keys
with very many runs are split over several blocks; windows that are new in such a
block are compared with those of the other blocks.

Defined results: a null text has no words and stays null; rows with a null
doc_id keep all words; rows that share a doc_id count as one document, so what
one of them loses all of them lose at the same place; an empty table gives an
empty result; input columns with the name of an added column are replaced.
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
from .text import U64, mix, prefix_hash, slices, span_hash, word_spans

RUNS_PER_BLOCK = 4_096
RUNS_PER_KEY = 8_192
ADDED = ["n_words", "n_removed", "removed"]
FOUND = "kind int, key long, content long, begin long, doc_id long, start long, end long, high long, low long"
REMOVED, NEW, ANSWER = range(3)  # kinds of a block's rows


def parse_block(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Duplicate spans of a block; for split keys also the windows that are new in it.

    `begin` is where a row's run begins. A run that stands for others is also given
    whole: each of its words is now in a factor or in the index.
    """
    rows = rows.sort_values(["doc_id", "start"], kind="stable")
    held = rows["held"].to_numpy()
    n = rows["n"].to_numpy(np.int64)
    words = np.frombuffer(b"".join(held), dtype=U64)
    ends = np.cumsum(n + window - 1)
    begins = ends - (n + window - 1)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(begins, n) + offset
    code = span_hash(prefix_hash(words), at, at + window)
    codes, places = code.tolist(), at.tolist()
    run_end = dict(zip(begins.tolist(), ends.tolist()))
    doc, start = rows["doc_id"].tolist(), rows["start"].tolist()
    first_window = (np.cumsum(n) - n).tolist()
    index: dict[int, tuple[int, int]] = {}  # a window's hash: its place, and the end of its run
    spans, fresh = [], np.ones(len(codes), dtype=bool)
    row = 0
    while row < len(doc):
        after = row
        while after < len(doc) and doc[after] == doc[row]:
            after += 1
        for r in range(row, after):
            base, count, begin = first_window[r], int(n[r]), int(begins[r])
            i = 0
            while i < count:
                source = index.get(codes[base + i])
                if source is None:
                    i += 1  # a literal word
                    continue
                place, limit = source
                room = min(limit - place, int(ends[r]) - begin - i)
                unlike = np.flatnonzero(words[place:place + room] != words[begin + i:begin + i + room])
                length = int(unlike[0]) if len(unlike) else room
                if length < window:
                    i += 1
                    continue
                spans.append((r, start[r] + i, start[r] + i + length))
                fresh[base + i:base + i + length - window + 1] = False
                i += length - window + 1  # the first window over the factor's end
        for r in range(row, after):
            limit = run_end[int(begins[r])]
            for w in range(first_window[r], first_window[r] + int(n[r])):
                if fresh[w]:
                    index.setdefault(codes[w], (places[w], limit))
        row = after
    told = rows[["key", "content", "doc_id", "start", "n", "others", "split"]].reset_index(drop=True)

    def of_runs(kind: int, at_rows, begin, end, **more) -> pd.DataFrame:
        run = told.iloc[at_rows]
        return pd.DataFrame({"kind": kind, "key": run["key"].to_numpy(), "content": run["content"].to_numpy(),
                             "begin": run["start"].to_numpy(), "doc_id": run["doc_id"].to_numpy(),
                             "start": begin, "end": end, "high": None, "low": None} | more)

    stands = np.flatnonzero(told["others"].to_numpy(bool))
    opens = told["start"].to_numpy(np.int64)
    found = np.array(spans, dtype=np.int64).reshape(-1, 3)
    out = pd.concat([of_runs(REMOVED, found[:, 0], found[:, 1], found[:, 2]),
                     of_runs(ANSWER, stands, opens[stands], opens[stands] + n[stands] + window - 1)])
    of = np.repeat(np.arange(len(n)), n)
    new = np.flatnonzero(fresh & told["split"].to_numpy(bool)[of])
    if not len(new):
        return out
    other = span_hash(prefix_hash(mix(words ^ U64(0xA5A5A5A5A5A5A5A5))), at[new], at[new] + window)
    begin = opens[of[new]] + offset[new]
    return pd.concat([out, of_runs(NEW, of[new], begin, begin + window,
                                   high=code[new].view(np.int64), low=other.view(np.int64))])


def duplicate_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, start, end) of word spans made of windows that also start in a document with a smaller doc_id."""
    shape = windows.Shape(windows.words_of, window, 8 if window >= 16 else 2)
    found = windows.repeated(docs, shape)
    dealt, any_split = windows.sharded(found.firsts, RUNS_PER_BLOCK, RUNS_PER_KEY)
    held = windows.with_content(docs, dealt, shape, raw=False)
    local = stored(held.groupBy("shard").applyInPandas(lambda rows: parse_block(rows, window), FOUND), "blocks")
    told = ["key", "content", "begin", "doc_id", "start", "end"]
    spans = local.where(F.col("kind") == REMOVED).select(*told)
    if any_split:
        new = local.where(F.col("kind") == NEW).select(*told, "high", "low")
        first = new.groupBy("high", "low").agg(F.min("doc_id").alias("first_doc"))
        spans = spans.unionByName(new.join(first, ["high", "low"]).where("doc_id > first_doc").select(*told))
    others = found.others(local.where(F.col("kind") == ANSWER))
    later = others.where("doc_id > first_doc").select(
        "doc_id", "start", (F.col("start") + F.col("n") + window - 1).alias("end"))
    same = (others.where("doc_id = first_doc").select("key", "content", "doc_id", F.col("start").alias("place"))
            .join(spans.drop("doc_id"), ["key", "content"])
            .select("doc_id", (F.col("place") + F.col("start") - F.col("begin")).alias("start"),
                    (F.col("place") + F.col("end") - F.col("begin")).alias("end")))
    return spans.select("doc_id", "start", "end").unionByName(later).unionByName(same)


def dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """`docs` without repeated passages, with each document's words, removed words and removed word spans.

    A removed span takes the white space after it along; other white space stays.
    """
    given = windows.with_spans(docs, duplicate_spans(docs, window))
    rest = given.schema["rest"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = list(windows.span_lists(batch))
            kept, count, gone, spans = [], [], [], []
            for first, last, data, offsets in slices(batch):
                starts, _, words = word_spans(data, offsets)
                raw = data.tobytes()
                for row in range(first, last):
                    a, b = int(offsets[row - first]), int(offsets[row - first + 1])
                    w0, w1 = int(words[row - first]), int(words[row - first + 1])
                    start, end = lists[row]
                    inside = start < w1 - w0  # another row of the doc_id can be longer
                    start, end = start[inside], np.minimum(end[inside], w1 - w0)
                    if len(start):
                        edge = np.append(starts[w0:w1], b)
                        cuts = [a, *np.stack([edge[start], edge[end]], 1).ravel().tolist(), b]
                        kept.append(b"".join([raw[x:y] for x, y in zip(cuts[::2], cuts[1::2])]))
                    else:
                        kept.append(raw[a:b])
                    count.append(w1 - w0)
                    gone.append(int((end - start).sum()))
                    spans.append([{"start": x, "end": y} for x, y in zip(start.tolist(), end.tolist())])
            absent = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            texts = pa.array(kept, pa.binary(), mask=absent if len(absent) else None).cast(pa.string())
            pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), texts, batch.column("rest"), pa.array(count, pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pair))], ["doc_id", "text", "rest", *ADDED])

    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), rest,
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("removed", T.ArrayType(pair))])
    return windows.unpacked(given.mapInArrow(apply, schema), docs, "text", ADDED)
