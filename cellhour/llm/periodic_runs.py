"""Runs of words that repeat with a period, by the branching-tandem test on an enhanced suffix array.

The words of a slice of documents become numbers of their own for each document,
every document closed by a sign that occurs once. A suffix array by prefix
doubling, the common prefixes of neighbours and the inverse array (ISA) are laid
over the slice. A square w w is branching when the word after it differs from
the first of its second half: then the suffixes at its start i and at i + |w|
lie in one LCP interval of depth |w|, in different children. So for every LCP
interval, a pair of bounds found from the nearest smaller prefixes, the
suffixes i of its smaller child are tested for ISA[i + depth] and
ISA[i - depth] in the other child; no suffix is looked at more than log n
times, and no tree is built.

Each branching square ends where a run ends. Squares that end at one place are
taken from the shortest root up: one whose root is a multiple of a shorter one,
within the run of the shorter one, is that run again and is dropped; the others
are rotated to the left, word by word in growing blocks, as long as the word that enters
equals the word a period ahead. What a square covers while it rotates is its run:
it cannot grow to either side and has no smaller period.

Defined results: a null text has no words and stays null; null doc_ids and rows
that repeat a doc_id are handled row by row; runs of a document come by start,
then period; an empty table gives an empty result; input columns with the name
of an added column are replaced. A document is held whole by one task, at some
250 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADDED = ["n_words", "runs", "collapsed"]
RUN = "array<struct<start:long,length:long,period:long>>"
WORDS_PER_SLICE = 1 << 18
TESTS_PER_PASS = 1 << 21
LEAST_WORDS, LEAST_EXPONENT = 6, 4


def suffix_array(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(order, rank, levels) of the suffixes of numbers; the last sign must occur once.

    Prefix doubling: only suffixes that are still tied are sorted again. A level holds, for prefixes of 2^k signs,
    the places whose group changed and their new groups, so that groups of every length can be told again.
    """
    n = len(signs)
    order = np.argsort(signs, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    tied, rank[order] = regrouped(signs[order], np.arange(n))
    levels, step = [(np.arange(n), rank.copy())], 1
    while len(tied):
        suffix = order[tied]
        both = rank[suffix] * n + rank[suffix + step]
        sort = np.argsort(both, kind="stable")
        suffix = suffix[sort]
        order[tied] = suffix
        tied, fresh = regrouped(both[sort], tied)
        changed = rank[suffix] != fresh
        rank[suffix] = fresh
        levels.append((suffix[changed], fresh[changed]))
        step *= 2
    return order, rank, levels


def regrouped(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose key another shares, and for each place the first place of its group."""
    fresh = np.append(True, keys[1:] != keys[:-1])
    head = np.maximum.accumulate(np.where(fresh, at, 0))
    return at[~(fresh & np.append(fresh[1:], True))], head


def common_prefixes(order: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, from the longest doubled prefix down.

    Two suffixes share 2^k signs if their groups at level k are equal; a level is undone before the next is asked.
    """
    n = len(order)
    lcp = np.zeros(n, dtype=np.int64)
    history = []
    group = levels[0][1].copy()
    for suffix, fresh in levels[1:]:
        history.append((suffix, group[suffix]))
        group[suffix] = fresh
    left, right = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(group[left] == group[right])
        lcp[1 + same] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
        if k:
            suffix, old = history.pop()
            group[suffix] = old
    return lcp


def bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, first, end): for each neighbour pair with a common prefix, the ranks of the suffixes that share it.

    The interval of place j is split there: its left child is [first, j), the rest [j, end). Of equal prefixes the
    leftmost splits first. The nearest smaller values come from minima over spans of 2^k places.
    """
    at = np.flatnonzero(lcp > 0)
    if not len(at):
        return at, at, at
    # Only the longest stretch without a zero decides how far a search goes; a zero closes both ends.
    closed = np.append(lcp, 0)
    zeros = np.flatnonzero(closed == 0)
    longest = int(np.diff(zeros).max(initial=1))
    minima = [closed]
    while (1 << len(minima)) <= longest:
        last, half = minima[-1], 1 << (len(minima) - 1)
        minima.append(np.minimum(last, np.append(last[half:], np.zeros(half, last.dtype))))
    depth = closed[at]
    end, first = at + 1, at.copy()
    for k in range(len(minima) - 1, -1, -1):
        wide = 1 << k
        # To the right: stay while everything in the span is at least as deep.
        go = minima[k][np.minimum(end, len(lcp))] >= depth
        end[go] += wide
        # To the left: stay while everything in the span is deeper.
        back = first - wide
        go = (back >= 0) & (minima[k][np.maximum(back, 0)] > depth)
        first[go] -= wide
    return at, first - 1, end


def branching_squares(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares whose next word breaks the period."""
    n = len(order)
    split, first, end = bounds(lcp)
    depth = lcp[split]
    left_small = split - first <= end - split
    begin = np.where(left_small, first, split)
    size = np.where(left_small, split - first, end - split)
    low, high = np.where(left_small, split, first), np.where(left_small, end, split)  # the other child
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    passes = np.cumsum(size) // TESTS_PER_PASS
    edges = np.concatenate([[0], 1 + np.flatnonzero(np.diff(passes)), [len(size)]])
    for a, b in zip(edges[:-1], edges[1:]):
        count = size[a:b]
        node = np.repeat(np.arange(a, b), count)
        suffix = order[np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + begin[node]]
        for way in (1, -1):
            other = suffix + way * depth[node]
            inside = np.flatnonzero((other >= 0) & (other < n))
            met = rank[other[inside]]
            hit = inside[(met >= low[node[inside]]) & (met < high[node[inside]])]
            starts.append(np.minimum(suffix[hit], other[hit]))
            periods.append(depth[node[hit]])
    return np.concatenate(starts), np.concatenate(periods)


def rotated(signs: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far to the left each square can be rotated: its run's first place.

    Words are compared in blocks that grow; a document's closing sign equals none, so no run leaves its document.
    """
    start = start.copy()
    live, block = np.arange(len(start)), 1
    while len(live):
        room = np.minimum(block, start[live])
        live, room = live[room > 0], room[room > 0]
        if not len(live):
            break
        heads = np.cumsum(room) - room
        back = np.arange(int(room.sum())) - np.repeat(heads, room) + 1  # 1, 2 ... places to the left
        place = np.repeat(start[live], room) - back
        differs = signs[place] != signs[place + np.repeat(period[live], room)]
        stop = np.minimum.reduceat(np.where(differs, back, np.iinfo(np.int64).max), heads)
        start[live] -= np.minimum(stop - 1, room)
        live = live[stop > room]
        block = min(2 * block, 1 << 12)
    return start


def all_runs(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of every run of at least two periods, in any order."""
    none = np.zeros(0, dtype=np.int64)
    if len(signs) < 2:
        return none, none, none
    order, rank, levels = suffix_array(signs)
    start, period = branching_squares(order, rank, common_prefixes(order, levels))
    end = start + 2 * period
    by_end = np.lexsort((period, end))
    start, period, end = start[by_end], period[by_end], end[by_end]
    out = []
    while len(start):  # the shortest root at each end; one round for each run that ends there
        shortest = np.append(True, end[1:] != end[:-1])
        at = rotated(signs, start[shortest], period[shortest])
        out.append((at, end[shortest], period[shortest]))
        owner = np.cumsum(shortest) - 1
        again = (period % period[shortest][owner] == 0) & (at[owner] <= start)
        start, period, end = start[~again], period[~again], end[~again]
    if not out:
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def frequent_runs(signs: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least `least` words and `exponent` periods, by start, then period."""
    start, end, period = all_runs(signs)
    length = end - start
    kept = np.flatnonzero(length >= np.maximum(least, exponent * period))
    kept = kept[np.lexsort((period[kept], start[kept]))]
    return np.stack([start[kept], length[kept], period[kept]], axis=1)


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of documents as numbers that no two documents share, closed by one more each; where each begins."""
    signs, begins, free, at = [], [], 0, 0
    for words in texts:
        codes, known = pd.factorize(np.array(words, dtype=object))
        signs += [codes + free, [free + len(known)]]
        free += len(known) + 1
        begins.append(at)
        at += len(words) + 1
    return np.concatenate(signs).astype(np.int64), np.array(begins, dtype=np.int64)


def slice_runs(texts: list[list[bytes]], exponent: int, least: int) -> list[np.ndarray]:
    """For each document, rows (start, length, period) of its runs."""
    signs, begins = numbered(texts)
    rows = frequent_runs(signs, exponent, least)
    doc = np.searchsorted(begins, rows[:, 0], side="right") - 1
    rows[:, 0] -= begins[doc]
    return np.split(rows, np.searchsorted(doc, np.arange(1, len(texts))))


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def find(docs: DataFrame, exponent: int = LEAST_EXPONENT, least: int = LEAST_WORDS) -> DataFrame:
    """`docs` with `n_words`, the `runs` of at least `exponent` periods, and the words that remain when each run is
    cut to its first period (`collapsed`, joined by one space)."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    kept = [c for c in docs.columns if c not in ADDED]
    given = docs.select(*kept)
    at = kept.index("text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def described(texts: list[list[bytes]]) -> pa.RecordBatch:
        found = slice_runs(texts, exponent, least)
        left = [b" ".join(collapsed(w, r) if len(r) else w).decode() for w, r in zip(texts, found)]
        flat = pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(found).T.copy()], fields=list(kind.value_type))
        ends = np.concatenate([[0], np.cumsum([len(r) for r in found])])
        return pa.RecordBatch.from_arrays(
            [pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat).cast(kind),
             pa.array(left, pa.string())], names=ADDED)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            while row < len(batch):
                texts, n, first = [], 0, row
                while row < len(batch) and (n == 0 or n < WORDS_PER_SLICE):
                    texts.append((batch.column(at)[row].as_py() or "").encode().split())
                    n += len(texts[-1]) + 1
                    row += 1
                made = described(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, row - first).columns, *made.columns], names=[*kept, *ADDED])

    schema = T.StructType([*given.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.DataType.fromDDL(RUN)), T.StructField("collapsed", T.StringType())])
    return given.mapInArrow(apply, schema)


def strongest(runs: str = "runs"):
    """The run of the greatest length / period; of equal ones that of the smallest start, then period; null without runs."""
    nearer = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"])
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, run: F.when(nearer(run, best), run).otherwise(best))
