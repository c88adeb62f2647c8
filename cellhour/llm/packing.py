"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are tokenised once, to a small table of pieces. Pieces shorter than a
sequence are dealt to shards of bounded size. Every shard evolves on several
islands: a crossover puts whole well-filled sequences of one packing into
another, drops the sequences that hold the same pieces, and best-fits what that
displaced. Between epochs each island's elite packing moves to the next island.
The best island's well-filled sequences are final, or its fullest with half of all
pieces where few are well filled; what lies in the others is dealt anew to fewer
shards, until one shard is left.

Defined results: a null text is empty, so one end token; rows that repeat a
doc_id or text are packed one by one; a null doc_id stays null; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .text import BYTE_CLASS, WHITE, class_runs, lower_hashes, slices

CAPACITY = 4096
END = 1
PER_SHARD = 8_192
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
GENERATIONS = 12
WELL_FILLED = 0.99
#: Words that a worker keeps before it starts anew.
CACHED = 1_000_000
PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of whole slices of text; a worker keeps those of the words it has seen.

    The vocabulary cuts a text into words: runs of letters in any case, single
    digits, runs of other signs. Most texts hold only ASCII and Latin-1 letters,
    where byte classes find those words; each different word then goes to the
    library once. All other texts go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole, self.word = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.word.normalizer = None
        self.word.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.codes, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # sorted hashes, their words
        self.ids, self.begin, self.size = np.zeros(1 << 20, dtype="<u4"), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.used = 0

    def learn(self, codes: np.ndarray, words: list[str]) -> None:
        """Append the words' ids; the last token of each word closes it."""
        ids = np.array(self.word.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        n, first = len(words), len(self.codes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + n > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        begins = np.append(0, ends[:-1])
        self.ids[self.used:self.used + len(ids)] = ids
        self.begin[first:first + n], self.size[first:first + n] = self.used + begins, ends - begins
        self.used += len(ids)
        both = np.concatenate([self.codes, codes])
        order = np.argsort(both, kind="stable")
        self.codes, self.number = both[order], np.append(self.number, np.arange(first, first + n))[order]

    def look_up(self, codes: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for those not seen."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.number[at], -1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each document of a slice."""
        starts, ends, kind, doc = class_runs(data, offsets)
        digits = np.flatnonzero(kind == 2)
        if len(digits):  # a digit is a word of its own
            n = np.ones(len(starts), dtype=np.int64)
            n[digits] = ends[digits] - starts[digits]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            single = np.repeat(kind == 2, n)
            starts, ends, doc = np.repeat(starts, n) + step * single, np.repeat(ends, n), np.repeat(doc, n)
            ends = np.where(single, starts + 1, ends)
        codes, at, inverse = np.unique(lower_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.codes) > CACHED:
            self.forget()
        odd = self.odd(data, offsets)
        raw = data.tobytes()
        fresh = np.flatnonzero((self.look_up(codes) < 0) & ~odd[doc[at]])
        if len(fresh):
            spans = zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist())
            self.learn(codes[fresh], [raw[a:b].decode().lower() for a, b in spans])
        index = self.look_up(codes)[inverse]
        missing = index < 0  # first seen in an odd document, but perhaps also in another
        if missing.any():
            odd = odd | (np.bincount(doc[missing], minlength=len(odd)) > 0)
            index[missing] = 0
        size = self.size[index] if len(self.codes) else np.zeros(len(index), np.int64)
        stop = np.cumsum(size)
        spots = np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.begin[index] - stop + size, size)
        flat, cut = self.ids[spots], np.append(0, stop)[np.searchsorted(doc, np.arange(len(offsets)))]
        out = [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]
        strange = np.flatnonzero(odd)
        texts = [raw[offsets[i]:offsets[i + 1]].decode() for i in strange]
        for i, coded in zip(strange, self.whole.encode_batch_fast(texts, add_special_tokens=False)):
            out[i] = np.array(coded.ids, dtype="<u4")
        return out

    @staticmethod
    def odd(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents with anything but plain words: other letters, control bytes, the marks of special tokens, contractions."""
        after = np.append(data[1:], 0)
        strange = (data >= 0xC0) & ((data != 0xC3) | (after == 0x97) | (after == 0xB7))
        strange |= (data < 0x20) & ~WHITE[data]
        strange |= (data == ord("<")) & (after == ord("|"))
        strange |= (data == ord("'")) & (BYTE_CLASS[after] == 1)
        at = np.flatnonzero(strange)
        return np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=len(offsets) - 1) > 0


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, cut only where it is longer than `capacity`.

    With `ids`, also the piece's token ids as little-endian 32-bit numbers.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for first, _, data, offsets in slices(batch):
                out: list[tuple] = []
                for row, coded in enumerate(_encoders[path].encode(data, offsets), first):
                    raw = np.append(coded, np.uint32(END)).astype("<u4").tobytes()
                    for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                        held = raw[at:at + 4 * capacity]
                        out.append((numbers[row], i, at // 4, len(held) // 4, zlib.crc32(held)) + (held,) * ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, PIECE.removeprefix("uid long, ") + ", ids binary" * ids)


class Packing:
    """Sequences as lists of items, filled best-fit."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []
        self.free = [capacity - sum(sizes[i] for i in b) for b in self.bins]
        self.by_free = sorted((f, k) for k, f in enumerate(self.free))

    def put(self, items: list[int]) -> Packing:
        for i in items:
            at = bisect_left(self.by_free, (self.sizes[i], -1))
            if at < len(self.by_free):
                free, k = self.by_free.pop(at)
                self.bins[k].append(i)
            else:
                free, k = self.capacity, len(self.bins)
                self.bins.append([i])
                self.free.append(self.capacity)
            self.free[k] = free - self.sizes[i]
            insort(self.by_free, (self.free[k], k))
        return self

    def worth(self) -> tuple[int, float]:
        """Fewer sequences first, then uneven filling, which leaves room for more."""
        return len(self.bins), -sum((1 - f / self.capacity) ** 2 for f in self.free)


def crossed(to: Packing, source: Packing, rng: np.random.Generator) -> Packing:
    """`to` with some whole well-filled sequences of `source`; displaced items are best-fitted, longest first."""
    good = [k for k, f in enumerate(source.free) if f <= (1 - WELL_FILLED) * source.capacity]
    if not good:
        good = sorted(range(len(source.bins)), key=source.free.__getitem__)[:1]
    taken = rng.choice(len(good), size=max(1, len(good) // 3), replace=False)
    injected = [list(source.bins[good[k]]) for k in taken]
    moved = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in to.bins:
        if moved.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in moved]
    displaced.sort(key=to.sizes.__getitem__, reverse=True)
    return Packing(to.sizes, to.capacity, kept + injected).put(displaced)


def evolved(sizes: list[int], start: list[Packing], capacity: int, seed: int) -> Packing:
    """The best packing after some generations; at once where no packing can be smaller."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(sizes) // capacity)
    falling = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    people = list(start) or [Packing(sizes, capacity).put(falling)]
    if min(p.worth() for p in people)[0] > bound:
        while len(people) < POPULATION:
            noisy = np.asarray(sizes) * rng.uniform(0.8, 1.0, len(sizes))
            people.append(Packing(sizes, capacity).put(np.argsort(-noisy).tolist()))
        for _ in range(GENERATIONS):
            people.sort(key=Packing.worth)
            if len(people[0].bins) <= bound:
                break
            a, b = rng.choice(max(2, len(people) // 2), size=2, replace=False)
            people[-2:] = [crossed(people[a], people[b], rng), crossed(people[b], people[a], rng)]
    return min(people, key=Packing.worth)


def _epoch(capacity: int, turn: int):
    def island(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["origin", "uid"], kind="stable")
        one = rows[rows["origin"] == rows["origin"].iloc[0]].reset_index(drop=True)
        sizes = one["length"].tolist()
        start = []
        if turn:
            for _, own in rows.groupby("origin"):
                bins: dict[int, list[int]] = {}
                for i, b in enumerate(own["bin"].tolist()):
                    bins.setdefault(b, []).append(i)
                start.append(Packing(sizes, capacity, list(bins.values())))
        seed = int(rows["shard"].iloc[0]) * 1000 + int(rows["island"].iloc[0]) * 10 + turn
        best = evolved(sizes, start, capacity, seed)
        place = np.empty((len(sizes), 3), dtype=np.int64)
        for k, b in enumerate(best.bins):
            at = 0
            for i in b:
                place[i] = k, at, capacity - best.free[k]
                at += sizes[i]
        one["bin"], one["offset"], one["fill"] = place[:, 0], place[:, 1], place[:, 2]
        return one.assign(bins=len(best.bins), origin=one["island"])
    return island


def final_level(pieces: dict[int, int], capacity: int) -> tuple[float, int]:
    """Least fill of the sequences that are final, and how many pieces lie in others, by the pieces of each fill.

    Where most pieces lie in sequences that are not well filled, the fullest with half of all pieces are final:
    the rest halves at least, so surpluses of different shards meet in fewer shards until one holds them all.
    """
    level, half = WELL_FILLED * capacity, sum(pieces.values()) / 2
    n_well = sum(n for fill, n in pieces.items() if fill >= level)
    if n_well < half:
        n_well = 0
        for fill in sorted(pieces, reverse=True):
            level, n_well = fill, n_well + pieces[fill]
            if n_well >= half:
                break
    return level, sum(pieces.values()) - n_well


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset, in as few sequences as the search finds."""
    columns = [c for c in pieces.columns]
    pieces = stored(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") >= capacity).select(
        *columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, left, turn = [full], pieces.where(F.col("length") < capacity), 0
    grouped = PIECE + ", shard long, island int, origin int, bin long, offset long, fill long, bins long"
    n = left.count()
    while n:
        shards = -(-n // PER_SHARD)
        none = F.lit(0).cast("long")
        dealt = (left.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(shards)))
                 .withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
                 .withColumn("origin", F.lit(0)).withColumn("bin", none).withColumn("offset", none)
                 .withColumn("fill", none).withColumn("bins", none))
        names = [c.split()[0] for c in grouped.split(", ")]
        for epoch in range(EPOCHS):
            if epoch:  # every island's elite also goes to the next one
                dealt = dealt.withColumn("island", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)))
            dealt = dealt.select(*names).groupBy("shard", "island").applyInPandas(_epoch(capacity, epoch), grouped)
        dealt = stored(dealt, "packings")
        best = dealt.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("best")).select("shard", "best.island")
        chosen = dealt.join(best, ["shard", "island"])
        level, n_rest = final_level({r["fill"]: r["count"] for r in chosen.groupBy("fill").count().collect()}, capacity)
        well = F.col("fill") >= level
        rest = chosen.where(~well)
        last = shards == 1
        final = chosen if last else chosen.where(well)
        done.append(final.select(*columns, ((F.lit(turn) * (1 << 56)) + F.col("shard") * (1 << 20) + F.col("bin"))
                                 .cast("long").alias("sequence_id"), "offset"))
        left, n, turn = rest.select("uid", *columns), 0 if last else n_rest, turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents, tokenised with the vocabulary file at `path` and packed."""
    return packed(token_pieces(docs, path, capacity), capacity)
