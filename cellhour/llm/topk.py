"""Exact top-k inner products on a bit-sliced index.

Vectors become whole numbers, floor(scale * x). A block of candidates keeps, for
each dimension, the bits of its values (less the block's least value) as
bitmaps over its rows. A query's score is a sum of those bitmaps at shifted
weights, for a negative factor of their complements; bitmaps of one weight are added by
carry-save steps until each weight has one, which is the sliced sum. The index
holds the upper slices only. From the most significant slice of the sum
downward, rows are taken that must be among the best; rows that the dropped lower
bits could lift to the boundary are scored exactly.

Candidates go in blocks against queries in blocks, each pair of blocks once.

Defined results: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows with a null id; vectors are compared with those of
their own length; empty vectors score 0; rows that repeat an id are candidates
one by one, and the query's own id is no candidate; ties go to the smaller id;
other columns are not read. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

ROWS_PER_BLOCK = 8_192
QUERIES_PER_BLOCK = 256
DROPPED_BITS = 2
U64 = np.uint64


def quantised(df: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(id, length, values) of the vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).where(~bad).select(
        F.col(id_column).cast("long").alias("id"), F.size(vector).alias("length"),
        F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("values"))


def narrowed(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest of three widths."""
    for kind in (np.int16, np.int32):
        if values.size and np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max:
            return values.astype(kind)
    return values


def widened(raw: bytes, rows: int, length: int) -> np.ndarray:
    width = len(raw) // max(1, rows * length)
    kind = {2: np.int16, 4: np.int32}.get(width, np.int64)
    return np.frombuffer(raw, kind).astype(np.int64).reshape(rows, length)


def blocks(vectors: DataFrame, prefix: str, rows: int) -> DataFrame:
    """One row per block of about `rows` vectors of one length: ids and values as arrays in binary."""
    sizes = {r["length"]: -(-r["count"] // rows) for r in vectors.groupBy("length").count().collect()}
    if not sizes:
        sizes = {0: 1}
    parts = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("length")]
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id", F.lit(prefix)), parts).cast("int"))

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        values = np.array(group["values"].tolist(), dtype=np.int64).reshape(len(group), -1)
        return pd.DataFrame({"length": group["length"].iloc[:1], "block": group["block"].iloc[:1],
                             "ids": [group["id"].to_numpy(np.int64).tobytes()], "values": [narrowed(values).tobytes()]})

    kind = "length int, block int, ids binary, values binary"
    made = dealt.groupBy("length", "block").applyInPandas(gather, kind)
    return made.withColumnsRenamed({c: f"{prefix}_{c}" for c in ("block", "ids", "values")})


class SlicedBlock:
    """The upper bits of a block's values, as bitmaps over its rows."""

    def __init__(self, values: np.ndarray, dropped: int = DROPPED_BITS):
        self.values, self.n = values, len(values)
        self.low = values.min(axis=0, initial=0) if self.n else np.zeros(values.shape[1], np.int64)
        above = values - self.low
        self.dropped = min(dropped, max(0, int(above.max(initial=0)).bit_length() - 1))
        self.bits = max(1, int(above.max(initial=0)).bit_length() - self.dropped)
        words = -(-max(1, self.n) // 64)
        upper = above >> self.dropped
        lanes = [np.packbits(np.pad(((upper >> b) & 1).astype(np.uint8), ((0, words * 64 - self.n), (0, 0))).T,
                             axis=1, bitorder="little") for b in range(self.bits)]
        straight = np.ascontiguousarray(np.stack(lanes, axis=1)).view(U64)
        self.slices = np.stack([straight, ~straight])  # sign of the factor, dimension, bit, rows
        live = np.packbits(np.arange(words * 64) < self.n, bitorder="little").view(U64)
        self.live = live

    def sum_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices, least first, of the sum over dimensions of |q| times the upper bits, or their complement; what the sum lacks."""
        factor = np.abs(query)
        sign = (query < 0).astype(np.int64)
        top = (1 << self.bits) - 1
        # For q < 0: q * u = |q| * (top - u) - |q| * top.
        constant = int((query * self.low).sum()) - (int((factor * sign).sum()) * top << self.dropped)
        at_weight: dict[int, list[np.ndarray]] = {}
        for a in range(int(factor.max(initial=0)).bit_length()):
            used = np.flatnonzero((factor >> a) & 1)
            if len(used):
                for b in range(self.bits):
                    at_weight.setdefault(a + b, []).append(self.slices[sign[used], used, b])
        out, weight, carried = [], 0, []
        while weight <= max(at_weight, default=-1) or carried:
            maps = at_weight.get(weight, []) + carried
            carried = []
            rows = np.concatenate(maps) if maps else np.zeros((0, len(self.live)), U64)
            while len(rows) > 2:  # three bitmaps become their sum and a carry of twice the weight
                n = len(rows) // 3
                x, y, z = rows[:n], rows[n:2 * n], rows[2 * n:3 * n]
                half = x ^ y
                carried.append((x & y) | (half & z))
                rows = np.concatenate([half ^ z, rows[3 * n:]])
            if len(rows) == 2:
                carried.append((rows[0] & rows[1])[None])
                rows = rows[:1] ^ rows[1:]
            out.append(rows[0] if len(rows) else np.zeros(len(self.live), U64))
            weight += 1
        return out, constant

    def best(self, query: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        """Rows among which the k best of the allowed rows lie: those that may reach the k-th."""
        slices, _ = self.sum_slices(query)
        count = lambda m: int(np.bitwise_count(m).sum())
        # What the dropped bits can add to a row, at least and at most, in units of the sum.
        rest = (1 << self.dropped) - 1
        slack = -(-int(np.abs(query).sum()) * rest >> self.dropped) + 1
        sure, tied, value = np.zeros_like(allowed), allowed, 0
        need = min(k, count(allowed))
        for weight in range(len(slices) - 1, -1, -1):  # the k-th largest sum, from the most significant slice down
            ones = sure | (tied & slices[weight])
            if count(ones) >= need:
                tied, value = tied & slices[weight], value | (1 << weight)
            else:
                sure, tied = ones, tied & ~slices[weight]
        # Rows at or above that sum, and those that the slack lifts to it.
        return self.at_least(slices, max(0, value - slack)) & allowed

    @staticmethod
    def at_least(slices: list[np.ndarray], value: int) -> np.ndarray:
        above, equal = np.zeros_like(slices[0]) if slices else np.zeros(0, U64), None
        equal = ~above
        for weight in range(len(slices) - 1, -1, -1):
            if value >> weight & 1:
                equal = equal & slices[weight]
            else:
                above = above | (equal & slices[weight])
                equal = equal & ~slices[weight]
        return above | equal


def _search(k: int):
    def pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                ids = np.frombuffer(row.c_ids, np.int64)
                queries = np.frombuffer(row.q_ids, np.int64)
                values = widened(row.c_values, len(ids), row.length)
                asked = widened(row.q_values, len(queries), row.length)
                block = SlicedBlock(values)
                out: list[tuple[np.ndarray, ...]] = []
                for query, vector in zip(queries, asked):
                    allowed = block.live
                    own = np.flatnonzero(ids == query)
                    if len(own):
                        allowed = allowed.copy()
                        for i in own:
                            allowed[i // 64] &= ~(U64(1) << U64(i % 64))
                    found = block.best(vector, allowed, k) if row.length else allowed
                    near = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
                    score = values[near] @ vector
                    kept = np.lexsort((ids[near], -score))[:k]
                    out.append((np.full(len(kept), query), ids[near][kept], score[kept]))
                if out:
                    q, c, s = (np.concatenate(x) for x in zip(*out))
                    yield pd.DataFrame({"query_id": q, "vec_id": c, "score": s})
    return pairs


def search(vectors: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the largest score for every query."""
    candidates = stored(blocks(quantised(vectors, id_column, vector, scale), "c", ROWS_PER_BLOCK), "candidates")
    asked = stored(blocks(quantised(queries, id_column, vector, scale), "q", QUERIES_PER_BLOCK), "queries")
    numbers = lambda df, p: df.select("length", f"{p}_block")
    # Every pair of block numbers of one length, then each side's block by its number.
    pairs = numbers(candidates, "c").join(numbers(asked, "q"), "length")
    met = (pairs.join(candidates, ["length", "c_block"]).join(asked, ["length", "q_block"])
           .repartition("length", "c_block", "q_block"))
    near = met.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
