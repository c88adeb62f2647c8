"""Moments of average ranks where columns have many distinct values, without a join of rows.

Rows are written as blocks. A block holds, for each of its rows that is complete, which value the columns with few
distinct ones have; of every other column it holds the values, dealt by slices of that column, and the places of their
rows. One task ranks one slice and hands each block its ranks; one task puts a block together again. A value frequent
enough to fill a slice is not sent: counts of the slices give its rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import portable, stored

portable(__name__)

BLOCK = 1 << 16
MAX_SLICES = 1024
SAMPLE_PER_SLICE = 100
#: A block's rows as `column` -1, and the cells of one column and slice; a frequent value has the slice -1 - cut, NaN
#: that after all cuts.
CELLS = "block bigint, column int, slice int, n bigint, places binary, data binary"


@dataclass(frozen=True)
class Cuts:
    """Where the slices of a column begin, and which of these values are frequent."""

    at: np.ndarray
    hot: np.ndarray


def cuts_of(rows: DataFrame, columns: Sequence[str], total: int, slice_rows: int) -> list[Cuts]:
    """From a sample, which decides no result: slices of about `slice_rows` rows, and values that may fill half of one."""
    parts = min(MAX_SLICES, -(-total // slice_rows))
    if parts <= 1:
        return [Cuts(np.zeros(0), np.zeros(0, dtype=bool)) for _ in columns]
    # At most MAX_SLICES * SAMPLE_PER_SLICE rows are expected here, however large the table.
    seen = rows.select(*columns).sample(fraction=min(1.0, SAMPLE_PER_SLICE * parts / total), seed=parts).toPandas()
    out = []
    for c in columns:
        values = seen[c].to_numpy(dtype=float)
        values = np.sort(values[~np.isnan(values)]) + 0.0
        different, times = np.unique(values, return_counts=True)
        frequent = different[times * (total / max(len(seen), 1)) > max(slice_rows / 2, 1)]
        among = values[np.arange(1, parts) * len(values) // parts] if len(values) else values
        at = np.union1d(among, frequent)
        out.append(Cuts(at, np.isin(at, frequent)))
    return out


def _cells(rows: DataFrame, few: dict[int, np.ndarray], many: Sequence[int], cuts: Sequence[Cuts], width: int) -> DataFrame:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            found: list[tuple] = []
            columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(width)]
            known = [np.concatenate([b.column(i).is_valid().to_numpy(zero_copy_only=False) for b in held]) for i in range(width)]
            whole = np.logical_and.reduce(known)
            place = np.where(whole, np.cumsum(whole) - 1, -1).astype(np.int32)
            codes = [np.searchsorted(values, columns[i][whole]).astype(np.int32) for i, values in few.items()]
            found.append((-1, 0, int(whole.sum()), b"", b"".join(c.tobytes() for c in codes)))
            for i, c in zip(many, cuts):
                values, at = columns[i][known[i]], place[known[i]]
                odd = np.isnan(values)
                if odd.any():
                    found.append((i, -2 - len(c.at), int(odd.sum()), at[odd & (at >= 0)].tobytes(), b""))
                    values, at = values[~odd], at[~odd]
                part = np.searchsorted(c.at, values, side="right").astype(np.int16)
                if c.hot.any():
                    cut = np.maximum(part - 1, 0)
                    hot = (part > 0) & c.hot[cut] & (values == c.at[cut])
                    for s in np.unique(cut[hot]).tolist():
                        here = at[hot & (cut == s)]
                        found.append((i, -1 - s, len(here), here[here >= 0].tobytes(), b""))
                    values, at, part = values[~hot], at[~hot], part[~hot]
                order = np.argsort(part, kind="stable")
                values, at, part = values[order], at[order], part[order]
                slices, starts = np.unique(part, return_index=True)
                for s, a, b in zip(slices.tolist(), starts.tolist(), [*starts.tolist()[1:], len(part)]):
                    found.append((i, s, b - a, at[a:b].tobytes(), values[a:b].tobytes()))
            column, part, n, places, data = zip(*found)
            return pa.RecordBatch.from_arrays(
                [pa.array([first + number] * len(found), pa.int64()), pa.array(column, pa.int32()), pa.array(part, pa.int32()),
                 pa.array(n, pa.int64()), pa.array(places, pa.binary()), pa.array(data, pa.binary())],
                names=["block", "column", "slice", "n", "places", "data"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield block()
                held, number = [], number + 1
        if sum(b.num_rows for b in held):
            yield block()

    return rows.mapInArrow(blocks, CELLS)


@dataclass(frozen=True)
class Packed:
    """Rows as stored blocks, and what counts of the slices say of each column.

    `before` has the values that come before a slice's own, `sizes` how many it has. A frequent value (`hot`, by its own
    slice) comes before the others of its slice; NaN is the last value.
    """

    names: list[str]
    few: dict[int, np.ndarray]
    cuts: dict[int, Cuts]
    cells: DataFrame
    sizes: dict[tuple[int, int], int]
    before: dict[tuple[int, int], int]
    hot: dict[tuple[int, int], float]

    def quantiles(self, column: str, probs: Sequence[float]) -> list[float | None]:
        """Exact, as `narrowing.order_statistics` finds them; only the slices that hold the ranks are read. NaN is no value."""
        i = self.names.index(column)
        at, slices = self.cuts[i].at, range(len(self.cuts[i].at) + 1)
        total = self.before[i, slices[-1]] + self.sizes.get((i, slices[-1]), 0)
        if not total:
            return [None] * len(probs)
        places = [p * (total - 1) for p in probs]
        found: dict[int, float] = {}
        inside: dict[int, list[int]] = {}
        for r in {f(x) for x in places for f in (math.floor, math.ceil)}:
            s = next(s for s in slices if r < self.before[i, s] + self.sizes.get((i, s), 0))
            if r < self.before[i, s]:
                found[r] = float(at[s - 1])
            else:
                inside.setdefault(s, []).append(r)
        before = {s: self.before[i, s] for s in inside}

        def pick(key: tuple, table: pa.Table) -> pa.Table:
            s = key[0].as_py()
            values = np.sort(np.concatenate([np.frombuffer(d) for d in table.column("data").to_pylist()]))
            return pa.table({"rank": pa.array(inside[s], pa.int64()), "value": values[np.array(inside[s]) - before[s]]})

        if inside:
            held = self.cells.filter((F.col("column") == i) & F.col("slice").isin(*inside)).select("slice", "data")
            found |= {r["rank"]: r["value"] for r in held.groupBy("slice").applyInArrow(pick, "rank bigint, value double").collect()}
        out = []
        for x in places:
            low, high, part = found[math.floor(x)], found[math.ceil(x)], x - math.floor(x)
            out.append(low + (high - low) * part if part else low)
        return out


def pack(rows: DataFrame, names: Sequence[str], few: dict[str, np.ndarray], total: int, slice_rows: int) -> Packed:
    """The named double columns of `rows`; `few` has the values of those with few distinct ones."""
    many = [i for i, c in enumerate(names) if c not in few]
    cuts = dict(zip(many, cuts_of(rows, [names[i] for i in many], total, slice_rows)))
    codes = {i: few[c] for i, c in enumerate(names) if c in few}
    cells = stored(_cells(rows, codes, many, list(cuts.values()), len(names)), "ranks")
    sizes = {(r["column"], r["slice"]): r["n"] for r in
             cells.filter("column >= 0").groupBy("column", "slice").agg(F.sum("n").alias("n")).collect()}  # a few numbers a slice
    before: dict[tuple[int, int], int] = {}
    hot: dict[tuple[int, int], float] = {}
    for i, c in cuts.items():
        upto = 0
        for s in range(len(c.at) + 1):
            frequent = sizes.get((i, -s), 0) if s else 0
            if frequent:
                hot[i, -s] = upto + (frequent + 1) / 2
            before[i, s] = upto + frequent
            upto = before[i, s] + sizes.get((i, s), 0)
        hot[i, -2 - len(c.at)] = upto + (sizes.get((i, -2 - len(c.at)), 0) + 1) / 2
    return Packed(list(names), codes, cuts, cells, sizes, before, hot)


def rank_products(packed: Packed, ranks: dict[str, np.ndarray], origin: float) -> np.ndarray:
    """Sums of products of one and all ranks less `origin`, over the rows where every column has a value.

    `ranks` has those of the columns with few distinct values.
    """
    k, few, cells, before, hot = len(packed.names), list(packed.few), packed.cells, packed.before, packed.hot
    known = [ranks[packed.names[i]] for i in few]

    def rank(key: tuple, table: pa.Table) -> pa.Table:
        column, part = key[0].as_py(), key[1].as_py()
        values = np.concatenate([np.frombuffer(d) for d in table.column("data").to_pylist()])
        order = np.argsort(values)
        values = values[order]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        times = np.diff(np.append(starts, len(values)))
        found = np.empty(len(values))
        found[order] = np.repeat(before[column, part] + starts + (times + 1) / 2, times)
        blocks, places, data, at = [], [], [], 0
        for b, p in zip(table.column("block").to_pylist(), table.column("places").to_pylist()):
            place = np.frombuffer(p, dtype=np.int32)
            wanted = place >= 0
            blocks.append(b)
            places.append(place[wanted].tobytes())
            data.append(found[at:at + len(place)][wanted].tobytes())
            at += len(place)
        n = len(blocks)
        return pa.table({"block": pa.array(blocks, pa.int64()), "column": pa.array([column] * n, pa.int32()), "slice": pa.array([part] * n, pa.int32()),
                         "n": pa.array([0] * n, pa.int64()), "places": pa.array(places, pa.binary()), "data": pa.array(data, pa.binary())})

    def products(key: tuple, table: pa.Table) -> pa.Table:
        found = list(zip(*[table.column(c).to_pylist() for c in ("column", "slice", "n", "places", "data")]))
        n, codes = next((f[2], f[4]) for f in found if f[0] < 0)
        x = np.ones((k + 1, n))
        codes = np.frombuffer(codes, dtype=np.int32).reshape(len(few), n)
        for at, r, code in zip(few, known, codes):
            x[at + 1] = r[code] - origin
        for column, part, _, places, data in found:
            if column >= 0:
                place = np.frombuffer(places, dtype=np.int32)
                x[column + 1, place] = (hot[column, part] if part < 0 else np.frombuffer(data)) - origin
        total = x @ x.T
        return pa.table({"at": pa.array(np.arange(total.size)), "v": pa.array(total.ravel())})

    ranked = (cells.filter("column >= 0 AND slice >= 0").groupBy("column", "slice").applyInArrow(rank, CELLS)
              .unionByName(cells.filter("column < 0 OR slice < 0")))
    sums = (ranked.groupBy("block").applyInArrow(products, "at bigint, v double")
            .groupBy("at").agg(F.sum("v").alias("v")).collect())
    full = np.zeros((k + 1) ** 2)
    for cell in sums:
        full[cell["at"]] = cell["v"]
    return full.reshape(k + 1, k + 1)
