"""Exact order statistics of whole columns without shuffling their values.

A mergeable sketch first brackets every wanted rank between two values of the
column. Where a bracket still holds many rows, further rounds sketch only the
rows inside it. One last pass counts, for every column, the rows at and between
all brackets' ends and hands on the values inside the brackets, which are few by
then. Ranks come from those counts, so the sketch only decides where to look: a
rank that it missed is looked for again where the counts say it lies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
HELD_ROWS = 2_000
GRID = 200


@dataclass(frozen=True)
class Between:
    """The order statistics around a quantile, and how far it lies from the lower to the upper one."""

    low: float
    high: float
    part: float

    @property
    def value(self) -> float:
        return self.low + (self.high - self.low) * self.part if self.part else self.low


@dataclass
class _Bracket:
    """Values between which a rank of a column lies, about how many rows lie between, and how often it was missed."""

    column: str
    rank: int
    low: float
    high: float
    rows: float
    missed: int = 0


def _narrow(df: DataFrame, brackets: Sequence[_Bracket], accuracy: int) -> None:
    """One round: a finer bracket for each, from a sketch of the rows strictly inside."""
    marks = [i / GRID for i in range(GRID + 1)]
    asked = []
    for i, b in enumerate(brackets):
        inside = (F.col(b.column) > F.lit(b.low)) & (F.col(b.column) < F.lit(b.high))
        asked += [F.count_if(F.col(b.column) <= F.lit(b.low)).alias(f"below{i}"), F.count_if(inside).alias(f"n{i}"),
                  F.percentile_approx(F.when(inside, F.col(b.column)), marks, accuracy).alias(f"marks{i}")]
    found = df.agg(*asked).first()
    for i, b in enumerate(brackets):
        below, n, values = found[f"below{i}"], found[f"n{i}"], found[f"marks{i}"]
        b.rows = 0.0
        if not n:
            continue
        slack = 2.0 ** (1 + b.missed) / accuracy
        # An end moves inwards unless the rank lies on it: at least one of them does, so rounds come to an end.
        start = min(GRID, math.floor(((b.rank - below) / n - slack) * GRID)) if b.rank >= below else -1
        stop = max(0, math.ceil(((b.rank - below) / n + slack) * GRID)) if b.rank < below + n else GRID + 1
        b.rows = n * (max(0, min(stop, GRID) - max(start, 0)) / GRID + 2.0 * slack)
        b.low, b.high = values[start] if start >= 0 else b.low, values[stop] if stop <= GRID else b.high


def _place(value: Column, ends: Sequence[float]) -> Column:
    """2i for values between the ends i - 1 and i, 2i + 1 for values equal to end i."""
    def among(first: int, last: int) -> Column:  # a search by halves
        if first == last:
            return F.lit(2 * first)
        at = (first + last) // 2
        end = F.lit(ends[at])
        return F.when(value < end, among(first, at)).when(value > end, among(at + 1, last)).otherwise(F.lit(2 * at + 1))

    return among(0, len(ends))


def _pick(df: DataFrame, brackets: Sequence[_Bracket]) -> dict[tuple[str, int], float] | None:
    """(column, rank) -> value from one pass; a bracket that missed its ranks is moved and the answer is None."""
    ends: dict[str, list[float]] = {}
    for b in brackets:
        ends.setdefault(b.column, []).extend((b.low, b.high))
    ends = {c: sorted(set(e)) for c, e in ends.items()}
    open_at = {c: {2 * i for i in range(1, len(e)) if any(
        b.column == c and b.low <= e[i - 1] and e[i] <= b.high for b in brackets)} for c, e in ends.items()}
    names = list(ends)

    def cell(at: int, c: str) -> Column:
        place = F.col(f"_place{at}")
        held = F.when(place.isin(*open_at[c]), F.col(c)) if open_at[c] else F.lit(None).cast("double")
        return F.struct(F.lit(at).alias("column"), place.alias("place"), held.alias("value"))

    # A place is a long expression: it is worked out once, below the cells that use it.
    placed = df.select(*names, *[F.when(F.col(c).isNotNull(), _place(F.col(c), ends[c])).alias(f"_place{i}") for i, c in enumerate(names)])
    cells = placed.select(F.explode(F.array(*[cell(i, c) for i, c in enumerate(names)])).alias("c")).select("c.*")
    found = cells.where("place IS NOT NULL").groupBy("column", "place", "value").agg(F.count(F.lit(1)).alias("n"))
    counted: dict[str, list[tuple[int, float | None, int]]] = {c: [] for c in names}
    for r in found.collect():  # places, and the few values inside the brackets
        counted[names[r["column"]]].append((r["place"], r["value"], r["n"]))
    values, missed = {}, False
    for b in brackets:
        rows = sorted(counted[b.column], key=lambda x: (x[0], x[1] or 0.0))
        before = 0
        for place, value, n in rows:
            if b.rank < before + n:
                break
            before += n
        if place % 2:
            value = ends[b.column][place // 2]
        if value is None:  # outside all brackets: between two ends, or beyond the outermost
            around = [-math.inf, *ends[b.column], math.inf]
            b.low, b.high, b.rows, b.missed, missed = around[place // 2], around[place // 2 + 1], float(n), b.missed + 1, True
        values[b.column, b.rank] = value
    return None if missed else values


def order_statistics(df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY,
                     held_rows: int = HELD_ROWS) -> dict[str, list[Between] | None]:
    """For every column the exact order statistics around each quantile; None without values. NaN is no value."""
    names = list(dict.fromkeys(columns))
    if not names:
        return {}
    rows = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in names])
    slack = 2.0 / accuracy
    marks = [min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)]
    first = rows.agg(*[x for i, c in enumerate(names) for x in (
        F.count(c).alias(f"n{i}"), F.percentile_approx(c, marks, accuracy).alias(f"q{i}"))]).first()
    brackets: dict[tuple[str, int], _Bracket] = {}
    for i, c in enumerate(names):
        n = first[f"n{i}"]
        for j, p in enumerate(probs if n else ()):
            for rank in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
                brackets[c, rank] = _Bracket(c, rank, first[f"q{i}"][2 * j], first[f"q{i}"][2 * j + 1], 6.0 * n / accuracy)
    values: dict[tuple[str, int], float] | None = None if brackets else {}
    while values is None:
        wide = [b for b in brackets.values() if b.rows > held_rows and b.low < b.high]
        if wide:
            _narrow(rows, wide, accuracy)
        else:
            values = _pick(rows, list(brackets.values()))
    out: dict[str, list[Between] | None] = {}
    for i, c in enumerate(names):
        n = first[f"n{i}"]
        out[c] = [Between(values[c, math.floor(p * (n - 1))], values[c, math.ceil(p * (n - 1))], p * (n - 1) - math.floor(p * (n - 1)))
                  for p in probs] if n else None
    return out
