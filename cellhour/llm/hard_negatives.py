"""Hard negatives of anchors: the best rows of another label that score just below a positive.

Vectors become whole numbers, floor(scale * x); a row's score is its integer
inner product with the anchor. An anchor's positives are its best rows of the
same label. Each positive asks for the best rows of another label in a window of
scores, from `floor_percent` of its own score up to that score. The positives'
scores, as upper limits, cut the scores below the highest into disjoint slots, so
one pass over the rows answers all overlapping windows: every task keeps, for an
anchor, the top k of each slot; the tops of one slot from all tasks merge to its
top k; and the top k of a window are those of its own slot merged with the slots
below, in descending order, down to the window's floor.

Anchors in blocks meet stripes of candidate blocks. A task holds one block of
anchors and walks a stripe's blocks past it; scores below what an anchor already
has k of are dropped on sight. Nothing is grouped by label, so a label that holds
a third of all rows makes no task larger, and a task hands on at most k rows for
each anchor and slot, whatever the stripe holds.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component take no part; vectors meet those of their own length; a row
never meets rows of its own id; anchors that repeat an id are anchors one by one,
each with its own rows; candidates that repeat an id count one by one; ties go to
the smaller id; a positive below zero has an empty window; an anchor without
positives or a positive without negatives has no rows; other columns are not
read. A hundred times a score must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .topk import narrowed, widened

ANCHORS_PER_BLOCK = 2_048
ROWS_PER_BLOCK = 4_096
BLOCKS_PER_STRIPE = 64
ANCHORS_AT_ONCE = 256
LOWEST = np.iinfo(np.int64).min


def usable(df: DataFrame, id_column: str, label: str, vector: str, scale: int) -> DataFrame:
    """(id, label, length, values) of the rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(~bad).select(
        F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.size(vector).alias("length"),
        F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("values"))


def in_blocks(rows: DataFrame, rows_per_block: int, key: str) -> DataFrame:
    """One row per block of about `rows_per_block` rows of one vector length: each column as an array in binary, by `key`."""
    sizes = {r["length"]: -(-r["count"] // rows_per_block) for r in rows.groupBy("length").count().collect()} or {0: 1}
    parts = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("length")]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(key), parts).cast("int"))
    columns = [c for c in rows.columns if c != "length"]

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, kind="stable")
        made = {c: np.array(group[c].tolist(), dtype=np.int64).reshape(len(group), -1) for c in columns}
        return pd.DataFrame({"length": group["length"].iloc[:1], "block": group["block"].iloc[:1],
                             **{c: [(narrowed(x) if c == "values" else x).tobytes()] for c, x in made.items()}})

    held = ", ".join(f"{c} binary" for c in columns)
    return dealt.groupBy("length", "block").applyInPandas(gather, f"length int, block int, {held}")


def met(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every block of anchors beside every block of candidates of its vector length, a task for each stripe of them.

    Stripes are as wide as a task may be long, but leave work for all cores.
    """
    ours = anchors.withColumnsRenamed({c: f"a_{c}" for c in anchors.columns if c != "length"})
    theirs = candidates.withColumnsRenamed({c: f"c_{c}" for c in candidates.columns if c != "length"})
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    wide = min(BLOCKS_PER_STRIPE, max(1, anchors.count() * candidates.count() // (4 * cores)))
    stripe = F.floor(F.col("c_block") / wide).alias("stripe")
    pairs = ours.select("length", "a_block").join(theirs.select("length", "c_block", stripe), "length")
    return (pairs.join(theirs, ["length", "c_block"]).join(ours, ["length", "a_block"])
            .repartition("length", "a_block", "stripe").sortWithinPartitions("length", "a_block", "stripe", "c_block"))


def products(asked: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all pairs of rows; as doubles where none can exceed 2^53."""
    largest = lambda x: float(np.abs(x).max(initial=0))
    if largest(asked) * largest(values) * max(1, asked.shape[1]) < 2 ** 53:
        return (asked.astype(np.float64) @ values.T.astype(np.float64)).astype(np.int64)
    return asked @ values.T


class Tops:
    """The top k (score, id) of every slot of every anchor, of all the rows shown so far."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.slots, self.k = slots, k
        self.score = np.full((anchors * slots, k), LOWEST, dtype=np.int64)
        self.id = np.zeros((anchors * slots, k), dtype=np.int64)
        self.held = np.zeros(anchors * slots, dtype=np.int64)

    def floor(self, rows: slice) -> np.ndarray:
        """For anchors and slots, the score below which nothing is taken any more."""
        return self.score[:, -1].reshape(-1, self.slots)[rows]

    def offer(self, cell: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge new rows into the tops of their cells, an anchor's slots."""
        if not len(cell):
            return
        old = np.unique(cell)
        mine = np.repeat(old, self.held[old])
        place = np.arange(len(mine)) - np.repeat(np.cumsum(self.held[old]) - self.held[old], self.held[old])
        cell = np.concatenate([mine, cell])
        score = np.concatenate([self.score[mine, place], score])
        ids = np.concatenate([self.id[mine, place], ids])
        order = np.lexsort((ids, -score, cell))
        cell, score, ids = cell[order], score[order], ids[order]
        heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        place = np.arange(len(cell)) - np.repeat(heads, np.diff(np.append(heads, len(cell))))
        kept = place < self.k
        self.score[cell[kept], place[kept]] = score[kept]
        self.id[cell[kept], place[kept]] = ids[kept]
        self.held[old] = np.minimum(self.k, np.diff(np.append(heads, len(cell))))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, slot, id, score)."""
        cell = np.repeat(np.arange(len(self.held)), self.held)
        place = np.arange(len(cell)) - np.repeat(np.cumsum(self.held) - self.held, self.held)
        return cell // self.slots, cell % self.slots, self.id[cell, place], self.score[cell, place]


#: What a task keeps of a tile of scores: (scores, same label, limits of the tile's anchors) -> slot of each, -1 for none.
Slotting = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _scan(slots: int, k: int, slot_of: Slotting):
    """Walk blocks of candidates past a block of anchors and hand on the tops of its slots."""
    def ints(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.int64)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tops = None, None

        def handed() -> pd.DataFrame:
            anchor, slot, found, score = tops.rows()
            return pd.DataFrame({"key": keys[anchor], "slot": slot.astype(np.int32), "vec_id": found, "score": score})

        for part in parts:
            for row in part.itertuples(index=False):
                if at != (row.length, row.a_block, row.stripe):
                    if tops is not None:
                        yield handed()
                    at, keys = (row.length, row.a_block, row.stripe), ints(row.a_key)
                    own, labels = ints(row.a_id), ints(row.a_label)
                    asked = widened(row.a_values, len(keys), row.length)
                    limits = ints(row.a_limits).reshape(len(keys), -1) if "a_limits" in part.columns else np.zeros((len(keys), 0))
                    tops = Tops(len(keys), slots, k)
                ids, theirs = ints(row.c_id), ints(row.c_label)
                values = widened(row.c_values, len(ids), row.length)
                for first in range(0, len(keys), ANCHORS_AT_ONCE):
                    tile = slice(first, min(first + ANCHORS_AT_ONCE, len(keys)))
                    score = products(asked[tile], values)
                    slot = slot_of(score, labels[tile, None] == theirs, limits[tile])
                    slot[own[tile, None] == ids] = -1
                    near, place = np.nonzero(slot >= 0)
                    which, found = slot[near, place].astype(np.int64), score[near, place]
                    taken = found >= tops.floor(tile)[near, which]
                    near, place = near[taken], place[taken]
                    tops.offer((near + first) * slots + which[taken], found[taken], ids[place])
        if tops is not None:
            yield handed()
    return scan


def top_of(rows: DataFrame, keys: list[str], score: str, found: str, k: int) -> DataFrame:
    """The k rows of the largest score of every key, ties to the smaller id, with their `rank`."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), found)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, anchors: Column | str, id_column: str = "vec_id", label: str = "label", vector: str = "embedding",
         positives: int = 5, k: int = 5, floor_percent: int = 80, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchors` holds."""
    chosen = df.where(anchors)
    candidates = stored(in_blocks(usable(df, id_column, label, vector, scale), ROWS_PER_BLOCK, "id"), "candidates")
    # A key of its own for each anchor row, fixed by writing it.
    keyed = stored(usable(chosen, id_column, label, vector, scale).withColumn("key", F.monotonically_increasing_id()), "anchors")
    asked = stored(in_blocks(keyed, ANCHORS_PER_BLOCK, "key"), "anchor-blocks")
    kind = "key long, slot int, vec_id long, score long"

    same = lambda score, alike, limits: np.where(alike, 0, -1).astype(np.int8)
    near = met(asked, candidates).mapInPandas(_scan(1, positives, same), kind)
    chosen = stored(top_of(near, ["key"], "score", "vec_id", positives).select(
        "key", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Upper limits in descending order, padded by a score that nothing reaches; none for positives below zero.
    limits = chosen.where("positive_score >= 0").groupBy("key").agg(
        F.sort_array(F.collect_set("positive_score"), asc=False).alias("limits"))
    padded = F.concat("limits", F.array_repeat(F.lit(LOWEST), F.lit(positives) - F.size("limits")))
    limited = stored(in_blocks(keyed.join(limits.withColumn("limits", padded), "key"), ANCHORS_PER_BLOCK, "key"), "limited")

    def slot_of(score: np.ndarray, alike: np.ndarray, limits: np.ndarray) -> np.ndarray:
        slot = np.full(score.shape, -1, dtype=np.int8)
        for j in range(limits.shape[1]):  # slot j: at most limit j, above limit j + 1
            slot += score <= limits[:, j, None]
        last = np.where(limits == LOWEST, np.iinfo(np.int64).max, limits).min(axis=1, initial=np.iinfo(np.int64).max)
        # Nothing below the lowest window's floor.
        slot[alike | (100 * score < floor_percent * last[:, None])] = -1
        return slot

    found = met(limited, candidates).mapInPandas(_scan(positives, k, slot_of), kind)
    slots = top_of(found, ["key", "slot"], "score", "vec_id", k).drop("rank")
    # A positive's slot is the place of its score among the limits.
    ranked = chosen.join(limits, "key").withColumn("from_slot", F.array_position("limits", F.col("positive_score")) - 1)
    windows = ranked.join(slots, "key").where(
        (F.col("slot") >= F.col("from_slot")) & (100 * F.col("score") >= floor_percent * F.col("positive_score")))
    best = top_of(windows, ["key", "place"], "score", "vec_id", k)
    return best.join(keyed.select("key", F.col("id").alias("anchor_id")), "key").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
