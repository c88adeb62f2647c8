"""Runs, ranks, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellhour.functions import ordering
from cellhour.operators import diagnose, evaluate, grid, selection
from cellhour.sources.table import sorted_view

from .adapters import DENSE, JANUARY, ROW_KEY, V_SCORED, V_STRIKES, V_TABLE, Tables
from .profiles import union
from .registry import query

RUNS = """v_runs AS (SELECT lat, lon, min("time") AS start, zero, count(*) AS length FROM (SELECT *, sum(flip) OVER w AS run FROM (
  SELECT lat, lon, "time", flash_count = 0 AS zero, CASE WHEN (flash_count = 0) IS DISTINCT FROM
  lag(flash_count = 0) OVER (PARTITION BY lat, lon ORDER BY "time") THEN 1 ELSE 0 END AS flip FROM v_dense) f
  WINDOW w AS (PARTITION BY lat, lon ORDER BY "time")) r GROUP BY lat, lon, run, zero)"""


def dense(t: Tables) -> DataFrame:
    stats = grid.event_statistics(grid.cell_hours(t.strikes, JANUARY))
    return grid.densify(grid.skeleton(t.spark, JANUARY), stats)


@query("W1_zero_runs", "lat:d lon:d start:t is_zero:b length:l", "SELECT *, zero AS is_zero FROM v_runs", [*DENSE, RUNS])
def zero_runs(t: Tables) -> DataFrame:
    return diagnose.zero_runs(dense(t), "week")


@query("W1b_run_summary", "n_zero_runs:l p25:d p50:d p75:d p90:d p99:d max:l share_over_24h:d share_over_168h:d n_live_cells:l",
       """SELECT count(*) AS n_zero_runs, quantile_cont(length, 0.25) AS p25, quantile_cont(length, 0.5) AS p50,
       quantile_cont(length, 0.75) AS p75, quantile_cont(length, 0.9) AS p90, quantile_cont(length, 0.99) AS p99, max(length) AS max,
       coalesce(sum(length) FILTER (WHERE length > 24), 0) / CAST(sum(length) AS DOUBLE) AS share_over_24h,
       coalesce(sum(length) FILTER (WHERE length > 168), 0) / CAST(sum(length) AS DOUBLE) AS share_over_168h,
       (SELECT count(DISTINCT (lat, lon)) FROM v_runs WHERE NOT zero) AS n_live_cells FROM v_runs
       WHERE zero AND (lat, lon) IN (SELECT (lat, lon) FROM v_runs WHERE NOT zero)""", [*DENSE, RUNS])
def run_summary(t: Tables) -> DataFrame:
    return diagnose.run_summary(diagnose.zero_runs(dense(t), "week"))


RANKED = ["T2M", "CAPE", "CIN"]


@query("W2_average_ranks", "column:s value:d n:l rank:d",
       union(f"""SELECT '{c}' AS "column", "{c}" AS value, count(*) AS n, sum(count(*)) OVER (ORDER BY "{c}") - (count(*) - 1) / 2e0 AS rank
       FROM v_table WHERE "{c}" IS NOT NULL GROUP BY "{c}" """ for c in RANKED), [V_TABLE])
def average_ranks(t: Tables) -> DataFrame:
    return ordering.average_ranks(t.table, RANKED)


@query("W2b_row_ranks", "l_orderkey:l l_linenumber:l T2M__rank:d CAPE__rank:d CIN__rank:d",
       "SELECT l_orderkey, l_linenumber, " + ", ".join(
           f'CASE WHEN "{c}" IS NOT NULL THEN rank() OVER (ORDER BY "{c}" NULLS LAST) + (count(*) OVER (PARTITION BY "{c}") - 1) / 2e0 END AS "{c}__rank"'
           for c in RANKED) + " FROM v_table", [V_TABLE])
def row_ranks(t: Tables) -> DataFrame:
    """The columns with few values join broadcast rank tables; CAPE takes the shuffled way."""
    return ordering.with_ranks(t.table, RANKED, ROW_KEY, broadcast_values=200)


@query("W8_ranking_curve", "score:d hits_above:l rows_above:l",
       """SELECT p AS score, sum(sum(flashed)) OVER (ORDER BY p DESC) AS hits_above,
       sum(count(*)) OVER (ORDER BY p DESC) AS rows_above FROM v_scored GROUP BY p""", [V_SCORED])
def ranking_curve(t: Tables) -> DataFrame:
    return evaluate.ranking_curve(t.scored, "flashed", "p", slice_rows=20_000)


ORDERS = """v_orders AS (SELECT seed, feature, row_number() OVER (PARTITION BY seed ORDER BY s DESC, feature) AS position FROM (
  SELECT l_orderkey % 5 AS seed, 'f' || l_linenumber AS feature, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2) o)"""


def seeded_orders(t: Tables) -> DataFrame:
    from pyspark.sql import Window
    total = t.lineitem.groupBy((F.col("l_orderkey") % 5).alias("seed"), F.concat(F.lit("f"), "l_linenumber").alias("feature")).agg(
        F.sum("l_extendedprice").alias("s"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("s"), "feature"))
    return total.select("seed", "feature", place.alias("position"))


@query("W9_order_stability", "feature:s share_in_top_k:d mean_position:d",
       """SELECT feature, avg(CASE WHEN position <= 3 THEN 1e0 ELSE 0e0 END) AS share_in_top_k, avg(position) AS mean_position
       FROM v_orders GROUP BY feature""", [ORDERS])
def order_stability(t: Tables) -> DataFrame:
    return selection.stability(seeded_orders(t), 3)


@query("T1_total_order", "time:t lat:d lon:d flash_count:l",
       """SELECT "time", lat, lon, flash_count FROM v_dense""", DENSE)
def total_order(t: Tables) -> DataFrame:
    return sorted_view(dense(t))


@query("T5_select_top", "seed:l feature:s position:l", "SELECT * FROM v_orders WHERE position <= 4", [ORDERS])
def select_top(t: Tables) -> DataFrame:
    return selection.top(seeded_orders(t), 4)


@query("U1_bag_union", "source:s n:l peak:d",
       """SELECT source, count(*) AS n, sum(peak_current_ka) AS peak FROM (SELECT source, peak_current_ka FROM v_strikes
       UNION ALL SELECT source, peak_current_ka FROM v_strikes WHERE peak_current_ka > 0) u GROUP BY source""", [V_STRIKES])
def bag_union(t: Tables) -> DataFrame:
    both = t.strikes.unionByName(t.strikes.filter("peak_current_ka > 0"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("peak_current_ka").alias("peak"))


SELECTED = """v_selected AS (SELECT CASE WHEN seed < 3 THEN 'full' ELSE 'meteorology' END AS arm,
  CASE WHEN seed % 3 = 0 THEN 'occurrence' ELSE 'count' END AS stage, feature FROM v_orders
  WHERE position <= 4 AND seed IN (0, 1, 3, 4))"""


@query("U2_stage_overlap", "arm:s feature:s found_in:s",
       """SELECT arm, feature, CASE WHEN bool_or(stage = 'occurrence') AND bool_or(stage = 'count') THEN 'both'
       ELSE max(stage) END AS found_in FROM v_selected GROUP BY arm, feature""", [ORDERS, SELECTED])
def stage_overlap(t: Tables) -> DataFrame:
    chosen = seeded_orders(t).filter("position <= 4 AND seed IN (0, 1, 3, 4)")
    selected = chosen.select(F.when(F.col("seed") < 3, "full").otherwise("meteorology").alias("arm"),
                             F.when(F.col("seed") % 3 == 0, "occurrence").otherwise("count").alias("stage"), "feature")
    return selection.compare_stages(selected)


@query("U3_distinct_keys", "kind:s n:l",
       """SELECT 'cells' AS kind, count(*) AS n FROM (SELECT DISTINCT lat, lon FROM v_table) c UNION ALL
       SELECT 'days', count(*) FROM (SELECT DISTINCT date_trunc('day', "time") FROM v_table) d UNION ALL
       SELECT 'keys', count(*) FROM (SELECT DISTINCT lat, lon, "time" FROM v_table) k""", [V_TABLE])
def distinct_keys(t: Tables) -> DataFrame:
    counted = lambda kind, *c: t.table.select(*c).distinct().agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return (counted("cells", "lat", "lon").unionByName(counted("days", F.date_trunc("day", "time")))
            .unionByName(counted("keys", "lat", "lon", "time")))
