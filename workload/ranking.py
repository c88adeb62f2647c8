"""Relevance, redundancy and selection of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellhour.functions.draws import SPAN
from cellhour.model import ARM_DROPS, REPEAT_SHARE, SEED, SEEDS, STAGES
from cellhour.operators import neighbours, selection
from cellhour.plans import screen
from cellhour.session import scratch

from .adapters import ROW_KEY, V_TABLE, Tables
from .profiles import union
from .registry import query

FEATURES = ["T2M", "RH2M", "WS2M", "CAPE"]
ARM_NAMES = ["T2M", "RH2M", "WS2M", "CAPE", "KX", "hour_sin", "cloud_water"]
DECILES = "[" + ", ".join(f"0.{i}" for i in range(1, 10)) + "]"


def bin_sql(c: str, rows: str) -> str:
    return (f"""len(list_filter((SELECT list_distinct(quantile_cont({c}, {DECILES})) FROM {rows}), lambda e: e < {c}))""")


def mi_sql(name: str, rows: str, label: str, names: Sequence[str] = FEATURES, of: str | None = None) -> str:
    """feature, mi and label entropy from decile bins of each feature; bins of `rows`, counts of those rows or of `of`."""
    cells = " UNION ALL ".join(f"""SELECT '{c}' AS feature, {bin_sql(f'"{c}"', rows)} AS bin, {label} AS y FROM {of or rows}"""
                               for c in names)
    return f"""{name}_n AS (SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS n FROM ({cells}) c GROUP BY 1, 2, 3),
{name} AS (SELECT feature, sum(p * ln(p / (pb * pl))) AS mi, -sum(p * ln(pl)) AS h FROM (SELECT feature,
  n / sum(n) OVER f AS p, sum(n) OVER (PARTITION BY feature, bin) / sum(n) OVER f AS pb,
  sum(n) OVER (PARTITION BY feature, y) / sum(n) OVER f AS pl FROM {name}_n WINDOW f AS (PARTITION BY feature)) s GROUP BY feature)"""


TRAIN = "v_train AS (SELECT * FROM v_table WHERE year <> 2001)"
FLASHING = "v_flashing AS (SELECT *, ln(1e0 + flash_count) AS level FROM v_table WHERE year <> 2001 AND flash_count > 0)"
OCCURRENCE = [V_TABLE, TRAIN, mi_sql("v_mi", "v_train", "CASE WHEN flash_count > 0 THEN 1 ELSE 0 END")]
COUNT = [V_TABLE, FLASHING, mi_sql("v_mi", "v_flashing", bin_sql("level", "v_flashing"))]


def train(t: Tables) -> DataFrame:
    return t.table.filter("year <> 2001")


def step_sql(c: str, bits: int) -> str:
    """The grid of the nearest-neighbour estimators: the spread to `bits` binary places over 2^30, 52 bits a value at most."""
    power = f"pow(2e0, floor(log2(stddev_pop({c}))))"
    return (f"greatest(floor(stddev_pop({c}) / {power} * pow(2e0, {bits})) / pow(2e0, {bits}) * {power} * pow(2e0, -30), "
            f"max(abs({c})) * pow(2e0, -52))")


def psi_sql(n: str) -> str:
    x = f"({n} + 6e0)"
    ahead = " - ".join(f"1e0 / ({n} + {i}e0)" for i in range(6))
    return (f"(ln({x}) - 0.5e0 / {x} - 1e0 / (12e0 * {x} ** 2) + 1e0 / (120e0 * {x} ** 4) - 1e0 / (252e0 * {x} ** 6) - {ahead})")


# One axis: the third nearest row of a class lies among three rows to either side; rows nearer are counted by ranks.
NEAR_CLASS = [V_TABLE, TRAIN, "n_rows AS (" + union(
    f"""SELECT '{c}' AS feature, CAST(flash_count > 0 AS INT) AS y, CAST(floor("{c}" / (SELECT {step_sql(f'"{c}"', 0)} FROM v_train) + 0.5e0) AS BIGINT) AS v
    FROM v_train""" for c in FEATURES) + ")",
    """n_radius AS (SELECT feature, v, size, list_sort(list_filter([v - a1, v - a2, v - a3, b1 - v, b2 - v, b3 - v], lambda d: d IS NOT NULL))[3] AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY feature, y) AS size, lag(v, 1) OVER w AS a1, lag(v, 2) OVER w AS a2, lag(v, 3) OVER w AS a3,
    lead(v, 1) OVER w AS b1, lead(v, 2) OVER w AS b2, lead(v, 3) OVER w AS b3 FROM n_rows WINDOW w AS (PARTITION BY feature, y ORDER BY v)))""",
    "n_upto AS (SELECT DISTINCT feature, v, count(*) OVER (PARTITION BY feature ORDER BY v) AS upto FROM n_rows)",
    """n_met AS (SELECT q.*, h.upto - coalesce(l.upto, 0) AS m FROM (SELECT *, v + greatest(r, 1) - 1 AS high, v - greatest(r, 1) AS low FROM n_radius) q
  ASOF LEFT JOIN n_upto h ON q.feature = h.feature AND q.high >= h.v ASOF LEFT JOIN n_upto l ON q.feature = l.feature AND q.low >= l.v)"""]


@query("K1b_nearest_occurrence", "feature:s relevance:d",
       f"""SELECT feature, greatest(0e0, {psi_sql('count(*)')} + {psi_sql('3e0')} - avg({psi_sql('size')}) - avg({psi_sql('m')})) / (SELECT
       -(avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y))) FROM (SELECT CAST(flash_count > 0 AS INT) AS y FROM v_train)) AS relevance
       FROM n_met GROUP BY feature""", NEAR_CLASS)
def nearest_occurrence(t: Tables) -> DataFrame:
    return neighbours.occurrence_relevance(train(t), FEATURES)


# Two axes: all pairs of rows with events, which are few here.
NEAR_PLANE = [V_TABLE, FLASHING, "n_points AS (SELECT row_number() OVER () AS id, " + ", ".join(
    f"""CAST(floor({c} / (SELECT {step_sql(c, 20)} FROM v_flashing) + 0.5e0) AS BIGINT) AS {a}"""
    for a, c in [("y", "level"), *((f"x{i}", f'"{c}"') for i, c in enumerate(FEATURES))]) + " FROM v_flashing)",
    "n_pairs AS (" + union(f"""SELECT '{c}' AS feature, p.id, list(abs(p.x{i} - q.x{i})) AS dx, list(abs(p.y - q.y)) AS dy
  FROM n_points p, n_points q GROUP BY p.id""" for i, c in enumerate(FEATURES)) + ")",
    """n_near AS (SELECT feature, len(list_filter(dx, lambda d: d < r)) AS nx, len(list_filter(dy, lambda d: d < r)) AS ny FROM (
  SELECT *, greatest(1, list_sort(list_transform(range(1, len(dx) + 1), lambda i: greatest(dx[i], dy[i])))[4]) AS r FROM n_pairs))""",
    f"""n_plane AS (SELECT feature, greatest(0e0, {psi_sql('count(*)')} + {psi_sql('3e0')} - avg({psi_sql('nx')} + {psi_sql('ny')})) AS mi
  FROM n_near GROUP BY feature)"""]


@query("K2b_nearest_count", "feature:s relevance:d", "SELECT feature, mi / (SELECT max(mi) FROM n_plane) AS relevance FROM n_plane", NEAR_PLANE)
def nearest_count(t: Tables) -> DataFrame:
    return neighbours.count_relevance(train(t), FEATURES)


@query("K1_relevance_occurrence", "feature:s relevance:d", "SELECT feature, mi / h AS relevance FROM v_mi", OCCURRENCE)
def relevance_occurrence(t: Tables) -> DataFrame:
    return selection.occurrence_relevance(train(t), selection.bin_edges(train(t), FEATURES))


@query("K2_relevance_count", "feature:s relevance:d", "SELECT feature, mi / (SELECT max(mi) FROM v_mi) AS relevance FROM v_mi", COUNT)
def relevance_count(t: Tables) -> DataFrame:
    rows = train(t).filter("flash_count > 0")
    level = rows.select(F.log1p(F.col("flash_count").cast("double")).alias("level"))
    return selection.count_relevance(rows, selection.bin_edges(rows, FEATURES),
                                     selection.bin_edges(level, ["level"])["level"])


#: What the contract derives, for SQL.
V_DERIVED = """v_derived AS (SELECT *, sin(2e0 * pi() * hour_of_day_local / 24e0) AS hour_sin,
  cos(2e0 * pi() * hour_of_day_local / 24e0) AS hour_cos, sin(2e0 * pi() * day_of_year / 365.25e0) AS doy_sin,
  cos(2e0 * pi() * day_of_year / 365.25e0) AS doy_cos, "T2M" - ("D2M" - 273.15e0) AS dewpoint_depression,
  sin(radians(lat)) * sin(radians(23.44e0) * sin(2e0 * pi() * (day_of_year - 81) / 365.25e0))
  + cos(radians(lat)) * cos(radians(23.44e0) * sin(2e0 * pi() * (day_of_year - 81) / 365.25e0))
  * cos(radians((hour_of_day_local - 12e0) * 15e0)) AS cos_sza FROM v_table)"""


def greedy_sql(name: str, stage: str, names: Sequence[str], condition: str = "year <> 2001", part: str = "true") -> list[str]:
    """CTEs that end in `name`: position, feature, relevance, redundancy and score of the whole greedy order.

    Relevance counts the rows where `part` holds.

    The matrix c holds what the features chosen so far leave of the rank correlations: taking one is a sweep by its
    row, and the share of a feature's rank variance that they explain is one less its diagonal.
    """
    n, rows = len(names), f"{name}_rows"
    if stage == "count":
        condition += " AND flash_count > 0"
    label = bin_sql("level", rows) if stage == "count" else "CASE WHEN flash_count > 0 THEN 1 ELSE 0 END"
    best = f"(SELECT max(mi) FROM {name}_mi)" if stage == "count" else "h"
    ranks = ", ".join(rank_of(c) for c in names)
    pairs = ", ".join("1e0" if a == b else f"""coalesce(CASE WHEN isfinite(corr("{a}", "{b}")) THEN corr("{a}", "{b}") END, 0e0)"""
                      for a in names for b in names)
    places = ", ".join(f"coalesce((SELECT mi / {best} FROM {name}_mi WHERE feature = '{c}'), 0e0)" for c in names)
    explained = f"greatest(0e0, least(1e0, 1e0 - c[(i - 1) * {n} + i]))"
    swept = f"c[k] - c[((k - 1) // {n}) * {n} + pick] * c[(pick - 1) * {n} + (k - 1) % {n} + 1] / c[(pick - 1) * {n} + pick]"
    return [
        f"{rows} AS (SELECT *, ln(1e0 + flash_count) AS level FROM v_derived WHERE {condition})",
        mi_sql(f"{name}_mi", rows, label, names, f"(SELECT * FROM {rows} WHERE {part}) {name}_part"),
        f"{name}_ranks AS (SELECT {ranks} FROM {rows})",
        f"{name}_start AS (SELECT (SELECT [{pairs}] FROM {name}_ranks) AS c, [{places}] AS rel, {list(names)} AS names)",
        f"""{name}_steps AS (SELECT 0 AS position, c, rel, names, CAST([] AS BIGINT[]) AS chosen, 0e0 AS redundancy FROM {name}_start
  UNION ALL SELECT position + 1, CASE WHEN c[(pick - 1) * {n} + pick] > 1e-9
      THEN list_transform(range(1, {n * n + 1}), lambda k: {swept}) ELSE c END,
    rel, names, list_append(chosen, pick), {explained.replace('i - 1', 'pick - 1').replace('+ i]', '+ pick]')}
  FROM (SELECT *, list_position(scores, list_max(scores)) AS pick FROM (SELECT *, list_transform(range(1, {n + 1}),
    lambda i: CASE WHEN list_contains(chosen, i) THEN -1e9 ELSE round(rel[i] - {explained}, 9) END) AS scores FROM {name}_steps
    WHERE position < {n})))""",
        f"""{name} AS (SELECT position, names[chosen[position]] AS feature, rel[chosen[position]] AS relevance, redundancy,
  rel[chosen[position]] - redundancy AS score FROM {name}_steps WHERE position > 0)"""]


def rank_of(c: str) -> str:
    return f'rank() OVER (ORDER BY "{c}") + (count(*) OVER (PARTITION BY "{c}") - 1) / 2e0 AS "{c}"'


RANKS = "v_ranks AS (SELECT " + ", ".join(rank_of(c) for c in FEATURES) + " FROM v_train)"
RHO2 = "v_rho AS (" + union(f"""SELECT '{a}' AS candidate, '{b}' AS chosen, pow(corr("{a}", "{b}"), 2) AS r2 FROM v_ranks"""
                            for a in FEATURES for b in FEATURES if a != b) + ")"


@query("K3_rank_redundancy", "candidate:s chosen:s r2:d", "SELECT * FROM v_rho", [V_TABLE, TRAIN, RANKS, RHO2])
def rank_redundancy(t: Tables) -> DataFrame:
    """With one feature chosen, the explained share is the squared rank correlation."""
    ranks = selection.rank_moments(train(t), FEATURES, ROW_KEY)
    rows = [(a, b, selection.rank_r2(ranks, a, [b])) for a in FEATURES for b in FEATURES if a != b]
    return t.spark.createDataFrame(rows, "candidate STRING, chosen STRING, r2 DOUBLE")


def joint_sql(names: Sequence[str]) -> str:
    """r2 of each feature on all others: one less the reciprocal of its place in the inverse correlation matrix."""
    n = len(names)
    start = ", ".join("1e0" if a == b else f'corr("{a}", "{b}")' for a in names for b in names)
    swept = (f"c[k] - c[((k - 1) // {n}) * {n} + p] * c[(p - 1) * {n} + (k - 1) % {n} + 1] / c[(p - 1) * {n} + p]")
    parts = []
    for i, held in enumerate(names):
        rest = [x for x in names if x != held]
        order = [names.index(x) + 1 for x in rest]
        inner = "(SELECT c FROM v_corr)"
        for p in order:
            inner = f"(SELECT list_transform(range(1, {n * n + 1}), lambda k: {swept.replace('p)', f'{p})').replace('+ p]', f'+ {p}]').replace('(p - 1)', f'({p} - 1)')}) AS c FROM {inner})"
        parts.append(f"SELECT '{held}' AS candidate, '{'+'.join(rest)}' AS chosen, 1e0 - c[{i * n + i + 1}] AS r2 FROM {inner}")
    return f"WITH v_corr AS (SELECT [{start}] AS c FROM v_ranks) " + " UNION ALL ".join(parts)


@query("K3b_joint_redundancy", "candidate:s chosen:s r2:d", f"SELECT * FROM ({joint_sql(FEATURES)})", [V_TABLE, TRAIN, RANKS])
def joint_redundancy(t: Tables) -> DataFrame:
    ranks = selection.rank_moments(train(t), FEATURES, ROW_KEY)
    rows = [(c, "+".join(x for x in FEATURES if x != c), selection.rank_r2(ranks, c, [x for x in FEATURES if x != c]))
            for c in FEATURES]
    return t.spark.createDataFrame(rows, "candidate STRING, chosen STRING, r2 DOUBLE")


@query("K4_greedy_two_steps", "position:l feature:s relevance:d redundancy:d score:d",
       """SELECT 1 AS position, feature, relevance, 0e0 AS redundancy, relevance AS score FROM first UNION ALL
       SELECT 2, feature, relevance, r2, relevance - r2 FROM (SELECT m.feature, m.mi / m.h AS relevance, r.r2,
       row_number() OVER (ORDER BY m.mi / m.h - r.r2 DESC) AS place FROM v_mi m, first, v_rho r
       WHERE r.candidate = m.feature AND r.chosen = first.feature) x WHERE place = 1""",
       [*OCCURRENCE, RANKS, RHO2, "first AS (SELECT feature, mi / h AS relevance FROM v_mi ORDER BY mi / h DESC LIMIT 1)"])
def greedy_two_steps(t: Tables) -> DataFrame:
    found = {r["feature"]: r["relevance"] for r in relevance_occurrence(t).collect()}
    ranks = selection.rank_moments(train(t), FEATURES, ROW_KEY)
    return selection.step_table(t.table, selection.greedy({f: found[f] for f in FEATURES}, ranks, 2))


@query("K4b_greedy_order", "position:l feature:s relevance:d redundancy:d score:d", "SELECT * FROM v_greedy",
       [V_TABLE, V_DERIVED, *greedy_sql("v_greedy", "occurrence", FEATURES)])
def greedy_order(t: Tables) -> DataFrame:
    found = {r["feature"]: r["relevance"] for r in relevance_occurrence(t).collect()}
    ranks = selection.rank_moments(train(t), FEATURES, ROW_KEY)
    return selection.step_table(t.table, selection.greedy({f: found[f] for f in FEATURES}, ranks))


def counted_draw(seed: int, *key: Column) -> Column:
    """A draw number that SQL can say too."""
    return (key[0] * 7919 + key[1] * 104729 + key[2] * 1299709 + key[3] * 31 + seed * 15485863) % SPAN


DRAW_SQL = "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 1299709 + l_suppkey * 31 + {} * 15485863) % {}"
SEED_PARTS = {f"v_seed{s}": f"{DRAW_SQL.format(SEED + s, SPAN)} < {REPEAT_SHARE * SPAN}" for s in range(SEEDS)}


@query("K5_seeded_ranking", "feature:s share_in_top_k:d mean_position:d",
       "SELECT feature, avg(CASE WHEN position <= 3 THEN 1e0 ELSE 0e0 END) AS share_in_top_k, avg(position) AS mean_position FROM ("
       + " UNION ALL ".join(f"SELECT feature, position FROM {name}" for name in SEED_PARTS) + ") GROUP BY 1",
       [V_TABLE, V_DERIVED, *[cte for name, part in SEED_PARTS.items()
                              for cte in greedy_sql(name, "occurrence", ARM_NAMES, part=part)]])
def seeded_ranking(t: Tables) -> DataFrame:
    """Five repetitions, each on its own half of the training rows."""
    rows = screen.feature_rows(train(t), ARM_NAMES, ROW_KEY)
    ranking = selection.rank_stage(rows, ARM_NAMES, "occurrence", ROW_KEY, number=counted_draw)
    return selection.stability(ranking.orders_table(t.table), 3)


def screen_sql(names: Sequence[str]) -> list[str]:
    """CTEs of the greedy order of both stages over all training rows."""
    return [V_TABLE, V_DERIVED, *greedy_sql("v_occurrence", "occurrence", names), *greedy_sql("v_count", "count", names)]


STEPS = "position, feature, relevance, redundancy, score"


@query("K6_screen_arm", "arm:s stage:s position:l feature:s relevance:d redundancy:d score:d",
       f"""SELECT 'full' AS arm, 'occurrence' AS stage, {STEPS} FROM v_occurrence UNION ALL
       SELECT 'full', 'count', {STEPS} FROM v_count""", screen_sql(ARM_NAMES))
def screen_arm(t: Tables) -> DataFrame:
    result = screen.screen_arm(train(t), "full", ROW_KEY, ARM_NAMES)
    return screen.steps_table(t.table, [result])


DOMAIN_NAMES = ("tropis", "subtropis")


def domain_tables(t: Tables) -> dict[str, DataFrame]:
    return {d: t.table.filter(F.col("domain") == d) for d in DOMAIN_NAMES}


#: What the arms may rank of the test table's columns, in contract order.
EVERY = ["lat", "lon", "PS", "PRECTOTCORR", "T2M", "RH2M", "WS2M", "CAPE", "KX", "TCIW", "TCLW", "D2M", "hour_sin", "hour_cos",
         "doy_sin", "doy_cos", "cos_sza", "dewpoint_depression", "cloud_water"]
OF_ARM = {arm: [c for c in EVERY if c not in ARM_DROPS[arm]] for arm in screen.ARMS}
DOMAIN_PARTS = {(d, arm, stage): f"v_{d}_{arm}_{stage}" for d in DOMAIN_NAMES for arm in screen.ARMS for stage in STAGES}
DOMAIN_SQL = [V_TABLE, V_DERIVED, *[cte for (d, arm, stage), name in DOMAIN_PARTS.items() for cte in greedy_sql(
    name, stage, OF_ARM[arm], f"year <> 2001 AND domain = '{d}'")]]


@query("K7_screen_domain", "domain:s arm:s stage:s position:l feature:s relevance:d redundancy:d score:d",
       " UNION ALL ".join(f"SELECT '{d}' AS domain, '{arm}' AS arm, '{stage}' AS stage, {STEPS} FROM {name}"
                          for (d, arm, stage), name in DOMAIN_PARTS.items()), DOMAIN_SQL)
def screen_domain(t: Tables) -> DataFrame:
    """All arms of each domain over every candidate the contract names."""
    parts = [screen.steps_table(t.table, list(screen.screen_domain(rows, 2001, key=ROW_KEY).values()))
             .withColumn("domain", F.lit(d)) for d, rows in domain_tables(t).items()]
    return parts[0].unionByName(parts[1])


SHARED_STEPS = f"""SELECT 'shared' AS arm, 'occurrence' AS stage, {STEPS} FROM v_occurrence UNION ALL
       SELECT 'shared', 'count', {STEPS} FROM v_count"""


@query("K8_screen_shared", "arm:s stage:s position:l feature:s relevance:d redundancy:d score:d", SHARED_STEPS, screen_sql(ARM_NAMES))
def screen_shared(t: Tables) -> DataFrame:
    pooled = screen.screen_shared(list(domain_tables(t).values()), 2001, key=ROW_KEY, names=ARM_NAMES)
    return screen.steps_table(t.table, [pooled])


WIDTH = 5


@query("K9_stored_selection", "scope:s domain:s stage:s position:l feature:s",
       " UNION ALL ".join([
           *[f"SELECT 'within' AS scope, '{d}' AS domain, '{stage}' AS stage, position, feature FROM {name} WHERE position <= {WIDTH}"
             for (d, arm, stage), name in DOMAIN_PARTS.items() if arm == "full"],
           *[f"SELECT 'shared', NULL, '{stage}', position, feature FROM v_{stage} WHERE position <= {WIDTH}" for stage in STAGES]]),
       [*DOMAIN_SQL, *screen_sql(ARM_NAMES)[2:]])
def stored_selection(t: Tables) -> DataFrame:
    """What each domain's screen and the shared screen select, stored and read back through the contract."""
    tables = domain_tables(t)
    within = {d: screen.screen_domain(rows, 2001, ["full"], key=ROW_KEY, seeds=0)["full"] for d, rows in tables.items()}
    shared = screen.screen_shared(list(tables.values()), 2001, key=ROW_KEY, names=ARM_NAMES, seeds=0)
    path = scratch(t.spark, "sets")
    screen.write_sets(screen.feature_sets(t.spark, within, shared, WIDTH), path)
    return screen.read_sets(t.spark, path)
