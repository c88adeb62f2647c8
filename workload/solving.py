"""Linear systems, ridge and logistic fits as SQL, for comparing fits with their closed forms and Newton steps."""

from __future__ import annotations

from collections.abc import Sequence

NEWTON_STEPS = 14


def solved(matrix: str, k: int) -> str:
    """A SELECT of `x`, the solution of k equations; `matrix` selects `m`, their rows with the right side last, as one list."""
    inner, wide = f"({matrix})", k + 1
    for p in range(1, k + 1):
        at = lambda r, c: f"m[({r}) * {wide} + {c}]"
        row, col = f"((j - 1) // {wide})", f"((j - 1) % {wide} + 1)"
        pivot, same = at(p - 1, p), f"{row} = {p - 1}"
        swept = f"CASE WHEN {same} THEN m[j] / {pivot} ELSE m[j] - {at(row, p)} * {at(p - 1, col)} / {pivot} END"
        inner = f"(SELECT list_transform(range(1, {k * wide + 1}), lambda j: {swept}) AS m FROM {inner})"
    return f"SELECT [{', '.join(f'm[{(i + 1) * wide}]' for i in range(k))}] AS x FROM {inner}"


def ridge_ctes(name: str, rows: str, names: Sequence[str], y: str = "y", alpha: float = 1.0) -> list[str]:
    """`name` with `b`: the weights of a ridge fit and its intercept last."""
    quoted = [f'"{n}"' for n in names]
    cells = ", ".join(
        ", ".join([*(f"count(*) * covar_pop({a}, {b}) + {alpha if a == b else 0e0}" for b in quoted), f"count(*) * covar_pop({a}, {y})"])
        for a in quoted)
    means = ", ".join(f"avg({a})" for a in quoted)
    return [f"{name}_w AS ({solved(f'SELECT [{cells}] AS m FROM {rows}', len(names))})",
            f"{name} AS (SELECT list_append(x, my - list_dot_product(x, mx)) AS b FROM {name}_w, "
            f"(SELECT [{means}] AS mx, avg({y}) AS my FROM {rows}))"]


def linear(names: Sequence[str], b: str = "b") -> str:
    return " + ".join([f'{b}[{i + 1}] * "{n}"' for i, n in enumerate(names)] + [f"{b}[{len(names) + 1}]"])


def logistic_ctes(name: str, rows: str, names: Sequence[str], y: str, steps: int = NEWTON_STEPS) -> list[str]:
    """`name` with `b`: weights and intercept after full Newton steps from zero; a penalty of half the squared weights."""
    k = len(names) + 1
    x = [*(f'"{n}"' for n in names), "1e0"]
    out = [f"{name}_0 AS (SELECT [{', '.join(['0e0'] * k)}] AS b)"]
    for i in range(1, steps + 1):
        free = lambda r: "1e0" if r < k - 1 else "0e0"
        cells = ", ".join(", ".join([*(f"sum(p * (1e0 - p) * {x[r]} * {x[c]})" + (f" + {free(r)}" if r == c else "") for c in range(k)),
                                     f"sum((p - {y}) * {x[r]}) + {free(r)} * any_value(b[{r + 1}])"]) for r in range(k))
        scored = f"SELECT *, 1e0 / (1e0 + exp(-({linear(names)}))) AS p FROM {rows}, {name}_{i - 1}"
        step = solved(f"SELECT [{cells}] AS m FROM ({scored})", k)
        out.append(f"{name}_{i} AS MATERIALIZED (SELECT list_transform(range(1, {k + 1}), lambda j: b[j] - x[j]) AS b FROM {name}_{i - 1}, ({step}))")
    return [*out, f"{name} AS (SELECT b FROM {name}_{steps})"]


def precision_of(scored: str) -> str:
    """A SELECT of the average precision of (p, hit) rows; equal scores are one step of the curve."""
    return f"""SELECT sum(hit / CAST(hits AS DOUBLE) * tp / called) FROM (SELECT p, sum(hit) AS hit,
  sum(sum(hit)) OVER (ORDER BY p DESC) AS tp, sum(count(*)) OVER (ORDER BY p DESC) AS called, sum(sum(hit)) OVER () AS hits
  FROM ({scored}) GROUP BY p)"""


def area_of(scored: str) -> str:
    """A SELECT of the area under the ROC curve of (p, hit) rows."""
    return f"""SELECT (sum(r) FILTER (hit = 1) - any_value(n1) * (any_value(n1) + 1) / 2e0) / (any_value(n1) * any_value(n0)) FROM (
  SELECT hit, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS r, CAST(sum(hit) OVER () AS DOUBLE) AS n1,
  CAST(sum(1 - hit) OVER () AS DOUBLE) AS n0 FROM ({scored}))"""


def standard(name: str, names: Sequence[str], where: str = "true") -> list[str]:
    """`name`: year, flash_count and the named columns standardised on all training rows; rows where `where` holds."""
    fitted = ", ".join(f'avg("{n}") AS "m_{n}", stddev_pop("{n}") AS "s_{n}"' for n in names)
    shown = ", ".join(f'("{n}" - "m_{n}") / (CASE WHEN "s_{n}" > 0 THEN "s_{n}" ELSE 1e0 END) AS "{n}"' for n in names)
    return [f"{name}_scale AS (SELECT {fitted} FROM v_derived WHERE year <> 2001)",
            f"""{name} AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, year, flash_count,
  CAST(flash_count > 0 AS INT) AS hit, ln(1e0 + flash_count) AS y, {shown} FROM v_derived, {name}_scale WHERE {where})""",
            f"{name}_train AS (SELECT * FROM {name} WHERE year <> 2001)", f"{name}_test AS (SELECT * FROM {name} WHERE year = 2001)"]


def ablation_ctes(name: str, stage: str, names: Sequence[str], out: str) -> list[str]:
    """`out` (dropped, score): the full set, and the set without each feature."""
    rows = f"{name}_rows"
    ctes = standard(rows, names, "true" if stage == "occurrence" else "flash_count > 0")
    scores = []
    for i, dropped in enumerate([None, *names]):
        left, fit = [n for n in names if n != dropped], f"{name}_fit{i}"
        if stage == "occurrence":
            ctes += logistic_ctes(fit, f"{rows}_train", left, "hit")
            score = precision_of(f"SELECT hit, 1e0 / (1e0 + exp(-({linear(left)}))) AS p FROM {rows}_test, {fit}")
        else:
            ctes += ridge_ctes(fit, f"{rows}_train", left)
            score = f"SELECT 1 - sum((y - ({linear(left)})) ** 2) / (count(*) * var_pop(y)) FROM {rows}_test, {fit}"
        scores.append(f"SELECT {'NULL' if dropped is None else repr(dropped)} AS dropped, ({score}) AS score")
    return [*ctes, f"{out} AS ({' UNION ALL '.join(scores)})"]
