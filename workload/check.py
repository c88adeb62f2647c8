"""Run queries beside their SQL and compare the rows.

    python -m workload.check [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import tempfile
import time
import traceback

import duckdb

from cellhour.session import build_session

from . import load

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    return names, result.fetchall()


def comparable(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    shown = [tuple(clean(r[i]) for i in order) for r in rows]
    return sorted(shown, key=lambda r: [(v is not None, str(v)) for v in r])


def compare(entry, spark, sf_dir: str) -> str | None:
    """None when rows agree, else what differs."""
    df = entry.run(spark, sf_dir)
    mine = comparable(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle()
    if sql is None:
        return None if mine else "no rows"
    names, rows = oracle_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs = comparable(names, rows)
    if not mine:
        return "no rows"
    if mine == theirs:
        return None
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(mine)} rows against {len(theirs)}, {len(wrong)} differ, first {sorted(names)}: {wrong[:2]}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    shared = tempfile.TemporaryDirectory()  # one machine is the whole cluster here
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.checkpoint.dir": shared.name,
                                                "spark.driver.memory": "12g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, entry in load().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        started = time.perf_counter()
        try:
            problem = compare(entry, spark, args.sf)
        except Exception as exc:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(exc))[:1500]
            if len(args.names) == 1:
                traceback.print_exc()
        bad += problem is not None
        kind = "sql" if entry.sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name} ({kind}, {time.perf_counter() - started:.1f}s)"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
