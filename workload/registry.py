"""Registration of a query beside its SQL, with one column list for both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import Tables

SPARK_TYPES = {"l": "bigint", "d": "double", "s": "string", "b": "boolean", "t": "timestamp_ntz"}
SQL_TYPES = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN", "t": "TIMESTAMP"}
PLACES = 6


@dataclass(frozen=True)
class Entry:
    name: str
    columns: list[tuple[str, str]]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # zone-less labels must not shift
        df = self.build(Tables(spark, sf_dir))
        return df.select(*[self._spark(n, k) for n, k in self.columns])

    @staticmethod
    def _spark(name: str, kind: str):
        col = F.col(f"`{name}`").cast(SPARK_TYPES[kind])
        if kind == "d":
            col = F.round(col, PLACES) + F.lit(0.0)
        return col.alias(name)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        shown = []
        for name, kind in self.columns:
            value = f'CAST("{name}" AS {SQL_TYPES[kind]})'
            if kind == "d":
                value = f"round({value}, {PLACES}) + 0e0"
            shown.append(f'{value} AS "{name}"')
        head, body = split_ctes(self.sql)
        return f"{head}SELECT {', '.join(shown)} FROM ({body}) AS answer"


def split_ctes(sql: str) -> tuple[str, str]:
    """Named sub-queries and the final SELECT, which a marker line keeps apart."""
    if "\n--\n" in sql:
        head, body = sql.split("\n--\n")
        return head.strip() + "\n", body.strip()
    return "", sql.strip()


ENTRIES: dict[str, Entry] = {}


def query(name: str, columns: str, sql: str | None = None, ctes: list[str] | None = None):
    """Register a builder taking `Tables`. `columns` lists name:type pairs."""
    pairs = [tuple(c.rsplit(":", 1)) for c in columns.split()]
    if sql is not None and ctes:
        sql = "WITH RECURSIVE " + ",\n".join(ctes) + "\n--\n" + sql

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        ENTRIES[name] = Entry(name, pairs, build, sql)
        return build

    return add
