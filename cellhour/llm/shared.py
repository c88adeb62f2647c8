"""Tables in the shared folder that the session names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cellhour.session import scratch


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and go on from the files.

    Later jobs read the same rows even if the executor that made them is lost.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
