"""Session defaults and the one place that decides where shared files may go."""

from __future__ import annotations

import re
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}
ARROW_BOUND, ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def portable(module: str) -> None:
    """Functions of the module go to tasks as they are, so that workers need not find this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def build_session(app: str = "cellhour", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Hand Python at most ARROW_BATCH bytes at a time, from now on in this session; a smaller bound stays.

    Each running task holds a batch several times, in the JVM beside its heap and in its Python worker.
    """
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get(ARROW_BOUND).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > ARROW_BATCH:
        spark.conf.set(ARROW_BOUND, f"{ARROW_BATCH}b")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return configured


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there.

    Used where several jobs must see one and the same result, so that a lost
    executor cannot change what the second job reads.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write the rows as columns to the shared folder and go on from there: for rows that many passes read, each some columns of them."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
