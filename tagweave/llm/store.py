"""Durable intermediate tables for this package's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagweave.dataflow import fresh_path

__all__ = ["durable", "fresh_path", "small_batches", "unused"]

# Arrow batches for several operators in one session: whole texts are long, and each task holds several batches at once
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    It cuts the lineage, so a lost executor costs no earlier stage again; the shuffle
    files of the job go as soon as its table is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Make the session's Arrow batches small, unless it has chosen their size."""
    for key, size in _BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, size)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
