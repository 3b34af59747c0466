"""Tables in folders by ranges of their id, of which a change rewrites only those it touches.

A folder holds the ids of one range of ``rows_per_part`` numbers, so it keeps its size as
the table grows, new rows go to the last folders, and a change costs what it touches.
Ids are unique and not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.dataflow import durable
from tagweave.schemas import COMPANY
from tagweave.sources.writers import update_by_key, upsert_changes

PART = "part"
ROWS_PER_PART = 1_000_000


def _part(rows_per_part: int) -> Column:
    return F.floor(F.col("id") / rows_per_part).cast("long")


def write_parts(df: DataFrame, path: str, rows_per_part: int = ROWS_PER_PART) -> None:
    """Write a whole table, each folder's rows together as far as they fit a task."""
    placed = df.withColumn(PART, _part(rows_per_part))
    placed.hint("rebalance", PART).write.partitionBy(PART).parquet(path)


def read_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, with its folder as column ``part`` for pruning."""
    full = T.StructType([*schema.fields, T.StructField(PART, T.LongType())])
    return spark.read.schema(full).parquet(path)


def replace_rows(
    spark: SparkSession,
    path: str,
    changed: DataFrame,
    schema: T.StructType,
    rows_per_part: int = ROWS_PER_PART,
) -> list[int]:
    """Put ``changed`` rows in the place of those with their ids, or add them, and return
    the folders that were rewritten.

    The numbers of the touched folders come to the driver, at most one for each
    ``rows_per_part`` ids. Their new content stands in a durable table (``touched-parts``)
    before the first folder is replaced: should the driver be lost while folders are put
    in place, that table has what they must hold. Lost executors do no harm.
    """
    changed = durable(
        changed.select(*schema.names).withColumn(PART, _part(rows_per_part)), "changed-rows"
    )
    touched = sorted(r[0] for r in changed.select(PART).distinct().collect())
    if not touched:
        return []
    before = read_parts(spark, path, schema).filter(F.col(PART).isin(touched))
    kept = before.join(changed.select("id"), "id", "left_anti").select(*changed.columns)
    after = durable(kept.unionByName(changed), "touched-parts")
    (
        after.hint("rebalance", PART)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PART)
        .parquet(path)
    )
    return touched


def upsert_parts(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    rows_per_part: int = ROWS_PER_PART,
    version: str = "v2",
    write_nulls: bool = False,
) -> tuple[DataFrame, list[int]]:
    """Upsert a batch into the company table at ``path``: the actions, and the folders
    rewritten. All names and websites are read for the match, of the other columns only
    those of changed companies' folders."""
    companies = read_parts(spark, path, COMPANY).drop(PART)
    changed, actions = upsert_changes(companies, batch, version, write_nulls)
    # both follow from the table as it is now
    changed, actions = durable(changed, "upsert-changed"), durable(actions, "upsert-actions")
    return actions, replace_rows(spark, path, changed, COMPANY, rows_per_part)


def update_parts(
    spark: SparkSession,
    path: str,
    changes: DataFrame,
    columns: list[str],
    schema: T.StructType,
    rows_per_part: int = ROWS_PER_PART,
) -> list[int]:
    """Set ``columns`` of the rows whose id occurs in ``changes`` (unique per id), reading
    and rewriting their folders only; ids that the table lacks change nothing."""
    changes = durable(changes.select("id", *columns), "part-changes")
    parts = changes.select(_part(rows_per_part).alias(PART)).distinct()
    numbers = [r[0] for r in parts.collect()]
    stored = read_parts(spark, path, schema).filter(F.col(PART).isin(numbers))
    found = stored.join(changes.select("id"), "id", "left_semi").select(*schema.names)
    return replace_rows(
        spark, path, update_by_key(found, changes, ["id"], columns), schema, rows_per_part
    )
