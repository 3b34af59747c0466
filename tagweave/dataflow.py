"""Shared dataflow building blocks: durable tables, skew-proof ranks and joins.

Every helper here keeps one rule: no task and no driver ever has to hold a whole
group, however large one key becomes.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Row pairs that one task of a pair join forms, at most.
PAIRS_PER_TASK = 10_000_000
# A key with more rows than this is spread over several join blocks.
BLOCK_ROWS = math.isqrt(PAIRS_PER_TASK)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for durable intermediate tables.

    Only a local session that names none gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tagweave-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tagweave/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a
    lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], col: str = "pos"
) -> DataFrame:
    """1-based position of each row in its key group, for groups of any size.

    One range sort on (keys, order) spreads a hot group over many partitions. A
    segment is the part of a group inside one partition, so the offset of a
    segment is the row count of the same group's earlier segments. ``order`` must
    be total within a group for the result to be repeatable.
    """
    keys = list(keys)
    placed = durable(
        df.sort(*keys, *order).withColumn("_mid", F.monotonically_increasing_id()), "rank"
    ).withColumn("_pid", F.shiftright("_mid", 33))
    segments = placed.groupBy("_pid", *keys).agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = (
        W.partitionBy(*keys) if keys else W.partitionBy()
    ).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = segments.select(
        "_pid", *keys, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")
    )
    if not keys:
        # one row per sort partition, so bounded by the shuffle partition count
        offsets = F.broadcast(offsets)
    # rows without a key value form a group like any other
    same = reduce(and_, [F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ["_pid", *keys]])
    joined = placed.alias("p").join(offsets.alias("o"), same)
    return joined.select(
        *[F.col(f"p.{c}").alias(c) for c in df.columns if c != col],
        (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long").alias(col),
    )


def global_rank(df: DataFrame, order: Sequence[Column], col: str = "pos") -> DataFrame:
    """1-based position in a total order of the whole table, with no single-task sort."""
    return rank_within(df, [], order, col)


def partitions(spark: SparkSession) -> int:
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )


def _hot_keys(
    sides: Sequence[DataFrame], keys: list[str], block_rows: int, weights: Sequence[str] | None = None
) -> DataFrame | None:
    """Keys with more than ``block_rows`` rows on a side and the blocks they need, or
    None if there are none. At most rows/block_rows keys are hot. Settled by a job of its
    own, so that joins without hot keys stay plain."""
    counted = None
    for at, side in enumerate(sides):
        rows = F.count(F.lit(1)) if weights is None else F.sum(weights[at])
        heavy = side.groupBy(*keys).agg(rows.alias("_rows")).filter(F.col("_rows") > block_rows)
        counted = heavy if counted is None else counted.unionByName(heavy)
    hot = counted.groupBy(*keys).agg(
        F.ceil(F.max("_rows") / F.lit(block_rows)).cast("int").alias("_blocks")
    )
    if hot.isEmpty():
        return None
    return durable(hot, "hot-keys")


def pair_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    right_id: Sequence[str],
    block_rows: int = BLOCK_ROWS,
    noted: DataFrame | None = None,
    note: str | None = None,
    weights: Sequence[str] | None = None,
) -> DataFrame:
    """Inner equi-join where a key may be hot on both sides.

    A hot key's rows are dealt into blocks by a hash of the row id; each left
    block meets each right block in a task of its own. Other keys join plainly.
    Key columns must not be null; the other column names must differ.

    ``noted`` (keys, left_id, right_id, ``note``) tells something of some pairs before they are
    formed: each gets ``_notes``, the values of ``note`` for its left row and the right rows of
    its block, or null. So the pairs need not be shuffled to look them up.

    ``weights`` names a column of each side with the number of rows that a row stands for.
    """
    keys = list(keys)
    hot = _hot_keys([left, right], keys, block_rows, weights)
    # such joins emit far more than they read, so a fixed partition count keeps the
    # runtime from merging partitions by their small input size
    n = partitions(left.sparkSession)

    def with_notes(side: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
        # at most the values of a block for each left row
        lists = rows.groupBy(*on, *left_id).agg(F.collect_set(note).alias("_notes"))
        return side.join(lists, [*on, *left_id], "left")

    if hot is None:
        lhs = left if noted is None else with_notes(left, noted, keys)
        return lhs.repartition(n, *keys).join(right.repartition(n, *keys), keys)

    def dealt(side: DataFrame, ids: Sequence[str], own: str, other: str) -> DataFrame:
        blocks = F.coalesce(F.col("_blocks"), F.lit(1))
        return (
            side.join(hot, keys, "left")
            .withColumn(own, F.pmod(F.xxhash64(*ids), blocks).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), blocks - 1)))
            .drop("_blocks")
        )

    on = [*keys, "_lb", "_rb"]
    lhs = dealt(left, left_id, "_lb", "_rb")
    if noted is not None:
        blocks = F.coalesce(F.col("_blocks"), F.lit(1))
        sides = {"_lb": left_id, "_rb": right_id}
        placed = noted.join(hot, keys, "left").withColumns(
            {own: F.pmod(F.xxhash64(*ids), blocks).cast("int") for own, ids in sides.items()}
        )
        lhs = with_notes(lhs, placed, on)
    lhs = lhs.repartition(n, *on)
    rhs = dealt(right, right_id, "_rb", "_lb").repartition(n, *on)
    return lhs.join(rhs, on).drop("_lb", "_rb")


def seeded(seed: int, *cols: str) -> Column:
    """A repeatable pseudo-random sort key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
