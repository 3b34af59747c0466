"""Substring search for many texts at once, by an inverted index of short runs of characters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.dataflow import durable

# folders of the postings; a search reads those of its runs
SLOTS = 256
# characters of an indexed run; a query up to that length is the beginning of a run
RUN = 6
# the rarest runs of a longer query whose postings are met; the rest is left to the check
RAREST = 3
SHORTEST = 2


def _grams(text: Column, last: Column) -> Column:
    """Distinct runs that start at 1 to ``last``."""
    every = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(RUN)))
    return F.when(last >= 1, F.array_distinct(every))


def _slot(gram: str) -> Column:
    """The folder of a run, by its first two characters."""
    return F.pmod(F.xxhash64(F.substring(gram, 1, SHORTEST)), F.lit(SLOTS)).cast("int").alias("slot")


def build_index(rows: DataFrame, fields: Sequence[str], path: str) -> None:
    """Write the index of ``fields`` of ``rows`` (id unique): postings (slot, gram, field,
    id), foldered by slot and sorted by run, and each run's row count.

    A run starts at every character but the last, and is shorter at the end of a text. Null
    texts and those of one character have no postings: nothing finds them.
    """
    # a small table has many runs, so its rows are dealt over the tasks first
    texts = rows.select("id", *fields).repartition("id").select(
        "id",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("field"), F.lower(c).alias("text")) for c in fields])
        ).alias("_t"),
    ).select("id", "_t.*")
    grams = texts.select(
        "id", "field", F.explode(_grams(F.col("text"), F.length("text") - 1)).alias("gram")
    )
    # a range of (slot, gram) is one task's, however many rows a run has
    placed = grams.withColumn("slot", _slot("gram")).repartitionByRange("slot", "gram", "id")
    placed.sortWithinPartitions("slot", "gram").write.partitionBy("slot").parquet(f"{path}/postings")
    postings = rows.sparkSession.read.parquet(f"{path}/postings")
    postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")


def _asked(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """(query, slot, size, gram, need): the first ``size`` characters to meet for each query,
    a whole run if it is longer than that, and how many there are. A longer query with a run
    that no text has is left out."""
    texts = queries.select(F.lower(F.trim("query")).alias("query")).distinct()
    size = F.length("query")
    long = texts.filter(size > RUN).select(
        "query", F.explode(_grams(F.col("query"), size - RUN + 1)).alias("gram")
    )
    rank = F.row_number().over(W.partitionBy("query").orderBy("n", "gram"))
    ranked = long.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("_rank", rank)
    kept = ranked.filter(F.col("_rank") <= RAREST)
    # the rarest one comes first, so an unknown run is always among these
    needs = kept.groupBy("query").agg(F.count(F.lit(1)).alias("need"), F.min("n").alias("_least"))
    parts = kept.join(needs.filter("_least > 0"), "query").select(
        "query", F.lit(RUN).alias("size"), "gram", "need"
    )
    short = texts.filter(size.between(SHORTEST, RUN)).select(
        "query", size.alias("size"), F.col("query").alias("gram"), F.lit(1).cast("long").alias("need")
    )
    return parts.unionByName(short).withColumn("slot", _slot("gram"))


def matching_postings(path: str, asked: DataFrame) -> DataFrame:
    """The postings in the folders that ``asked`` needs."""
    postings = asked.sparkSession.read.parquet(f"{path}/postings")
    # at most SLOTS values
    slots = [r.slot for r in asked.select("slot").distinct().collect()]
    return postings.filter(F.col("slot").isin(slots))


def met_postings(path: str, asked: DataFrame) -> DataFrame:
    """The postings that begin as an asked run, with the query that asks: (query, need, field,
    id, gram). A query meets the texts that hold the run and no others."""
    # at most RUN values
    sizes = [F.lit(r["size"]) for r in asked.select("size").distinct().collect()]
    return (
        matching_postings(path, asked)
        .withColumn("size", F.explode(F.array(*sizes).cast("array<int>")))
        .withColumn("gram", F.substring("gram", F.lit(1), F.col("size")))
        .join(asked, ["slot", "size", "gram"])
        .select("query", "need", "field", "id", "gram")
    )


def search_many(path: str, rows: DataFrame, queries: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(query, and the columns of ``rows``): the rows with the query, trimmed and whatever
    its case, in one of ``fields``. ``path`` is the index of these rows.

    Queries under two characters or null find nothing; repeated ones count once. Rows that hold a
    query's rarest runs in one field are fetched and checked against its whole text.
    """
    spark = rows.sparkSession
    asked = durable(_asked(queries, spark.read.parquet(f"{path}/counts")), "search-asked")
    met = met_postings(path, asked)
    # a query that is no longer than a run is met by its own rows only
    whole = met.filter("need = 1").select("query", "id")
    in_parts = (
        met.filter("need > 1")
        .groupBy("query", "need", "field", "id")
        .agg(F.count_distinct("gram").alias("met"))
        .filter("met = need")
        .select("query", "id")
    )
    found = whole.unionByName(in_parts).distinct().join(rows, "id")
    within = F.lit(False)
    for c in fields:
        within = within | F.coalesce(F.contains(F.lower(c), F.col("query")), F.lit(False))
    return found.filter(within).select("query", *rows.columns)


def first_matches(found: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` rows of each query by name, then id: with ``rank`` from 1. Spark
    keeps k rows a query before the shuffle."""
    order = W.partitionBy("query").orderBy("name", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
