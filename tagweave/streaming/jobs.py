"""Incremental ingest, arrival de-duplication and running review facts.

Per-batch output goes to a folder named after the batch and replaces what an earlier,
failed try of the same batch left there, so a restart repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tagweave.constants import DIAGNOSIS_STREAK, SCORE_THRESHOLD
from tagweave.dataflow import durable, rank_within
from tagweave.functions.urls import normalize_domain
from tagweave.operators.pages import page_facts
from tagweave.operators.reviews import cut_of_firsts
from tagweave.operators.scoring import Scorer
from tagweave.operators.taxonomy import TagRules, classify
from tagweave.plans.match import match_new
from tagweave.sources.writers import edge_rows, upsert_changes

_BATCH = "batch"


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files: int | None = None
) -> DataFrame:
    """A stream of the Parquet files of a folder, at most ``files`` per micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def run_batches(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Start ``work`` on every micro-batch available now."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(work)
        .trigger(availableNow=True)
        .start()
    )


def put_batch(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{_BATCH}={batch_id}")


def batches_before(
    spark: SparkSession, root: str, schema: T.StructType, batch_id: int | None = None
) -> DataFrame:
    """All rows of earlier batches, with their batch number."""
    full = T.StructType([*schema.fields, T.StructField(_BATCH, T.LongType())])
    try:
        df = spark.read.schema(full).parquet(root)
    except AnalysisException:
        df = spark.createDataFrame([], full)
    return df if batch_id is None else df.filter(F.col(_BATCH) < batch_id)


# ---- arrivals -----------------------------------------------------------------


def deduped_arrivals(pages: DataFrame, delay: str) -> DataFrame:
    """One arrival per domain within the watermark delay; late copies are dropped."""
    return (
        pages.withColumn("domain", normalize_domain("url"))
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["domain"])
    )


def current_companies(base: DataFrame, root: str, batch_id: int | None = None) -> DataFrame:
    """The base table with the newest version of each changed company."""
    changed = batches_before(base.sparkSession, root, base.schema, batch_id)
    newest = (
        changed.groupBy("id")
        .agg(F.max_by(F.struct(*base.columns), _BATCH).alias("_row"))
        .select("_row.*")
    )
    return base.join(newest.select("id"), "id", "left_anti").select(*base.columns).unionByName(newest)


def current_edges(base: DataFrame, root: str, batch_id: int | None = None) -> DataFrame:
    added = batches_before(base.sparkSession, root, base.schema, batch_id)
    return base.unionByName(added.select(*base.columns))


def ingest_batches(
    pages: DataFrame,
    predictions: DataFrame,
    taxonomy: DataFrame,
    companies: DataFrame,
    edges: DataFrame,
    root: str,
    rules: TagRules = TagRules(),
    scorer: Scorer | None = None,
    threshold: float = SCORE_THRESHOLD,
) -> StreamingQuery:
    """Ingest a page stream (page_id, url, html, name): pages that pass the gate are
    classified from the predictions of their id, upserted as companies, and matched;
    found edges are appended.

    Changed companies go to ``root``/companies, new edges to ``root``/edges, and what
    was done with each page to ``root``/log. Earlier batches are never rewritten.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        facts = durable(
            page_facts(batch).join(batch.select("page_id", "name"), "page_id"), "ingest-pages"
        )
        good = facts.filter("gate = 'accepted'")
        wanted = predictions.join(good.select(F.col("page_id").alias("id")), "id", "left_semi")
        tagged = classify(wanted, taxonomy, rules).select(
            F.col("id").alias("page_id"), "sectors", "subsectors", "sub_subsectors"
        )
        arrivals = good.join(tagged, "page_id").select(
            F.col("page_id").alias("pos"), "name", F.col("url").alias("website"),
            "sectors", "subsectors", "sub_subsectors", "linkedin_url",
        )
        stored = current_companies(companies, f"{root}/companies", batch_id)
        changed, actions = upsert_changes(stored, arrivals)
        put_batch(changed, f"{root}/companies", batch_id)
        # every page of the batch has a row, with what became of it
        pages_log = facts.select(F.col("page_id").alias("pos"), "name", "gate").join(
            actions.select("pos", "action", "id"), "pos", "left"
        )
        refusal = F.when(F.col("gate") == "accepted", "no predictions").otherwise(F.col("gate"))
        put_batch(
            pages_log.select("pos", "name", F.coalesce("action", refusal).alias("action"), "id"),
            f"{root}/log", batch_id,
        )
        after = durable(current_companies(companies, f"{root}/companies", batch_id + 1), "ingest-all")
        links = durable(current_edges(edges, f"{root}/edges", batch_id), "ingest-edges")
        new = after.join(actions.select("id").distinct(), "id", "left_semi")
        saved = match_new(new, after, links, scorer, threshold)
        top = links.agg(F.max("id")).first()[0] or 0
        put_batch(edge_rows(saved.drop("via"), top), f"{root}/edges", batch_id)

    return run_batches(pages, work, f"{root}/checkpoint")


# ---- reviews ------------------------------------------------------------------


def running_latest(reviews: DataFrame, root: str) -> StreamingQuery:
    """Keep the newest review per subject of a review stream: every batch writes the
    subjects that changed. One aggregate row per subject is kept as state."""
    newest = F.max_by(
        F.struct("id", "verdict", "date_diagnosed"), F.struct(F.col("date_diagnosed"), -F.col("id"))
    )
    running = reviews.groupBy("subject").agg(newest.alias("_row")).select("subject", "_row.*")
    return run_batches(
        running, lambda df, i: put_batch(df, f"{root}/latest", i), f"{root}/checkpoint", "update"
    )


def latest_written(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The current answer of :func:`running_latest`."""
    rows = batches_before(spark, f"{root}/latest", schema)
    cols = [f.name for f in schema.fields if f.name != "subject"]
    return (
        rows.groupBy("subject")
        .agg(F.max_by(F.struct(*cols), _BATCH).alias("_row"))
        .select("subject", "_row.*")
    )


_FIRSTS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("first", T.LongType()),
    ]
)
_COUNTS = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("n", T.LongType())]
)


def running_stability(stream: DataFrame, root: str) -> StreamingQuery:
    """Follow a stream (source, verdict, date_diagnosed, id) for new verdicts.

    A source's sequence is its reviews by arrival batch and by date within a batch: a
    review that arrives late comes after those of earlier batches, whatever its date.
    State is the length of each sequence and the first position of each of its verdicts,
    which add up over batches; a busy source is never one task's work.
    """
    return run_batches(
        stream, lambda df, i: _extend_sequences(df, root, i), f"{root}/checkpoint"
    )


def running_stability_by_date(stream: DataFrame, root: str, delay: str) -> StreamingQuery:
    """:func:`running_stability` with each sequence in order of date, whatever the order
    of arrival.

    A row waits as state of its own until the watermark (the newest date seen less
    ``delay``) has passed its date, so no source gathers in one task. What is released
    is later than all released before, and continues the sequences. Rows that arrive
    behind the watermark are dropped, repeats of a waiting row count once, and rows
    without a date have no place and are left out. A row without an id only moves the
    time on: it releases what waits at the end of a stream. The state is as large as the
    rows of one delay; the RocksDB state store keeps it out of the heap.
    """
    waiting = (
        stream.filter("date_diagnosed is not null")
        .withWatermark("date_diagnosed", delay)
        .groupBy("date_diagnosed", "source", "verdict", "id")
        .agg(F.count(F.lit(1)).alias("copies"))
    )

    def work(batch: DataFrame, batch_id: int) -> None:
        # read from a table, so that the state is passed over once
        released = durable(batch.filter("id is not null"), "released")
        if not released.isEmpty():
            _extend_sequences(released, root, batch_id)

    return run_batches(waiting, work, f"{root}/checkpoint")


def _extend_sequences(batch: DataFrame, root: str, batch_id: int) -> None:
    """Add the lengths and first positions of a batch's rows, in order of date, to those
    of the batches before."""
    spark = batch.sparkSession
    ranked = rank_within(
        batch.select("source", "verdict", "date_diagnosed", "id"),
        ["source"],
        [F.col("date_diagnosed"), F.col("id")],
    )
    before = (
        batches_before(spark, f"{root}/counts", _COUNTS, batch_id)
        .groupBy(F.col("source").alias("_source"))
        .agg(F.sum("n").alias("n"))
    )
    # both aggregates combine before the shuffle
    firsts = (
        ranked.groupBy("source", "verdict")
        .agg(F.min("pos").alias("first"))
        .join(before, F.col("source").eqNullSafe(F.col("_source")), "left")
        .select("source", "verdict", (F.col("first") + F.coalesce("n", F.lit(0))).alias("first"))
    )
    put_batch(firsts, f"{root}/firsts", batch_id)
    put_batch(
        batch.groupBy("source").agg(F.count(F.lit(1)).alias("n")), f"{root}/counts", batch_id
    )


def stability_written(spark: SparkSession, root: str, streak: int = DIAGNOSIS_STREAK) -> DataFrame:
    """The current answer of :func:`running_stability`: (source, cut, stop_reason)."""
    firsts = (
        batches_before(spark, f"{root}/firsts", _FIRSTS)
        .groupBy("source", "verdict")
        .agg(F.min("first").alias("first"))
    )
    last = lengths_written(spark, root).withColumnRenamed("n", "last")
    return cut_of_firsts(firsts, last, streak, ("source",))


def lengths_written(spark: SparkSession, root: str) -> DataFrame:
    """Length of each source's sequence so far: (source, n)."""
    rows = batches_before(spark, f"{root}/counts", _COUNTS)
    return rows.groupBy("source").agg(F.sum("n").alias("n"))
