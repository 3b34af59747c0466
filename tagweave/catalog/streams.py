"""Streaming queries, run over everything available."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tagweave import fixtures as fx
from tagweave.catalog.content import _LATEST, _SEQ
from tagweave.catalog.registry import query
from tagweave.dataflow import fresh_path
from tagweave.operators import reviews as R
from tagweave.streaming import jobs as J


def feed(
    df: DataFrame,
    order: str,
    start: Callable[[DataFrame], StreamingQuery],
    waves: int = 4,
    cuts: list[int] | None = None,
) -> None:
    """Let a table arrive in waves by the order of a column, each up to one of ``cuts``
    (by default equal shares). The stream is started anew for each wave and takes up
    from its checkpoint."""
    path = fresh_path(df.sparkSession, "arrivals")
    if cuts is None:
        cuts = df.agg(
            F.percentile_approx(order, [i / waves for i in range(1, waves)]).alias("q")
        ).first()["q"]
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = df
        if low is not None:
            part = part.filter(F.col(order) > F.lit(low))
        if high is not None:
            part = part.filter(F.col(order) <= F.lit(high))
        part.write.mode("append").parquet(path)
        start(J.file_stream(df.sparkSession, path, df.schema)).awaitTermination()


def arrivals(spark, d) -> DataFrame:
    """Pages with an arrival time and the name read from them."""
    n = F.col("page_id")
    name = F.when(n % 3 == 0, F.concat(F.lit("Newcomer "), n.cast("string"))).otherwise(
        F.concat(F.lit("Customer#"), F.lpad(n.cast("string"), 9, "0"))
    )
    return fx.page(spark, d).withColumns(
        {
            "name": name,
            "event_time": F.timestamp_seconds(F.lit(1704067200) + n * 60),
        }
    )


@query(
    "st2_deduped_arrivals",
    "select distinct domain from f_domain where domain <> ''",
)
def st2(spark, d):
    source = arrivals(spark, d).select("page_id", "url", "event_time")
    root = fresh_path(spark, "st2")

    def start(stream):
        kept = J.deduped_arrivals(stream, "3650 days").select("domain", "page_id")
        return J.run_batches(
            kept, lambda df, i: J.put_batch(df, f"{root}/kept", i), f"{root}/checkpoint"
        )

    feed(source, "page_id", start)
    schema = T.StructType([T.StructField("domain", T.StringType()), T.StructField("page_id", T.LongType())])
    # repeats would show as more rows than the SQL gives
    return J.batches_before(spark, f"{root}/kept", schema).filter("domain <> ''").select("domain")


_WAVES = 4


@query(
    "st2_returning_arrivals",
    """with n as (select 2 * ceil((max(page_id) + 1) / 8.0)::bigint as size from pages),
    present as (select distinct domain, page_id // size as wave from pages join f_domain using (url), n
        where domain <> ''),
    w0 as (select domain from present where wave = 0),
    w1 as (select domain from present where wave = 1 and domain not in (from w0)),
    w2 as (select domain from present where wave = 2 and domain not in (from w1)),
    w3 as (select domain from present where wave = 3 and domain not in (from w2))
    select domain, 0::bigint as wave from w0 union all select domain, 1 from w1
    union all select domain, 2 from w2 union all select domain, 3 from w3""",
)
def st2_returning(spark, d):
    """Arrivals in four waves of equal length under a delay of half a wave, so that a
    domain is free again one wave after the wave it was kept in. Pages come a second time
    one wave late: of the first wave all, which are repeats or late; of the second and
    third those behind the watermark. None of these counts."""
    pages = arrivals(spark, d).select("page_id", "url", "event_time")
    size = 2 * -(-(pages.agg(F.max("page_id")).first()[0] + 1) // (2 * _WAVES))
    wave = F.floor(F.col("page_id") / size)
    first_half = F.col("page_id") % size < size // 2
    again = pages.withColumn("wave", wave).filter(
        (F.col("wave") == 0) | first_half & (F.col("wave") < _WAVES - 1)
    )
    source = pages.withColumn("wave", wave).unionByName(
        again.withColumn("wave", F.col("wave") + 1)
    )
    root = fresh_path(spark, "st2-returning")

    def start(stream):
        kept = J.deduped_arrivals(stream, f"{30 * size - 1} seconds").select("domain", "wave")
        return J.run_batches(
            kept, lambda df, i: J.put_batch(df, f"{root}/kept", i), f"{root}/checkpoint"
        )

    feed(source, "wave", start, cuts=list(range(_WAVES)))
    schema = T.StructType([T.StructField("domain", T.StringType()), T.StructField("wave", T.LongType())])
    return J.batches_before(spark, f"{root}/kept", schema).filter("domain <> ''").select("domain", "wave")


def _scraping(spark, d) -> DataFrame:
    return R.accepted_reviews(fx.review(spark, d), fx.taxonomy(spark, d)).filter(
        "review_type = 'scraping_diagnostic'"
    ).select("id", "subject", "verdict", F.col("date_diagnosed").cast("timestamp").alias("date_diagnosed"))


@query("st3_running_latest", _LATEST.replace("KIND", "scraping_diagnostic"))
def st3(spark, d):
    rows = _scraping(spark, d)
    root = fresh_path(spark, "st3")
    feed(rows, "id", lambda stream: J.running_latest(stream, root))
    schema = T.StructType([rows.schema[c] for c in ("subject", "id", "verdict", "date_diagnosed")])
    return J.latest_written(spark, root, schema).select("subject", "id", "verdict")


@query(
    "st4_running_stability",
    f"""with {_SEQ} select source, cut, case when cut is null then 'sample_exhausted' else 'stability_reached' end
        as stop_reason from (select distinct source from seq) left join cuts using (source)""",
)
def st4(spark, d):
    rows = _scraping(spark, d).withColumnRenamed("subject", "source")
    root = fresh_path(spark, "st4")
    feed(rows, "id", lambda stream: J.running_stability(stream, root))
    return J.stability_written(spark, root)


_DELAY_S = 2 * 86400
_LATE_S = 10 * 86400


@query(
    "st4_stability_by_date",
    f"""with span as (select floor(epoch(min(date_diagnosed)))::bigint as low,
        floor(epoch(max(date_diagnosed)))::bigint as high from f_accepted
        where review_type = 'scraping_diagnostic'),
    arriving as (select *, floor(epoch(date_diagnosed))::bigint + id * 7919 % {_DELAY_S}
        + case when id % 10 = 3 then {_LATE_S} else 0 end as arrival
        from f_accepted where review_type = 'scraping_diagnostic'),
    waved as (select *, (arrival > low + (high - low) // 4)::int + (arrival > low + (high - low) * 2 // 4)::int
        + (arrival > low + (high - low) * 3 // 4)::int as wave from arriving, span),
    marks as (select w.wave, date_trunc('milliseconds', max(p.date_diagnosed)) - interval 2 day as mark
        from (select distinct wave from waved) w join waved p on p.wave < w.wave group by all),
    timely as (select * from waved left join marks using (wave) where mark is null or date_diagnosed > mark),
    {_SEQ.replace("f_accepted", "timely")}
    select source, cut, case when cut is null then 'sample_exhausted' else 'stability_reached' end
        as stop_reason, n from (select source, count(*) as n from seq group by source) left join cuts using (source)""",
)
def st4_by_date(spark, d):
    """Reviews arrive up to two days after their date, in any order, and one in ten of
    them ten days later still; under a delay of two days those behind the watermark drop
    out and the others count by date. A row without an id ends the stream."""
    rows = _scraping(spark, d).withColumnRenamed("subject", "source")
    date_s = F.floor(F.unix_micros("date_diagnosed") / 1_000_000)
    low, high = rows.agg(F.min(date_s), F.max(date_s)).first()
    late = F.when(F.col("id") % 10 == 3, _LATE_S).otherwise(0)
    arriving = rows.withColumn("arrival", date_s + F.col("id") * 7919 % _DELAY_S + late)
    end = spark.range(1).select(
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("id", "source", "verdict")],
        F.timestamp_seconds(F.lit(high + 10 * _LATE_S)).alias("date_diagnosed"),
        F.lit(high + 10 * _LATE_S).cast("long").alias("arrival"),
    )
    root = fresh_path(spark, "st4-by-date")
    feed(
        arriving.unionByName(end), "arrival",
        lambda stream: J.running_stability_by_date(stream, root, f"{_DELAY_S} seconds"),
        cuts=[low + (high - low) * i // 4 for i in (1, 2, 3)],
    )
    lengths = J.lengths_written(spark, root)
    return J.stability_written(spark, root).join(
        lengths.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).select("source", "cut", "stop_reason", "n")


@query("st1_incremental_ingest")
def st1(spark, d):
    source = arrivals(spark, d).drop("event_time")
    root = fresh_path(spark, "st1")
    companies, edges = fx.company(spark, d), fx.known_edge(spark, d)
    predictions, taxonomy = fx.prediction(spark, d), fx.taxonomy(spark, d)

    def start(stream):
        return J.ingest_batches(
            stream, predictions, taxonomy, companies, edges, root, fx.RULES, threshold=0.6
        )

    feed(source, "page_id", start, 2)
    added = J.batches_before(spark, f"{root}/edges", edges.schema)
    return added.select("id", "company_a", "company_b", "score", "batch")
