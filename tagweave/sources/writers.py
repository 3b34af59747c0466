"""Append, update and upsert of the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.dataflow import durable, global_rank
from tagweave.schemas import COMPANY, EDGE, REVIEW, evolve


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_report(rows: DataFrame, path: str, by: str | None = None) -> None:
    """A report as JSON records, one folder per value of ``by``."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def _numbered(df: DataFrame, order: Sequence[str], start: int) -> DataFrame:
    return global_rank(df, [F.col(c) for c in order], "_n").withColumn(
        "id", F.col("_n") + F.lit(start)
    ).drop("_n")


def review_rows(reviews: DataFrame, start_id: int = 0, order: Sequence[str] = ("subject", "review_type")) -> DataFrame:
    """New review rows in the stored schema: ids after ``start_id``, missing optional
    columns null, the diagnosis dated now unless given."""
    df = _numbered(reviews, order, start_id)
    if "date_diagnosed" not in df.columns:
        df = df.withColumn("date_diagnosed", F.current_timestamp())
    return evolve(df, REVIEW)


def edge_rows(saved: DataFrame, start_id: int = 0) -> DataFrame:
    """New edge rows in the stored schema: active, unchecked, not validated."""
    return evolve(_numbered(saved, ["company_a", "company_b"], start_id), EDGE)


def update_by_key(
    table: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Set ``columns`` on the rows whose keys occur in ``changes`` (unique per key)."""
    given = changes.select(*keys, F.struct(*columns).alias("_new"))
    joined = table.join(given, keys, "left")
    hit = F.col("_new").isNotNull()
    return joined.withColumns(
        {c: F.when(hit, F.col("_new")[c]).otherwise(F.col(c)) for c in columns}
    ).select(*table.columns)


def upsert_matches(companies: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds ``match_id`` to each batch row: the stored company with the same non-empty
    website, else the one with the same name, lowest id first; null if new."""
    def key(column: str, out: str) -> DataFrame:
        return (
            companies.filter(F.coalesce(F.col(column), F.lit("")) != "")
            .groupBy(column)
            .agg(F.min("id").alias(out))
        )

    joined = batch.join(key("website", "_by_site"), ["website"], "left")
    joined = joined.join(key("name", "_by_name"), ["name"], "left")
    return joined.withColumn("match_id", F.coalesce("_by_site", "_by_name")).drop(
        "_by_site", "_by_name"
    )


# when stored values were set: before any row of a batch
_BEFORE = -(2**63)


def _values(rows: DataFrame, *columns: Column) -> DataFrame:
    """One row per (website or name) of each row, websites as kind 0."""
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("website").alias("value")),
        F.struct(F.lit(1).alias("kind"), F.col("name").alias("value")),
    )
    out = rows.select(*columns, F.explode(both).alias("_v"))
    return out.select("*", "_v.kind", "_v.value").drop("_v")


def _changes(events: DataFrame, *keys: str) -> DataFrame:
    """The events that differ from the one before them, and the first of each group."""
    before = F.lag(F.struct("value")).over(W.partitionBy(*keys).orderBy("at"))
    same = before.isNotNull() & before["value"].eqNullSafe(F.col("value"))
    return events.withColumn("_same", same).filter(~F.col("_same")).drop("_same")


def _held_spans(placed: DataFrame, values: DataFrame, held: DataFrame, write_nulls: bool) -> DataFrame:
    """When each company has which website and name if rows fall to companies as
    ``placed`` says: (kind, value, class, number, at, until), the rows that set and end it.

    Repeats collapse inside blocks of positions first, so that a company which takes much
    of a batch leaves its changes only. A holder with a lower one beside it all the time
    is never chosen, so it is left out.
    """
    events = (
        values.join(placed.select("pos", "class", "number"), "pos")
        .select("class", "number", F.col("pos").alias("at"), "kind", "value")
        .unionByName(held)
    )
    if not write_nulls:
        events = events.filter("value is not null")
    owner = ["class", "number", "kind"]
    events = events.withColumn("_block", F.shiftright("at", 17))
    changes = _changes(_changes(events, *owner, "_block"), *owner)
    spans = changes.withColumn("until", F.lead("at").over(W.partitionBy(*owner).orderBy("at")))
    company = F.struct("class", "number")
    earlier = W.partitionBy("kind", "value").orderBy("at", "class", "number")
    lowest = F.min(F.when(F.col("until").isNull(), company)).over(
        earlier.rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        spans.filter("value <> ''")
        .withColumn("_lowest", lowest)
        .filter(F.col("_lowest").isNull() | (company < F.col("_lowest")))
        .select("kind", "value", "class", "number", "at", "until")
    )


def _followed(rows: DataFrame, values: DataFrame, spans: DataFrame) -> DataFrame:
    """(pos, class, number) of the company that each row falls to if values are held as
    ``spans`` says. A row follows the row that set the value it matches by; rows that
    follow others are led to the first one by doubling."""
    met = (
        values.filter("value <> ''")
        .join(spans, ["kind", "value"])
        .filter("at < pos and (until is null or pos <= until)")
        .groupBy("pos")
        .agg(F.min(F.struct("kind", "class", "number", "at")).alias("_m"))
    )
    stored = F.coalesce(F.col("_m.at") == F.lit(_BEFORE), F.lit(False))
    steps = rows.select("pos").join(met, "pos", "left").select(
        "pos",
        F.when(stored, 0).otherwise(1).alias("class"),
        F.when(stored, F.col("_m.number")).otherwise(F.coalesce("_m.at", "pos")).alias("number"),
        (stored | F.col("_m").isNull()).alias("settled"),
    )
    while True:
        steps = durable(steps, "upsert-steps")
        if steps.filter("not settled").isEmpty():
            return steps.drop("settled")
        ahead = steps.select(
            F.col("pos").alias("number"),
            F.struct("class", "number", "settled").alias("_ahead"),
        )
        moved = steps.filter("not settled").select("pos", "number").join(ahead, "number")
        steps = steps.filter("settled").unionByName(moved.select("pos", "_ahead.*"))


def upsert_entities(companies: DataFrame, batch: DataFrame, write_nulls: bool = False) -> DataFrame:
    """Adds to each batch row the company that it falls to when rows are applied one
    after the other in the order of ``pos``: ``match_id`` of a stored company, or
    ``entity``, the ``pos`` of the row that makes a new one.

    A row matches by website, else by name, what stored companies and earlier rows have
    by then, renames included; the lowest number is taken, stored ones first.

    Rounds of joins find this without replaying rows. The first one supposes that what a
    company once has it keeps. Each further one works out from the companies found so far
    who holds what and when, and matches all rows against that, until nothing changes. A
    round is right at least one row further than the one before, since a row depends on
    earlier rows only, so the result is that of a replay; rounds are few unless renames
    keep overturning later matches.
    """
    rows = durable(batch.select(F.col("pos").cast("long").alias("pos"), "website", "name"), "upsert-rows")
    values = _values(rows, F.col("pos"))
    asked = values.filter("value <> ''").select("kind", "value").distinct()
    # values that no row asks for cannot matter
    held = durable(
        _values(
            companies, F.lit(0).alias("class"), F.col("id").cast("long").alias("number"),
            F.lit(_BEFORE).cast("long").alias("at"),
        ).join(asked, ["kind", "value"], "left_semi"),
        "upsert-held",
    )
    lowest = held.groupBy("kind", "value").agg(
        F.lit(0).alias("class"), F.min("number").alias("number"), F.first("at").alias("at")
    )
    first = values.filter("value <> ''").groupBy("kind", "value").agg(
        F.lit(1).alias("class"), F.min("pos").alias("number"), F.min("pos").alias("at")
    )
    spans = lowest.unionByName(first).withColumn("until", F.lit(None).cast("long"))
    placed = _followed(rows, values, spans)
    while True:
        spans = _held_spans(placed, values, held, write_nulls)
        again = _followed(rows, values, spans)
        old = placed.select("pos", F.struct("class", "number").alias("_old"))
        moved = again.join(old, "pos").filter(F.struct("class", "number") != F.col("_old"))
        placed = again
        if moved.isEmpty():
            break
    return batch.join(
        placed.select(
            "pos",
            F.expr("case when class = 0 then number end").alias("match_id"),
            F.expr("case when class = 1 then number end").alias("entity"),
        ),
        "pos",
        "left",
    )


def upsert_changes(
    companies: DataFrame, batch: DataFrame, version: str = "v2", write_nulls: bool = False
) -> tuple[DataFrame, DataFrame]:
    """What a batch, in arrival order (``pos``, unique), changes in the company table.

    Rows are applied one after the other, as :func:`upsert_entities` says; later values
    win. A null leaves the stored value alone unless ``write_nulls``. A row without a
    name changes nothing. Returns the changed and new company rows, and (pos, name,
    action, id) with 'saved', 'updated' or 'refused' for every row of the batch.
    """
    if "website" not in batch.columns:
        batch = batch.withColumn("website", F.lit(None).cast("string"))
    nameless = F.coalesce(F.col("name"), F.lit("")) == ""
    refused = batch.filter(nameless)
    batch = batch.filter(~nameless)
    placed = durable(upsert_entities(companies, batch, write_nulls), "upsert-match")
    columns = [c for c in batch.columns if c in companies.columns and c != "id"]

    def last_values(rows: DataFrame, key: str) -> DataFrame:
        # a struct, so that a null value is one that can win
        latest = F.struct(*[F.col(c) for c in columns])
        if write_nulls:
            last = rows.groupBy(key).agg(F.max_by(latest, "pos").alias("_last"))
            return last.select(key, "_last.*")
        return rows.groupBy(key).agg(
            *[
                F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
                for c in columns
            ]
        )

    known = placed.filter("match_id is not null")
    changes = last_values(known, "match_id").select(
        F.col("match_id").alias("id"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    value = (lambda c: F.col(f"_new_{c}")) if write_nulls else (lambda c: F.coalesce(f"_new_{c}", c))
    updated = companies.join(changes, "id").withColumns(
        {**{c: value(c) for c in columns}, "taxonomy_version": F.lit(version)}
    ).select(*companies.columns)

    new = placed.filter("match_id is null").drop("match_id")
    fresh = last_values(new, "entity").withColumn("taxonomy_version", F.lit(version))
    top = companies.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    # ids follow on from the highest one, which is a single value
    inserted = durable(
        global_rank(fresh, [F.col("entity")], "_n")
        .crossJoin(F.broadcast(top))
        .withColumn("id", F.col("_n") + F.col("_top")),
        "upsert-new",
    )
    numbers = inserted.select("entity", "id")
    actions = known.select(
        "pos", "name", F.lit("updated").alias("action"), F.col("match_id").alias("id")
    ).unionByName(
        new.join(numbers, ["entity"]).select(
            "pos", "name",
            F.when(F.col("entity") == F.col("pos"), "saved").otherwise("updated").alias("action"),
            "id",
        )
    ).unionByName(
        refused.select(
            "pos", "name", F.lit("refused").alias("action"), F.lit(None).cast("long").alias("id")
        )
    )
    return updated.unionByName(evolve(inserted, COMPANY).select(*companies.columns)), actions


def upsert_companies(
    companies: DataFrame, batch: DataFrame, version: str = "v2", write_nulls: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The whole company table after :func:`upsert_changes`, and the actions."""
    changed, actions = upsert_changes(companies, batch, version, write_nulls)
    changed = durable(changed, "upsert-changed")
    kept = companies.join(changed.select("id"), "id", "left_anti")
    return kept.select(*companies.columns).unionByName(changed), actions


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or an empty one before its first write."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:
        return like.limit(0)
