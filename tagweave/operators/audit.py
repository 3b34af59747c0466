"""Tag audits and clean-up jobs over the company table."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.constants import AUDITED_HORIZONTALS, HORIZONTAL_SUBSECTORS, UNCATEGORIZED
from tagweave.functions.tags import (
    audited_conflict,
    default_uncategorized,
    drop_redundant_uncategorized,
    has_tag,
    is_empty,
    tags,
)
from tagweave.functions.text import percent


def tag_distribution(companies: DataFrame, column: str) -> DataFrame:
    """Companies per tag, as (tag, n)."""
    return (
        companies.select(F.explode(tags(column)).alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def singleton_tags(companies: DataFrame, column: str = "subsectors") -> DataFrame:
    return tag_distribution(companies, column).filter("n = 1").select("tag")


def taxonomy_drift(companies: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Companies with subsectors outside the taxonomy, and which, in order."""
    known = taxonomy.select(F.col("subsector").alias("tag")).distinct()
    return (
        companies.select("id", "name", F.posexplode(tags("subsectors")).alias("pos", "tag"))
        .filter(F.col("tag") != UNCATEGORIZED)
        .join(known, "tag", "left_anti")
        .groupBy("id", "name")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("found"))
        .select("id", "name", F.transform("found", lambda x: x["tag"]).alias("unknown_subsectors"))
    )


def anomaly_flags(
    companies: DataFrame,
    taxonomy: DataFrame,
    audited: Iterable[str] = AUDITED_HORIZONTALS,
    horizontal: Iterable[str] = HORIZONTAL_SUBSECTORS,
    max_tags: int = 3,
) -> DataFrame:
    """One row per company with a flag for each kind of anomaly."""
    drift = taxonomy_drift(companies, taxonomy).select("id", F.lit(True).alias("drift"))
    flagged = companies.withColumns(
        {
            "empty_subsectors": is_empty("subsectors") & ~is_empty("sectors"),
            "empty_sectors": is_empty("sectors"),
            "uncategorized": has_tag("subsectors", UNCATEGORIZED),
            "over_tagged": F.size(tags("subsectors")) > max_tags,
            "conflict": F.size(audited_conflict("subsectors", audited, horizontal)) > 0,
        }
    )
    return flagged.join(drift, "id", "left").withColumn(
        "drift", F.coalesce("drift", F.lit(False))
    )


FLAGS = ("empty_subsectors", "empty_sectors", "uncategorized", "over_tagged", "conflict", "drift")


def any_flag() -> Column:
    out = F.lit(False)
    for f in FLAGS:
        out = out | F.col(f)
    return out


def audit_summary(flagged: DataFrame) -> DataFrame:
    """Totals and percentages over :func:`anomaly_flags`."""
    counts = flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~is_empty("sectors") & ~is_empty("subsectors")).alias("classified"),
        F.count_if(any_flag()).alias("with_anomalies"),
    )
    return counts.select(
        "total",
        "classified",
        percent(F.col("classified"), F.col("total")).alias("pct_classified"),
        "with_anomalies",
        percent(F.col("with_anomalies"), F.col("total")).alias("pct_anomalies"),
    )


def anomaly_list(flagged: DataFrame, flag: str, *columns: str) -> DataFrame:
    return flagged.filter(F.col(flag)).select(*columns)


def anomalous_ids(flagged: DataFrame) -> DataFrame:
    """Distinct ids over all anomaly classes."""
    return flagged.filter(reduce(or_, map(F.col, FLAGS))).select("id").distinct()


def horizontal_conflicts(
    companies: DataFrame,
    audited: Iterable[str] = AUDITED_HORIZONTALS,
    horizontal: Iterable[str] = HORIZONTAL_SUBSECTORS,
) -> DataFrame:
    """Companies with an audited horizontal tag next to a vertical one."""
    return companies.withColumn(
        "horizontal_tags", audited_conflict("subsectors", audited, horizontal)
    ).filter(F.size("horizontal_tags") > 0)


def report_document(companies: DataFrame, taxonomy: DataFrame, **rules) -> DataFrame:
    """The audit as one stream of report rows (section, key, value JSON). A section
    can be as long as the table, so it stays rows and is never folded into one."""
    flagged = anomaly_flags(companies, taxonomy, **rules)

    def rows(df: DataFrame, section: str, key: Column) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"), key.alias("key"), F.to_json(F.struct("*")).alias("value")
        )

    parts = [
        rows(audit_summary(flagged), "summary", F.lit("all")),
        rows(tag_distribution(companies, "sectors"), "sector_distribution", F.col("tag")),
        rows(tag_distribution(companies, "subsectors"), "subsector_distribution", F.col("tag")),
        rows(singleton_tags(companies), "singletons", F.col("tag")),
        rows(
            anomaly_list(flagged, "empty_subsectors", "name", "website", "sectors"),
            "empty_subsectors_with_sectors", F.col("name"),
        ),
        rows(anomaly_list(flagged, "empty_sectors", "name"), "empty_sectors", F.col("name")),
        rows(
            anomaly_list(flagged, "uncategorized", "name", "subsectors"),
            "uncategorized", F.col("name"),
        ),
        rows(
            anomaly_list(flagged, "over_tagged", "name", "subsectors"),
            "over_tagged", F.col("name"),
        ),
        rows(
            anomaly_list(flagged, "conflict", "name", "sectors", "subsectors"),
            "horizontal_conflicts", F.col("name"),
        ),
        rows(
            taxonomy_drift(companies, taxonomy).select("name", "unknown_subsectors"),
            "taxonomy_drift", F.col("name"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- clean-up jobs ------------------------------------------------------------


def _snapshot(subsectors: Column) -> Column:
    return F.to_json(F.struct(subsectors.alias("subsectors")))


def redundant_uncategorized_fixes(companies: DataFrame) -> DataFrame:
    """Rows with Uncategorized next to other tags: before, after, and whether it changes."""
    hit = has_tag("subsectors", UNCATEGORIZED) & (F.size(tags("subsectors")) > 1)
    return companies.filter(hit).select(
        "id",
        "name",
        F.col("subsectors").alias("before"),
        drop_redundant_uncategorized("subsectors").alias("after"),
    ).withColumn("fixed", F.col("before") != F.col("after"))


def empty_subsector_fixes(companies: DataFrame) -> DataFrame:
    return companies.filter(is_empty("subsectors")).select(
        "id",
        "name",
        tags("subsectors").alias("before"),
        default_uncategorized("subsectors").alias("after"),
        F.lit(True).alias("fixed"),
    )


def fix_reviews(fixes: DataFrame, review_type: str, notes: str) -> DataFrame:
    """Review rows that record applied fixes."""
    return fixes.filter("fixed").select(
        F.lit(review_type).alias("review_type"),
        F.col("name").alias("subject"),
        F.lit("fixed").alias("verdict"),
        _snapshot(F.col("before")).alias("source_snapshot"),
        F.to_json("after").alias("resolution"),
        F.lit(notes).alias("notes"),
    )


def apply_fixes(companies: DataFrame, fixes: DataFrame) -> DataFrame:
    """Companies with the fixed subsectors in place."""
    changed = fixes.filter("fixed").select("id", F.col("after").alias("_after"))
    joined = companies.join(changed, "id", "left")
    return joined.withColumn("subsectors", F.coalesce("_after", "subsectors")).select(
        *companies.columns
    )


def fix_counts(fixes: DataFrame) -> DataFrame:
    return fixes.agg(
        F.count_if("fixed").alias("fixed"), F.count_if(~F.col("fixed")).alias("skipped")
    )


def moved_out(before: DataFrame, after: DataFrame, subsector: str) -> DataFrame:
    """Companies that had the subsector and no longer do after reclassification."""
    had = before.filter(has_tag("subsectors", subsector)).select("id", "name")
    lost = after.filter(~has_tag("subsectors", subsector)).select("id", "subsectors")
    return had.join(lost, "id")
