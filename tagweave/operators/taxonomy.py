"""From label predictions to tags.

The predictions of one company are few, so they are gathered into one row early;
every later rule is a column expression on that row and needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.constants import (
    GENERIC_SUBSECTOR,
    HORIZONTAL_SECTORS,
    HORIZONTAL_SUBSECTORS,
    MAX_SUB_SUBSECTORS,
    MIN_SECTOR_CONFIDENCE,
    MIN_SUBSECTOR_CONFIDENCE,
    REDIRECT_SUBSECTORS,
    UNCATEGORIZED,
)
from tagweave.dataflow import durable
from tagweave.functions.tags import (
    default_uncategorized,
    demote_generic,
    drop_horizontal,
    drop_redundant_uncategorized,
    literals,
)


@dataclass(frozen=True)
class TagRules:
    """Parameters of the tag rules."""

    horizontal: tuple[str, ...] = HORIZONTAL_SUBSECTORS
    exempt_sectors: tuple[str, ...] = HORIZONTAL_SECTORS
    generic: str = GENERIC_SUBSECTOR
    redirects: tuple[str, ...] = REDIRECT_SUBSECTORS
    min_sector_confidence: float = MIN_SECTOR_CONFIDENCE
    min_subsector_confidence: float = MIN_SUBSECTOR_CONFIDENCE
    max_sub_subsectors: int = MAX_SUB_SUBSECTORS


def _level(prediction: DataFrame, level: str) -> DataFrame:
    return prediction.filter(F.col("level") == level)


def sector_gate(
    prediction: DataFrame, taxonomy: DataFrame, min_confidence: float = MIN_SECTOR_CONFIDENCE
) -> DataFrame:
    """Valid sectors of each company in order, or [Uncategorized] when there is none
    or the confidence is too low: (id, sectors, confidence)."""
    known = taxonomy.select(F.col("sector").alias("label"), F.lit(True).alias("known")).distinct()
    labelled = prediction.select("id", "level", "label", "pos", "confidence").withColumn(
        "label", F.when(F.col("level") == "sector", F.col("label"))
    )
    gathered = (
        labelled.join(known, "label", "left")
        .groupBy("id")
        .agg(
            F.max(F.when(F.col("level") == "sector", F.col("confidence"))).alias("confidence"),
            F.array_sort(
                F.collect_list(F.when(F.col("known"), F.struct("pos", "label")))
            ).alias("valid"),
        )
    )
    labels = F.transform("valid", lambda v: v["label"])
    confidence = F.coalesce("confidence", F.lit(0.0))
    refused = (F.size("valid") == 0) | (confidence < min_confidence)
    return gathered.select(
        "id",
        F.when(refused, literals([UNCATEGORIZED])).otherwise(labels).alias("sectors"),
        confidence.alias("confidence"),
    )


def subsector_gate(
    sectors: DataFrame, prediction: DataFrame, taxonomy: DataFrame
) -> DataFrame:
    """Valid subsectors under each accepted sector, Uncategorized with confidence 1
    where there is none: (id, sector, sector_pos, label, pos, confidence)."""
    known = taxonomy.select("sector", F.col("subsector").alias("label")).distinct()
    valid = (
        _level(prediction, "subsector")
        .join(known, ["sector", "label"], "left_semi")
        .groupBy("id", "sector", "label")
        .agg(F.min("pos").alias("pos"), F.max_by("confidence", "pos").alias("confidence"))
    )
    slots = sectors.select("id", F.posexplode("sectors").alias("sector_pos", "sector"))
    return slots.join(valid, ["id", "sector"], "left").select(
        "id",
        "sector",
        "sector_pos",
        F.coalesce("label", F.lit(UNCATEGORIZED)).alias("label"),
        F.coalesce("pos", F.lit(1)).alias("pos"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def sub_subsector_gate(prediction: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Predicted sub-subsectors that the taxonomy defines under their parents."""
    known = (
        taxonomy.filter("sub_subsector is not null")
        .select("sector", "subsector", F.col("sub_subsector").alias("label"))
        .distinct()
    )
    return _level(prediction, "sub_subsector").join(
        known, ["sector", "subsector", "label"], "left_semi"
    )


def best_sector(sectors: Column, confidences: Column) -> Column:
    """Sector of the highest confidence, the first one on ties."""
    ranked = F.transform(
        sectors,
        lambda s, i: F.struct(
            F.coalesce(F.try_element_at(confidences, s), F.lit(0.0)).alias("c"),
            (-i).alias("p"),
            s.alias("s"),
        ),
    )
    return F.array_max(ranked)["s"]


def top_labels(found: Column, limit: int) -> Column:
    """Distinct labels by highest confidence, first seen first on ties.
    ``found`` is an array of {label, confidence} in order of appearance."""
    labels = F.array_distinct(F.transform(found, lambda x: x["label"]))
    ranked = F.transform(
        labels,
        lambda label, i: F.struct(
            (-F.array_max(
                F.transform(
                    F.filter(found, lambda x: x["label"] == label), lambda x: x["confidence"]
                )
            )).alias("c"),
            i.alias("p"),
            label.alias("label"),
        ),
    )
    return F.slice(F.transform(F.array_sort(ranked), lambda r: r["label"]), 1, limit)


def _all_of(labels: Column, allowed: Iterable[str]) -> Column:
    return F.forall(labels, lambda s: F.array_contains(literals(allowed), s))


def proposals(prediction: DataFrame, taxonomy: DataFrame, rules: TagRules) -> DataFrame:
    """One row per company: sectors, confidence, and per sector the accepted
    subsectors: proposals array<{sector, subs: array<{label, confidence}>}>."""
    sectors = sector_gate(prediction, taxonomy, rules.min_sector_confidence)
    subs = (
        subsector_gate(sectors, prediction, taxonomy)
        .groupBy("id", "sector", "sector_pos")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "label", "confidence"))).alias("subs"))
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("sector_pos", "sector", "subs"))).alias("props"))
    )
    return sectors.join(subs, "id").withColumn(
        "proposals",
        F.transform(
            "props",
            lambda p: F.struct(
                p["sector"].alias("sector"),
                F.transform(
                    p["subs"],
                    lambda s: F.struct(
                        s["label"].alias("label"), s["confidence"].alias("confidence")
                    ),
                ).alias("subs"),
            ),
        ),
    ).drop("props")


def clean_subsectors(subsectors: Column, sectors: Column, rules: TagRules) -> Column:
    """The three tag rules in their fixed order."""
    kept = drop_horizontal(subsectors, sectors, rules.horizontal, rules.exempt_sectors)
    kept = demote_generic(kept, rules.generic, rules.redirects)
    return drop_redundant_uncategorized(kept)


def _is_weak(prop: Column, valid: Column, rules: TagRules) -> Column:
    """Whether a sector has nothing left to stand on."""
    kept = F.filter(prop["subs"], lambda s: F.array_contains(valid, s["label"]))
    scored = F.filter(kept, lambda s: s["label"] != UNCATEGORIZED)
    real = F.filter(
        F.transform(prop["subs"], lambda s: s["label"]), lambda s: s != UNCATEGORIZED
    )
    exempt = (F.size(real) > 0) & _all_of(real, rules.horizontal)
    all_low = (F.size(scored) > 0) & F.forall(
        scored, lambda s: s["confidence"] < rules.min_subsector_confidence
    )
    return F.when(F.size(kept) == 0, ~exempt).otherwise(all_low)


def pruned(proposed: DataFrame, rules: TagRules) -> DataFrame:
    """Apply the tag rules and drop weak sectors, never all of them. Adds ``cleaned``
    (tags after the rules), ``kept`` (surviving proposals) and ``subsectors``."""
    labels = F.array_distinct(
        F.flatten(
            F.transform("proposals", lambda p: F.transform(p["subs"], lambda s: s["label"]))
        )
    )
    df = proposed.withColumn("proposed_subsectors", labels)
    df = df.withColumn(
        "cleaned", clean_subsectors(F.col("proposed_subsectors"), F.col("sectors"), rules)
    )
    weak = F.transform(
        F.filter("proposals", lambda p: _is_weak(p, F.col("cleaned"), rules)),
        lambda p: p["sector"],
    )
    several = F.size("sectors") >= 2
    df = df.withColumn("weak", F.when(several, weak).otherwise(literals([])))
    shared = F.map_from_arrays(
        F.array_distinct("sectors"),
        F.transform(F.array_distinct("sectors"), lambda _: F.col("confidence")),
    )
    spared = best_sector(F.col("sectors"), shared)
    all_weak = F.size(F.array_except("sectors", "weak")) == 0
    df = df.withColumn(
        "removed",
        F.when(all_weak & (F.size("weak") > 0), F.filter("weak", lambda s: s != spared)).otherwise(
            F.col("weak")
        ),
    )
    df = df.withColumn(
        "kept",
        F.transform(
            F.filter("proposals", lambda p: ~F.array_contains("removed", p["sector"])),
            lambda p: F.struct(
                p["sector"].alias("sector"),
                F.filter(
                    p["subs"], lambda s: F.array_contains(F.col("cleaned"), s["label"])
                ).alias("subs"),
            ),
        ),
    )
    remaining = F.flatten(
        F.transform("kept", lambda p: F.transform(p["subs"], lambda s: s["label"]))
    )
    return df.withColumn("_remaining", remaining).withColumns(
        {
            "final_sectors": F.filter("sectors", lambda s: ~F.array_contains("removed", s)),
            "subsectors": F.when(
                several, F.filter("cleaned", lambda s: F.array_contains("_remaining", s))
            ).otherwise(F.col("cleaned")),
        }
    ).drop("_remaining")


def classify(
    prediction: DataFrame, taxonomy: DataFrame, rules: TagRules = TagRules()
) -> DataFrame:
    """Final tags per company: (id, sectors, subsectors, sub_subsectors, confidence,
    subsector_confidences).

    The result is written: a filter on it, pushed down through the rules, would
    repeat all of them many times over in one expression.
    """
    df = pruned(proposals(prediction, taxonomy, rules), rules)
    details = (
        sub_subsector_gate(prediction, taxonomy)
        .groupBy("id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("pos", "sector", "subsector", "label", "confidence"))
            ).alias("details")
        )
    )
    df = df.join(details, "id", "left")
    pairs = F.flatten(
        F.transform(
            "kept",
            lambda p: F.transform(
                p["subs"],
                lambda s: F.struct(p["sector"].alias("sector"), s["label"].alias("label")),
            ),
        )
    )
    found = F.flatten(
        F.transform(
            F.col("pairs"),
            lambda q: F.transform(
                F.filter(
                    "details",
                    lambda d: (d["sector"] == q["sector"]) & (d["subsector"] == q["label"]),
                ),
                lambda d: F.struct(d["label"].alias("label"), d["confidence"].alias("confidence")),
            ),
        )
    )
    confidences = F.map_from_entries(
        F.transform(
            "kept",
            lambda p: F.struct(
                p["sector"].alias("key"),
                F.map_from_entries(
                    F.transform(
                        p["subs"],
                        lambda s: F.struct(
                            s["label"].alias("key"), s["confidence"].alias("value")
                        ),
                    )
                ).alias("value"),
            ),
        )
    )
    df = df.withColumn("pairs", pairs).withColumn(
        "found", F.when(F.col("details").isNotNull(), found)
    )
    final = df.select(
        "id",
        F.col("final_sectors").alias("sectors"),
        default_uncategorized("subsectors").alias("subsectors"),
        F.coalesce(
            top_labels(F.col("found"), rules.max_sub_subsectors), literals([])
        ).alias("sub_subsectors"),
        "confidence",
        confidences.alias("subsector_confidences"),
    )
    return durable(final, "classified")


def without_transient(df: DataFrame, transient: Iterable[str] = ("confidence",)) -> DataFrame:
    """Drop columns that are never stored: confidences and names starting with '_'."""
    return df.drop(
        *[c for c in df.columns if c.startswith("_") or any(c.startswith(t) or c.endswith(t + "s") for t in transient)]
    )


def guarded_logo(url: Column | str, candidates: Column | str) -> Column:
    """The chosen URL, kept only if it is one of the row's candidates (when any)."""
    url = F.col(url) if isinstance(url, str) else url
    cands = F.col(candidates) if isinstance(candidates, str) else candidates
    urls = F.transform(cands, lambda c: c["url"])
    free = cands.isNull() | (F.size(cands) == 0)
    return F.when(free | F.array_contains(urls, url), url)
