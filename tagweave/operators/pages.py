"""Bulk page jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.constants import DIAGNOSIS_STREAK
from tagweave.dataflow import durable, global_rank, seeded
from tagweave.functions.html import (
    favicon_link,
    light_gate,
    logo_candidates,
    notes_on,
    page_text,
    prefixed_text,
    profile_link,
    verdict_of,
    with_text_facts,
)
from tagweave.functions.urls import normalize_domain
from tagweave.operators.reviews import stability_cut


def page_facts(pages: DataFrame) -> DataFrame:
    """Everything a light fetch yields: text, gate, profile link, logo candidates."""
    texts = pages.withColumns(
        {
            "domain": normalize_domain("url"),
            "body": page_text("html"),
            "profile": profile_link("html", "url"),
            "favicon": favicon_link("html", "url"),
            "logos": logo_candidates("html", "url"),
        }
    ).drop("html")
    return with_text_facts(texts, "body").select(
        "page_id",
        "url",
        "domain",
        light_gate("body").alias("gate"),
        prefixed_text("body", "profile").alias("text"),
        F.col("profile").alias("linkedin_url"),
        "favicon",
        "logos",
    )


def characterized(pages: DataFrame) -> DataFrame:
    """Adds ``verdict`` and ``notes`` on each page's text, in place of its html."""
    texts = with_text_facts(pages.withColumn("body", page_text("html")).drop("html"), "body")
    judged = texts.withColumn("verdict", verdict_of("body"))
    return judged.withColumn("notes", notes_on("verdict", "body")).drop(
        "body", "phrase", "noise", "n_lines"
    )


def page_diagnoses(pages: DataFrame) -> DataFrame:
    return characterized(pages.withColumn("domain", normalize_domain("url"))).select(
        "page_id", "url", "domain", "verdict", "notes"
    )


def diagnose(
    pages: DataFrame, known: DataFrame, seed: int = 0, streak: int = DIAGNOSIS_STREAK
) -> tuple[DataFrame, DataFrame]:
    """Diagnose sites in seeded random order, one page per domain, skipping domains
    in ``known`` (subject), until ``streak`` in a row bring no new verdict.

    Returns the review rows to append and a one-row summary.
    """
    placed = pages.select(
        "page_id", "url", "html",
        normalize_domain("url").alias("domain"),
        seeded(seed, "url").alias("_key"),
    )
    # the first page of each domain, chosen before any text is extracted
    order = F.struct("_key", "page_id")
    firsts = (
        placed.filter("domain <> ''")
        .groupBy("domain")
        .agg(F.min(order).alias("_first"))
        .join(known.select(F.col("subject").alias("domain")), "domain", "left_anti")
        .select("domain", "_first.*")
    )
    queue = durable(global_rank(firsts, [F.col("_key"), F.col("page_id")]), "diagnosis-order")
    # a cut comes after a streak at the earliest, so no more than twice the pages that
    # count have their text extracted
    total, done, size, parts = queue.count(), 0, 2 * streak, []
    while True:
        wanted = queue.filter(F.col("pos").between(done + 1, size))
        texts = placed.drop("domain").join(wanted, ["_key", "page_id"])
        found = characterized(texts).select("page_id", "domain", "_key", "verdict", "notes", "pos")
        parts.append(durable(found, "diagnosed"))
        ranked = reduce(DataFrame.unionByName, parts)
        cut = durable(stability_cut(ranked, "verdict", streak), "diagnosis-cut")
        if size >= total or not cut.filter("cut is not null").isEmpty():
            break
        done, size = size, 2 * size
    # the cut is one row
    kept = ranked.crossJoin(F.broadcast(cut)).filter(
        F.col("cut").isNull() | (F.col("pos") <= F.col("cut"))
    )
    reviews = kept.select(
        F.lit("scraping_diagnostic").alias("review_type"),
        F.col("domain").alias("subject"),
        "verdict",
        "notes",
        "pos",
    )
    done = kept.agg(
        F.count(F.lit(1)).alias("characterized"),
        F.array_sort(F.collect_set("verdict")).alias("labels_seen"),
        F.max(F.struct("_key", "page_id")).alias("_end"),
        F.first("cut").alias("cut"),
        F.first("stop_reason").alias("stop_reason"),
    )
    # skipped sites count only as far as the run got
    seen = (
        placed.select("domain", order.alias("_at"))
        .crossJoin(F.broadcast(done))
        .filter(F.col("cut").isNull() | (F.col("_at") <= F.col("_end")))
        .agg(
            F.count_if(F.col("domain") == "").alias("skipped_invalid"),
            F.count_if(F.col("domain") != "").alias("_valid"),
        )
    )
    summary = done.crossJoin(F.broadcast(seen)).select(
        "characterized",
        (F.col("_valid") - F.col("characterized")).alias("skipped_known"),
        "skipped_invalid",
        "labels_seen",
        F.coalesce("stop_reason", F.lit("sample_exhausted")).alias("stop_reason"),
    )
    return reviews, summary
