"""Edge maintenance: saving, recalibrating, validating, and reading as a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.constants import DEFAULT_COLOUR, SCORE_THRESHOLD, SECTOR_COLOURS
from tagweave.dataflow import durable, seeded
from tagweave.functions.tags import tags
from tagweave.operators.overlap import symmetric, without_exact, without_linked

_TEXT_COLUMNS = ("description", "website", "flaticon_url", "logo_url", "linkedin_url")


def reaches(score: Column | str, threshold: float = SCORE_THRESHOLD) -> Column:
    col = F.col(score) if isinstance(score, str) else score
    return F.coalesce(col, F.lit(0.0)) >= threshold


def _one_per_pair(scored: DataFrame) -> DataFrame:
    """One row per directed pair of a batch: the highest score."""
    return scored.groupBy("company_a", "company_b").agg(F.max("score").alias("score"))


def to_save(scored: DataFrame, edges: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Scored pairs worth saving that no edge links in either direction."""
    return without_linked(_one_per_pair(scored.filter(reaches("score", threshold))), edges)


def to_save_directed(
    scored: DataFrame, edges: DataFrame, threshold: float = SCORE_THRESHOLD
) -> DataFrame:
    """Scored pairs worth saving that are not stored in this very direction."""
    return without_exact(_one_per_pair(scored.filter(reaches("score", threshold))), edges)


def neighbours(edges: DataFrame) -> DataFrame:
    """Linked companies of each company, both directions, repeats kept."""
    return symmetric(edges)


def existing_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs stored as an edge in the given direction."""
    return pairs.join(
        edges.select("company_a", "company_b"), ["company_a", "company_b"], "left_semi"
    )


def recalibrated(edges: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Edges below the threshold become inactive. Never the other way round."""
    below = ~reaches("score", threshold)
    return edges.withColumn(
        "active", F.when(below & F.col("active"), F.lit(False)).otherwise(F.col("active"))
    )


def recalibration_counts(edges: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    below, active = ~reaches("score", threshold), F.coalesce(F.col("active"), F.lit(False))
    return edges.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(below & active).alias("newly_inactive"),
        F.count_if(below & ~active).alias("already_inactive"),
        F.count_if(~below).alias("still_active"),
    ).withColumn("threshold_used", F.lit(float(threshold)))


def without_dangling(edges: DataFrame, companies: DataFrame) -> DataFrame:
    """Edges whose two ends are both known companies. Edges are far more than names, so the
    names that no company has are found first, and edges are shuffled only if these are many."""
    ends = edges.select(F.explode(F.array("company_a", "company_b")).alias("name"))
    # written, as the join would otherwise be moved below the distinct and shuffle every end
    ends = durable(ends.filter("name is not null").distinct(), "edge-ends")
    unknown = durable(ends.join(companies.select("name"), "name", "left_anti"), "unknown-names")
    kept = edges.filter("company_a is not null and company_b is not null")
    for end in ("company_a", "company_b"):
        kept = kept.join(unknown.withColumnRenamed("name", end), end, "left_anti")
    return kept.select(*edges.columns)


def unordered(edges: DataFrame) -> DataFrame:
    return edges.withColumns(
        {
            "u": F.least("company_a", "company_b"),
            "v": F.greatest("company_a", "company_b"),
        }
    )


def first_per_pair(edges: DataFrame, *order: str) -> DataFrame:
    """The first row of every unordered pair, as an aggregate that combines before
    the shuffle, so many copies of one pair are no hot group."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    picked = F.min_by(F.struct(*rest), F.struct(*order))
    return unordered(edges).groupBy("u", "v").agg(picked.alias("_row")).select("_row.*")


def node_details(names: DataFrame, companies: DataFrame, key: str = "name") -> DataFrame:
    """Details of named nodes; unknown names and missing fields get empty values."""
    known = companies.select(
        F.col("name").alias(key), "sectors", "subsectors", *_TEXT_COLUMNS
    )
    joined = names.join(known, [key], "left")
    return joined.select(
        *names.columns,
        tags("sectors").alias("sectors"),
        tags("subsectors").alias("subsectors"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in _TEXT_COLUMNS],
    )


def ego_links(edges: DataFrame, centres: DataFrame | None = None) -> DataFrame:
    """Active edges around each centre, one per unordered pair, the outgoing row first:
    (centre, source, target, score). ``centres`` (name) limits which ones."""
    active = edges.filter("active").select("id", "company_a", "company_b", "score")
    around = active.withColumns(
        {"centre": F.col("company_a"), "other": F.col("company_b"), "incoming": F.lit(False)}
    ).unionByName(
        active.withColumns(
            {"centre": F.col("company_b"), "other": F.col("company_a"), "incoming": F.lit(True)}
        )
    )
    if centres is not None:
        around = around.join(centres.select(F.col("name").alias("centre")), "centre", "left_semi")
    row = F.struct("company_a", "company_b", "score")
    return (
        around.groupBy("centre", "other")
        .agg(F.min_by(row, F.struct("incoming", "id")).alias("_row"))
        .select(
            "centre",
            F.col("_row.company_a").alias("source"),
            F.col("_row.company_b").alias("target"),
            F.col("_row.score").alias("score"),
        )
    )


def ego_nodes(edges: DataFrame, companies: DataFrame, centres: DataFrame | None = None) -> DataFrame:
    """Every centre and its neighbours with details: (centre, name, is_centre, ...)."""
    links = ego_links(edges, centres)
    around = links.select(
        "centre",
        F.when(F.col("source") == F.col("centre"), F.col("target"))
        .otherwise(F.col("source"))
        .alias("name"),
    )
    middle = (links.select("centre") if centres is None else centres.select(F.col("name").alias("centre")))
    names = around.union(middle.select("centre", F.col("centre").alias("name"))).distinct()
    return node_details(names, companies).withColumn(
        "is_centre", F.col("name") == F.col("centre")
    )


def graph_nodes(companies: DataFrame) -> DataFrame:
    return companies.select(
        "name",
        tags("sectors").alias("sectors"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in _TEXT_COLUMNS],
    )


def graph_links(edges: DataFrame, companies: DataFrame) -> DataFrame:
    """Active links between known companies, as listed: (source, target, score)."""
    return without_dangling(edges.filter("active"), companies).select(
        F.col("company_a").alias("source"),
        F.col("company_b").alias("target"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def link_radii(links: DataFrame) -> DataFrame:
    """Degree over links as listed and the node radius 5 + 15 * degree / max degree."""
    degrees = (
        links.select(F.col("source").alias("name"))
        .unionAll(links.select(F.col("target").alias("name")))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    top = degrees.agg(F.max("degree").alias("_max"))
    # the maximum is a single row
    return degrees.crossJoin(F.broadcast(top)).select(
        "name", "degree", (F.lit(5.0) + F.lit(15.0) * F.col("degree") / F.col("_max")).alias("radius")
    )


def link_style(links: DataFrame) -> DataFrame:
    s = F.coalesce(F.col("score"), F.lit(0.0))
    return links.withColumns(
        {
            "width": F.lit(1.0) + F.lit(4.0) * s,
            "ego_width": F.lit(1.5) + F.lit(5.0) * s,
            "opacity": F.lit(0.15) + F.lit(0.45) * s,
            "ego_radius": F.lit(10.0) + F.lit(12.0) * s,
        }
    )


def node_colour(
    companies: DataFrame, colours: dict[str, str] = SECTOR_COLOURS, default: str = DEFAULT_COLOUR
) -> DataFrame:
    """Colour of a company's first sector."""
    first = F.get(tags("sectors"), F.lit(0))
    colour = F.lit(default)
    if colours:
        table = F.create_map(*[F.lit(x) for kv in colours.items() for x in kv])
        colour = F.coalesce(F.try_element_at(table, F.coalesce(first, F.lit(""))), F.lit(default))
    return companies.select("name", colour.alias("colour"))


# ---- validation of saved pairs ------------------------------------------------


def unchecked(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("checked") & F.col("active"))


def validation_sample(edges: DataFrame, pool: int = 100, size: int = 5, seed: int = 0) -> DataFrame:
    """A repeatable random sample of the first unchecked active edges."""
    return (
        unchecked(edges).orderBy("id").limit(pool).orderBy(seeded(seed, "id"), "id").limit(size)
    )


def with_company_facts(pairs: DataFrame, companies: DataFrame) -> DataFrame:
    """Attach name, description, sectors and subsectors of both ends as structs."""
    facts = ("name", "description", "sectors", "subsectors")

    def side(key: str, out: str) -> DataFrame:
        return companies.select(F.col("name").alias(key), F.struct(*facts).alias(out))

    first = pairs.join(side("company_a", "facts_a"), ["company_a"], "left")
    return first.join(side("company_b", "facts_b"), ["company_b"], "left")


def with_verdicts(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Merge (company_a, company_b, is_competitor): matched edges become checked."""
    decided = verdicts.groupBy("company_a", "company_b").agg(
        F.max(F.coalesce("is_competitor", F.lit(False))).alias("_ok")
    )
    merged = edges.join(decided, ["company_a", "company_b"], "left")
    hit = F.col("_ok").isNotNull()
    return merged.withColumns(
        {
            "checked": F.when(hit, F.lit(True)).otherwise(F.col("checked")),
            "validated": F.when(hit, F.col("_ok")).otherwise(F.col("validated")),
        }
    ).select(*edges.columns)


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("is_competitor"), F.lit(False))
    return verdicts.agg(
        F.count_if(ok).alias("validated"), F.count_if(~ok).alias("invalidated")
    )
