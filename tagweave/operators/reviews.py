"""Review-log operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.constants import (
    MIN_DIAGNOSED,
    READINESS_QUEUE,
    READINESS_WINDOW,
    REVIEW_TYPES,
    SPLIT_VERDICTS,
)
from tagweave.dataflow import durable
from tagweave.functions.tags import has_tag
from tagweave.functions.text import EDGE_BLANKS
from tagweave.functions.urls import normalize_domain


def _stripped(col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), EDGE_BLANKS, "")


def _known_subsectors(taxonomy: DataFrame) -> DataFrame:
    return (
        taxonomy.filter("subsector is not null")
        .select(F.col("subsector").alias("subject"), F.lit(True).alias("_known"))
        .distinct()
    )


def _clean_subject() -> Column:
    """Subject in the form its review type stores it."""
    return (
        F.when(F.col("review_type") == "taxonomy_split", F.col("subject"))
        .when(F.col("review_type") == "scraping_diagnostic", normalize_domain("subject"))
        .otherwise(_stripped("subject"))
    )


def checked_reviews(reviews: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Every review with its normalized subject and its first error (null if valid)."""
    kind = F.col("review_type")
    split = kind == "taxonomy_split"
    error = (
        F.when(~F.coalesce(kind.isin(*REVIEW_TYPES), F.lit(False)), "unknown review_type")
        .when(_stripped("verdict") == "", "blank verdict")
        .when(split & F.col("_known").isNull(), "unknown subsector")
        .when(split & ~F.col("verdict").isin(*SPLIT_VERDICTS), "unknown verdict")
        .when((kind == "scraping_diagnostic") & (F.col("clean_subject") == ""), "no domain")
        .when(~split & (F.col("clean_subject") == ""), "blank subject")
    )
    joined = reviews.join(_known_subsectors(taxonomy), ["subject"], "left")
    return (
        joined.withColumn("clean_subject", _clean_subject())
        .withColumn("error", error)
        .drop("_known")
        .withColumn("clean_subject", F.when(F.col("error").isNull(), F.col("clean_subject")))
    )


def accepted_reviews(reviews: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Valid reviews with the normalized subject in place."""
    return (
        checked_reviews(reviews, taxonomy)
        .filter("error is null")
        .withColumn("subject", F.col("clean_subject"))
        .select(*reviews.columns)
    )


def rejected_reviews(reviews: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return checked_reviews(reviews, taxonomy).filter("error is not null")


def constraint_split(reviews: DataFrame) -> DataFrame:
    """Row constraints of the stored table: type and subject not blank, snapshot a
    JSON object or null. Adds ``violation`` (null if the row may be stored)."""
    snapshot = F.schema_of_variant(F.try_parse_json("source_snapshot"))
    is_object = F.coalesce(snapshot.startswith("OBJECT"), F.lit(False))
    return reviews.withColumn(
        "violation",
        F.when(_stripped("review_type") == "", "blank review_type")
        .when(_stripped("subject") == "", "blank subject")
        .when(F.col("source_snapshot").isNotNull() & ~is_object, "snapshot is no object"),
    )


def _valid_requests(requests: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The requests that are not refused, with the normalized subject as ``wanted``."""
    kind = F.col("review_type")
    joined = requests.join(_known_subsectors(taxonomy), "subject", "left")
    return (
        joined.withColumn("wanted", F.when(F.col("subject").isNotNull(), _clean_subject()))
        .filter(kind.isin(*REVIEW_TYPES))
        .filter(
            F.col("subject").isNull()
            | F.when(kind == "taxonomy_split", F.col("_known").isNotNull()).otherwise(
                F.col("wanted") != ""
            )
        )
        .select("request_id", "review_type", "subject", "wanted")
    )


def query_reviews(reviews: DataFrame, requests: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Answer requests (request_id, review_type, subject or null) over stored reviews.
    A request is checked and normalized as strictly as a write; refused requests
    give no rows. Clean-up subjects are trimmed, as on write."""
    valid = _valid_requests(requests, taxonomy).drop("subject")
    by_type = valid.filter("wanted is null").drop("wanted")
    by_subject = valid.filter("wanted is not null").withColumnRenamed("wanted", "subject")
    return reviews.join(by_type, "review_type").unionByName(
        reviews.join(by_subject, ["review_type", "subject"])
    )


def distinct_questions(requests: DataFrame, taxonomy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, asked): what the requests ask, each question once as a request of its own
    (request_id, review_type, subject), and the question of each request: (request_id,
    question). Requests whose subjects are stored alike, as the addresses of one domain are,
    ask the same; refused requests ask nothing."""
    asked = durable(
        _valid_requests(requests, taxonomy).withColumn(
            "question", F.to_json(F.struct("review_type", "wanted"))
        ),
        "asked",
    )
    # any of the subjects will do, as all of them are stored alike
    questions = asked.groupBy("question", "review_type").agg(F.min("subject").alias("subject"))
    return (
        questions.withColumnRenamed("question", "request_id"),
        asked.select("request_id", "question"),
    )


def latest_per_subject(reviews: DataFrame) -> DataFrame:
    """Newest review of each subject, the lowest id on ties. An aggregate, so rows of
    a busy subject combine before the shuffle."""
    rest = [c for c in reviews.columns if c != "subject"]
    newest = F.max_by(F.struct(*rest), F.struct(F.col("date_diagnosed"), -F.col("id")))
    return reviews.groupBy("subject").agg(newest.alias("_row")).select("subject", "_row.*")


def with_recency(latest: DataFrame, window: int = READINESS_WINDOW) -> DataFrame:
    """Flag the ``window`` newest of one row per subject."""
    newest = (
        latest.orderBy(F.col("date_diagnosed").desc(), F.col("id"))
        .limit(window)
        .select("subject", F.lit(True).alias("recent"))
    )
    # at most ``window`` rows
    return latest.join(F.broadcast(newest), "subject", "left").withColumn(
        "recent", F.coalesce("recent", F.lit(False))
    )


def readiness(
    reviews: DataFrame,
    queue: Iterable[str] = READINESS_QUEUE,
    min_diagnosed: int = MIN_DIAGNOSED,
    window: int = READINESS_WINDOW,
) -> DataFrame:
    """Whether enough queued subsectors are diagnosed and the newest ones brought no
    new verdict: one row with counts, new verdicts, decision and reasons."""
    queue = list(queue)
    diagnosed = latest_per_subject(
        reviews.filter((F.col("review_type") == "taxonomy_split") & F.col("subject").isin(*queue))
    )
    # at most one row per queue entry from here on
    flagged = with_recency(diagnosed, window)
    seen = flagged.agg(
        F.count(F.lit(1)).alias("diagnosed"),
        F.array_sort(F.collect_set(F.when(F.col("recent"), F.col("verdict")))).alias("last"),
        F.collect_set(F.when(~F.col("recent"), F.col("verdict"))).alias("before"),
    )
    fresh = seen.withColumn("new_types", F.array_except("last", "before"))
    enough = F.col("diagnosed") >= min_diagnosed
    stable = (F.col("diagnosed") >= window) & (F.size("new_types") == 0)
    # fixed values: the wording of the reasons is part of the result
    reasons = F.concat_ws(
        "; ",
        F.when(
            ~enough,
            F.concat(
                F.lit("only "), F.col("diagnosed").cast("string"),
                F.lit(f"/{min_diagnosed} minimum diagnosed"),
            ),
        ),
        F.when(
            F.size("new_types") > 0,
            F.concat(
                F.lit(f"new fracture type(s) in the last {window}: "),
                F.array_join("new_types", ", "),
            ),
        ).when(
            F.col("diagnosed") < window,
            F.lit(f"fewer than {window} diagnosed subsectors so far"),
        ),
    )
    return fresh.select(
        "diagnosed",
        enough.alias("count_ready"),
        "new_types",
        stable.alias("stability_ready"),
        (enough & stable).alias("ready"),
        reasons.alias("reasons"),
    )


def guardrail(
    companies: DataFrame, reviews: DataFrame, subsector: str | None = None
) -> DataFrame:
    """Companies whose site has a diagnosis, with the newest one and whether it is a
    problem: (subsector, id, name, domain, verdict, problem). ``subsector`` limits
    the members; by default every subsector is checked."""
    latest = latest_per_subject(
        reviews.filter(F.col("review_type") == "scraping_diagnostic")
    ).select(F.col("subject").alias("domain"), "verdict")
    members = companies if subsector is None else companies.filter(has_tag("subsectors", subsector))
    sites = members.filter(F.coalesce(F.col("website"), F.lit("")) != "").select(
        "id", "name", normalize_domain("website").alias("domain"), "subsectors"
    )
    covered = sites.join(latest, ["domain"]).withColumn(
        "problem", ~F.col("verdict").eqNullSafe("ok")
    )
    tag = F.explode(F.array_distinct("subsectors")) if subsector is None else F.lit(subsector)
    return covered.select(tag.alias("subsector"), "id", "name", "domain", "verdict", "problem")


def guardrail_outcome(covered: DataFrame, subsectors: DataFrame) -> DataFrame:
    """Outcome per subsector: nothing covered, no problem, or how many problems."""
    counts = covered.groupBy("subsector").agg(
        F.count(F.lit(1)).alias("covered"), F.count_if("problem").alias("problems")
    )
    zero = F.lit(0).cast("long")
    joined = subsectors.select("subsector").distinct().join(counts, "subsector", "left")
    return joined.select(
        "subsector",
        F.coalesce("covered", zero).alias("covered"),
        F.coalesce("problems", zero).alias("problems"),
    ).withColumn(
        "outcome",
        F.when(F.col("covered") == 0, "not_diagnosed")
        .when(F.col("problems") == 0, "no_problem")
        .otherwise("problems"),
    )


def stability_cut(
    ordered: DataFrame, label: str, streak: int, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Where a sequence (pos = 1, 2, ...) is stable: the first position at which
    ``streak`` rows in a row brought no new label; null if never.

    Needs only the first position of each label, an aggregate that combines before
    the shuffle; the sequence itself is never gathered.
    """
    firsts = ordered.groupBy(*keys, label).agg(F.min("pos").alias("first"))
    last = ordered.groupBy(*keys).agg(F.max("pos").alias("last"))
    return cut_of_firsts(firsts, last, streak, keys)


def cut_of_firsts(
    firsts: DataFrame, last: DataFrame, streak: int, keys: tuple[str, ...] = ()
) -> DataFrame:
    """:func:`stability_cut` from first positions (``first``) and lengths (``last``)."""
    keys = list(keys)
    by_first = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy("first")
    gaps = firsts.withColumn("next", F.lead("first").over(by_first))
    quiet = gaps.withColumn("reach", F.col("first") + F.lit(streak)).filter(
        F.col("next").isNull() | (F.col("next") > F.col("reach"))
    )
    cuts = quiet.groupBy(*keys).agg(F.min("reach").alias("reach"))
    # a null key is a group like any other
    renamed = cuts.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = last.join(renamed, reduce(and_, same)) if keys else last.crossJoin(cuts)
    return joined.select(
        *keys,
        F.when(F.col("reach") <= F.col("last"), F.col("reach")).alias("cut"),
        F.when(F.col("reach") <= F.col("last"), "stability_reached")
        .otherwise("sample_exhausted")
        .alias("stop_reason"),
    )
