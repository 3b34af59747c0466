"""Pair scoring: chunks, payloads, pluggable scorers and reply checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.constants import CHUNK_SIZE
from tagweave.dataflow import durable, rank_within
from tagweave.functions.tags import jaccard
from tagweave.functions.text import clamp_score

# A scorer takes candidate pairs and returns them with a ``score`` column.
Scorer = Callable[[DataFrame], DataFrame]


def chunked(pairs: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Number the candidates of each company and assign chunks of ``size``, in name order.

    Lists of candidates (company_a, before, others) hold that order, so they are numbered in
    place; pairs are sorted."""
    if "others" in pairs.columns:
        one = pairs.select("company_a", "before", F.posexplode("others").alias("_i", "company_b"))
        numbered = one.select("company_a", "company_b", (F.col("before") + F.col("_i") + 1).alias("pos"))
    else:
        numbered = rank_within(pairs, ["company_a"], [F.col("company_b")])
    return numbered.withColumn("chunk", F.floor((F.col("pos") - 1) / size).cast("long"))


def chunk_payloads(chunks: DataFrame, companies: DataFrame) -> DataFrame:
    """One JSON request per (company, chunk): the company and its slim candidates.
    A chunk holds at most the chunk size, so the collected lists are short."""
    slim = companies.select(
        "name", F.struct("name", "description", "sectors", "subsectors").alias("slim")
    )
    probe = slim.select(F.col("name").alias("company_a"), F.col("slim").alias("new_company"))
    other = slim.select(F.col("name").alias("company_b"), F.col("slim").alias("candidate"))
    lists = (
        chunks.select("company_a", "company_b", "chunk", "pos").join(other, ["company_b"])
        .groupBy("company_a", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "candidate"))).alias("ranked"))
    )
    return lists.join(probe, ["company_a"]).select(
        "company_a",
        "chunk",
        F.to_json(
            F.struct(
                "new_company",
                F.transform("ranked", lambda r: r["candidate"]).alias("candidates"),
            )
        ).alias("payload"),
    )


def accepted_scores(raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """Keep scores of real candidates only, clamped to [0, 1]. ``raw`` is
    (company_a, name, score text)."""
    named = raw.select(
        "company_a", F.col("name").alias("company_b"), clamp_score("score").alias("score")
    ).filter(F.col("score").isNotNull())
    return chunks.select("company_a", "company_b", "pos").join(named, ["company_a", "company_b"])


def ranked_scores(scored: DataFrame, tie: str = "pos") -> DataFrame:
    """Rank every company's scored candidates, best first, ties in candidate order."""
    return rank_within(scored, ["company_a"], [F.col("score").desc(), F.col(tie)], "rank")


def top_candidates(scored: DataFrame, k: int, tie: str = "company_b") -> DataFrame:
    """The k best candidates of each company. Spark keeps k rows per company before
    the shuffle, so a company with many candidates costs one task little."""
    best = W.partitionBy("company_a").orderBy(F.col("score").desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


# ---- built-in scorers ---------------------------------------------------------


def jaccard_scorer(pairs: DataFrame) -> DataFrame:
    """Jaccard of sectors and subsectors together; pairs must carry their tags."""
    return pairs.withColumn(
        "score",
        jaccard(F.array_union("sectors_a", "subsectors_a"), F.array_union("sectors_b", "subsectors_b")),
    )


def cosine_scorer(vectors: DataFrame) -> Scorer:
    """Cosine of the two companies' vectors (id, vector); pairs without both score null."""

    def dot(x: str, y: str):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )

    def score(pairs: DataFrame) -> DataFrame:
        normed = vectors.select("id", "vector").withColumn("norm", F.sqrt(dot("vector", "vector")))

        def side(s: str) -> DataFrame:
            return normed.select(*[F.col(c).alias(f"{c}{s}") for c in ("id", "vector", "norm")])

        pairs = durable(pairs, "pairs")
        joined = pairs.join(side("_a"), ["id_a"], "left")
        joined = joined.join(side("_b"), ["id_b"], "left")
        return joined.withColumn(
            "score",
            F.try_divide(dot("vector_a", "vector_b"), F.col("norm_a") * F.col("norm_b")),
        ).drop("vector_a", "vector_b", "norm_a", "norm_b")

    return score


def term_weights(descriptions: DataFrame) -> DataFrame:
    """Unit-length TF-IDF weights (id, term, weight), idf = ln((1 + n) / (1 + df))."""
    words = descriptions.select(
        "id", F.explode(F.split(F.lower("description"), r"[^\p{L}]+")).alias("term")
    ).filter(F.col("term") != "")
    counts = words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    uses = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = descriptions.filter("description is not null").agg(F.count(F.lit(1)).alias("n"))
    raw = (
        counts.join(uses, ["term"])
        .crossJoin(F.broadcast(total))
        .withColumn("weight", F.col("tf") * F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)))
        .filter(F.col("weight") > 0)
    )
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return raw.join(norms, "id").select("id", "term", (F.col("weight") / F.col("norm")).alias("weight"))


def tfidf_scorer(descriptions: DataFrame) -> Scorer:
    """TF-IDF cosine of whole descriptions (id, description). Only the given pairs
    meet: the first company's terms are looked up among the second's."""

    def score(pairs: DataFrame) -> DataFrame:
        weights = durable(term_weights(descriptions), "term-weights")
        ids = pairs.select("id_a", "id_b").distinct()
        first = weights.select(
            F.col("id").alias("id_a"), F.col("term"), F.col("weight").alias("_wa")
        )
        second = weights.select(
            F.col("id").alias("id_b"), F.col("term"), F.col("weight").alias("_wb")
        )
        dots = (
            ids.join(first, "id_a")
            .join(second, ["id_b", "term"])
            .groupBy("id_a", "id_b")
            .agg(F.sum(F.col("_wa") * F.col("_wb")).alias("score"))
        )
        return pairs.join(dots, ["id_a", "id_b"], "left").withColumn(
            "score", F.coalesce("score", F.lit(0.0))
        )

    return score


def score_band(score: str) -> Column:
    """Name of the band a score falls in."""
    return (
        F.when(F.col(score) >= 0.9, "substitute")
        .when(F.col(score) >= 0.75, "overlap")
        .otherwise("none")
    )
