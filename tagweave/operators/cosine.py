"""Pairs of texts whose TF-IDF cosine reaches a threshold, without forming the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.dataflow import durable, pair_join
from tagweave.operators.scoring import term_weights

# slack for sums taken in another order
_SLACK = 1e-9


def vector_prefixes(weights: DataFrame, threshold: float) -> DataFrame:
    """The rare part of each unit vector (id, term, weight): (id, term, weight, rest).

    Terms go by rising frequency. Once the norm of what is left falls below the threshold,
    two vectors whose first common term lies there cannot reach it, so that part, whose
    norm is ``rest``, needs no look-up.
    """
    uses = weights.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    order = W.partitionBy("id").orderBy(F.col("_df").desc(), F.col("term").desc())
    onward = F.sum(F.col("weight") * F.col("weight")).over(
        order.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    left = weights.join(uses, "term").withColumn("_left", onward)
    needed = F.col("_left") >= threshold * threshold - _SLACK
    after = F.max(F.when(~needed, F.col("_left"))).over(W.partitionBy("id"))
    return (
        left.withColumn("rest", F.sqrt(F.coalesce(after, F.lit(0.0))))
        .filter(needed)
        .select("id", "term", "weight", "rest")
    )


def candidate_pairs(prefixes: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs whose common rare terms and what is left of both
    may reach the threshold."""

    def side(s: str) -> DataFrame:
        return prefixes.select("term", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "weight", "rest")])

    met = pair_join(side("a"), side("b"), ["term"], ["id_a"], ["id_b"]).filter("id_a < id_b")
    summed = met.groupBy("id_a", "id_b").agg(
        F.sum(F.col("weight_a") * F.col("weight_b")).alias("_sure"),
        F.max(F.greatest("rest_a", "rest_b")).alias("_rest"),
    )
    return summed.filter(F.col("_sure") + F.col("_rest") >= threshold - _SLACK).select("id_a", "id_b")


def similar_texts(descriptions: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, score), id_a < id_b: all pairs of ``descriptions`` (id unique,
    description) whose TF-IDF cosine is at least ``threshold`` (over 0). Exact.

    Equal texts are one vector until the end. Null texts and those whose words are in
    every text have no vector and no pair.
    """
    texts = durable(
        descriptions.filter("description is not null").select("id", F.sha2("description", 256).alias("_text")),
        "cosine-texts",
    )
    classes = texts.groupBy("_text").agg(F.min("id").alias("rep"))
    weights = durable(term_weights(descriptions), "cosine-weights")
    members = durable(
        texts.join(classes, "_text").join(weights.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi")
        .select("id", "rep"),
        "cosine-members",
    )
    single = durable(
        weights.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "cosine-vectors"
    )
    prefixes = durable(vector_prefixes(single, threshold), "cosine-prefixes")
    candidates = durable(candidate_pairs(prefixes, threshold), "cosine-candidates")
    # a text's distinct terms
    vectors = single.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("v")
    )

    def side(s: str) -> DataFrame:
        return vectors.select(F.col("id").alias(f"id_{s}"), F.col("v").alias(f"v_{s}"))

    # one pass over the terms of both
    products = F.map_zip_with("v_a", "v_b", lambda term, x, y: F.coalesce(x * y, F.lit(0.0)))
    dot = F.aggregate(F.map_values(products), F.lit(0.0), lambda acc, x: acc + x)
    alike = (
        candidates.join(side("a"), "id_a").join(side("b"), "id_b")
        .select("id_a", "id_b", dot.alias("score"))
        .filter(F.col("score") >= threshold - _SLACK)
    )

    def of(rep: str, out: str) -> DataFrame:
        return members.select(F.col("rep").alias(rep), F.col("id").alias(out))

    across = alike.join(of("id_a", "x"), "id_a").join(of("id_b", "y"), "id_b")
    within = pair_join(of("rep", "x"), of("rep", "y"), ["rep"], ["x"], ["y"]).filter("x < y")
    return across.select(
        F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "score"
    ).unionByName(
        within.select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), F.lit(1.0).alias("score"))
    )
