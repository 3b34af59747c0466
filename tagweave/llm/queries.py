"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import (
    alignment,
    codec,
    fingerprints,
    hard_negatives,
    html_text,
    jaccard,
    language,
    metric_tree,
    mixing,
    packing,
    pieces,
    secrets,
    token_files,
)
from tagweave.llm.store import fresh_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the texts of documents as flat token files and count by their separators."""
    path = fresh_path(spark, "flat")
    token_files.write_flat(_documents(spark, sf_dir), path, BPE)
    return token_files.scan_flat(spark, path)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(_documents(spark, sf_dir), path="source")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), BPE, added_tokens=True)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write documents as a corpus folder and read it back."""
    path = fresh_path(spark, "corpus")
    codec.write_tokens(_documents(spark, sf_dir), path, BPE, added_tokens=True)
    return codec.read_tokens(spark, path, digest=True)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_documents(spark, sf_dir))


def held_out() -> Column:
    """Whether a document's lang is kept from training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.fit(docs, ~held_out())
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_documents(spark, sf_dir), PIECES, digest=True)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", metric_tree.quantised(F.col("embedding")).alias("v")
    )
    pages = metric_tree.index(vectors)
    return metric_tree.top_k(pages, vectors.filter(F.col("vec_id") % 100 == 0))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings; every seventh vec_id has its label moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", moved.alias("label"), hard_negatives.whole(F.col("embedding")).alias("v")
    )
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix of all documents takes of each."""
    return mixing.taken(_documents(spark, sf_dir))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of the byte-level and the sentence-piece tokens of documents."""
    return alignment.align(_documents(spark, sf_dir), BPE, PIECES, digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_counts,
        op2_secret_scan,
        op3_fingerprints,
        op4_best_fit_packing,
        op5_token_output,
        op6_jaccard_join,
        op7_language_id,
        op8_main_text,
        op9_sentence_pieces,
        op10_top_k,
        op11_hard_negatives,
        op12_source_mix,
        op13_token_alignment,
    )
}
ORACLES: dict[str, str] = {
    "op10_top_k": """
    WITH q AS (
      SELECT vec_id,
             list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), pairs AS (
      SELECT a.vec_id AS query_id, b.vec_id,
             CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT)
               AS score
      FROM q a JOIN q b ON a.vec_id <> b.vec_id
      WHERE a.vec_id % 100 = 0
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
      FROM pairs
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_hard_negatives": """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0)
               AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE a.vec_id % 100 = 0
    ), positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r
        FROM scored WHERE same
      ) WHERE r <= 5
    ), ranked AS (
      SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (
               PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id,
           positive_score, negative_score
    FROM ranked WHERE rank <= 5
    """,
}
