"""A training-data pipeline over ``documents``.

Documents whose language cannot be told go; of each group of near copies one document
stays; secrets in what is left are blanked; the texts are packed into token sequences.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.llm import jaccard, language, packing, secrets
from tagweave.llm.queries import BPE
from tagweave.llm.store import durable, small_batches, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects: those without a letter,
    and texts far from every language of the labelled documents."""
    small_batches(spark)
    model = language.fit(docs, F.lit(True))
    return language.predict(docs, model).filter("not rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked documents, that with the smallest doc_id
    (null counts as the largest), and one of rows that repeat a doc_id and its text."""
    small_batches(spark)
    row, copy = unused(docs, "_row", "_copy")
    # doc_ids may be null or repeat, so rows are told apart by their places in the files
    numbered = placed(docs, row)
    groups = jaccard.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("row"))
    kept = (
        groups.select(F.col("doc_id").alias(row), "component_id")
        .join(numbered.select(row, "doc_id"), row)
        .groupBy("component_id").agg(F.min(order).alias("first"))
        .select(F.col("first.row").alias(row))
    )
    rows = numbered.join(kept, row, "left_semi")
    same = W.partitionBy("doc_id", F.xxhash64("text"), F.length("text")).orderBy(row)
    return (
        rows.withColumn(copy, F.row_number().over(same)).filter(F.col(copy) == 1).drop(copy, row)
    )


def placed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the file and row that each row is read from as a column: the same
    whenever it is read. Only rows that come from no files are written first."""
    place = F.concat_ws(
        "#", "_metadata.file_path", F.lpad(F.col("_metadata.row_index").cast("string"), 15, "0")
    )
    try:
        return docs.select("*", place.alias(name))
    except AnalysisException:
        return durable(docs, "documents").select("*", place.alias(name))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blank the secrets in texts; every document stays."""
    small_batches(spark)
    return secrets.redact(docs, path="source")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, BPE, added_tokens=True)


STAGES = [
    ("language identification", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scan", secret_scan),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # tokens, clusters and forests are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
