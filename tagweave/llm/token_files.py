"""Token counts of flat token files: a vectorised search for end-of-document ids.

A flat file is the ids of its documents one after another, little-endian and of a fixed
width, each document followed by the separator id; it holds no index. It is read in
blocks by as many tasks, and documents that cross block borders are stitched by a prefix
scan over the blocks' summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.llm.bpe import encoder
from tagweave.llm.store import durable

SEPARATOR = 50_256
WIDTH = 2  # bytes of an id
BLOCK_IDS = 1 << 20
SUPER = 1024  # blocks summed up by one step of the prefix scan


def write_flat(
    docs: DataFrame, path: str, tokenizer: str, separator: int = SEPARATOR, width: int = WIDTH
) -> None:
    """Write the ids of the texts of ``docs`` as flat files, one for each task. A null
    text counts as empty, which leaves the separator alone. No row makes no document."""
    small = {2: "<u2", 4: "<u4"}[width]

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        for batch in batches:
            ids = [
                np.frombuffer(ids_of(text.as_py() or ""), "<u4").astype(small).tobytes()
                for text in batch.column(0)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["value"])

    # the text writer puts the line separator, here the bytes of the separator id, after
    # each row; a byte is a character of this charset
    docs.select("text").mapInArrow(flat, "value binary").select(
        F.col("value").cast("string")
    ).write.option("encoding", "ISO-8859-1").option(
        "lineSep", separator.to_bytes(width, "little").decode("latin-1")
    ).text(path)


def _open(path: str) -> pa.NativeFile:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path.removeprefix("file:")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def scan_flat(
    spark: SparkSession,
    path: str,
    separator: int = SEPARATOR,
    width: int = WIDTH,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """One row per document of the flat files in folder ``path``, in file order:

    file, doc_no (from 0 in the file), start (ids before it in the file, separators
    included), n_tokens (without its separator), and closed, which is false for ids
    after the last separator of a file. Bytes after the last whole id are ignored.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    blocks = files.select(
        "path",
        F.explode(
            F.expr(
                f"sequence(0L, greatest(0L, length div {width} - 1) div {block_ids})"
            )
        ).alias("block"),
        F.expr(f"length div {width}").alias("ids"),
    ).filter("ids > 0")
    # as many tasks as blocks need, not as files need
    n = max(1, blocks.count() // 4)
    spread = blocks.repartition(n, "path", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low = row["block"] * block_ids
                n = min(block_ids, row["ids"] - low)
                with _open(row["path"]) as source:
                    raw = source.read_at(n * width, low * width)
                found = np.flatnonzero(np.frombuffer(raw, f"<u{width}") == separator) + low
                yield pa.RecordBatch.from_pylist(
                    [row | {"found": found.tolist()}], schema=_SEARCHED
                )

    hits = durable(
        spread.mapInArrow(search, "path string, block long, ids long, found array<long>"),
        "separators",
    ).withColumn("step", F.expr(f"block div {SUPER}"))
    # prefix scan in two levels: separators so far, and where the last one was
    summary = hits.select(
        "path", "step", "block", F.size("found").alias("n"),
        F.when(F.size("found") > 0, F.element_at("found", -1)).alias("last"),
    )
    before = W.partitionBy("path").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    steps = summary.groupBy("path", "step").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    steps = steps.select(
        "path", "step",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("step_docs"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("step_last"),
    )
    inside = W.partitionBy("path", "step").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    scan = summary.select(
        "path", "step", "block",
        F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("docs"),
        F.max("last").over(inside).alias("last"),
    ).join(steps, ["path", "step"]).select(
        "path", "block", (F.col("step_docs") + F.col("docs")).alias("docs"),
        F.greatest("step_last", F.coalesce("last", F.lit(-1))).alias("last"),
    )
    # the ids after a file's last separator end with the file
    is_last = F.expr(f"block = (ids - 1) div {block_ids}")
    safe = F.expr("if(size(found) > 0, found[size(found) - 1], last)")
    ends = F.when(is_last & (safe < F.col("ids") - 1), F.concat("found", F.array("ids"))).otherwise(
        F.col("found")
    )
    rows = hits.join(scan, ["path", "block"]).select(
        "path", "block", "ids", "docs", "last", F.posexplode(ends).alias("i", "end"),
        F.col("found"),
    )
    start = F.expr("if(i = 0, last, found[i - 1]) + 1")
    return rows.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
        (F.col("docs") + F.col("i")).alias("doc_no"),
        start.alias("start"),
        (F.col("end") - start).alias("n_tokens"),
        (F.col("end") < F.col("ids")).alias("closed"),
    )


_SEARCHED = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("ids", pa.int64()),
     ("found", pa.list_(pa.int64()))]
)
