"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

A corpus is a folder with two tables. ``ranks`` maps a rank to a token id, the most
frequent id first. Each row of ``blocks`` holds consecutive documents in ascending
doc_id order (nulls first): their doc_ids and numbers of ids, the stream of control
bytes (four values to a byte, two bits each for the length of a rank less one) and the
stream of data bytes (little-endian ranks of one to four bytes). ``part`` and ``first``
place a block: the files of a part follow those of smaller parts, and ``first`` counts
the ids before it in its part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.llm.bpe import encoder
from tagweave.llm.store import durable

BLOCK_IDS = 500_000  # a block is closed when it holds so many ids
END_ID = 2

_IDS = "part long, first long, doc_ids array<long>, counts array<long>, ids binary"
_BLOCKS = _IDS.replace("ids binary", "control binary, data binary")

# for each control byte: the lengths of its four values and their sum
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_BEFORE = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
_TOTALS = _LENGTHS.sum(axis=1)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values. The last control byte is
    filled up with zeros, for which no data is written."""
    values = np.ascontiguousarray(values, "<u4")
    lengths = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``encode``, by looking control bytes up in a table."""
    code = np.frombuffer(control, np.uint8)
    raw = np.frombuffer(data + b"\0\0\0\0\0\0\0", np.uint8)
    totals = _TOTALS[code]
    base = np.cumsum(totals) - totals
    at = (base[:, None] + _BEFORE[code]).ravel()[:n]
    lengths = _LENGTHS[code].ravel()[:n]
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int, added_tokens: bool) -> DataFrame:
    """Blocks of ids of the documents in ascending doc_id order."""
    end = int(end_id).to_bytes(4, "little")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer, added_tokens).ids
        part, first, held = TaskContext.get().partitionId(), 0, 0
        doc_ids, counts, ids = [], [], []

        def block() -> pa.RecordBatch:
            nonlocal first, held
            frame = pd.DataFrame(
                {"part": [part], "first": [first], "doc_ids": [doc_ids[:]],
                 "counts": [counts[:]], "ids": [b"".join(ids)]}
            )
            first, held = first + held, 0
            for x in (doc_ids, counts, ids):
                x.clear()
            return pa.RecordBatch.from_pandas(frame, _arrow(_IDS), preserve_index=False)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(ids_of(text.as_py() or "") + end)
                doc_ids.append(doc_id)
                counts.append(len(ids[-1]) // 4)
                held += counts[-1]
                if held >= BLOCK_IDS:
                    yield block()
        if doc_ids:
            yield block()

    return (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(blocks, _IDS)
    )


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in ddl.split(", "))])


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, added_tokens: bool = False
) -> None:
    """Write the ids of ``docs`` (doc_id, text), ``end_id`` after each document, as a
    corpus folder at ``path``. Null texts are empty; rows with equal doc_ids follow each
    other. An empty table makes a corpus without blocks."""
    spark = docs.sparkSession
    ids = durable(_tokenised(docs, tokenizer, end_id, added_tokens), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for block in batch.column(0):
                found = np.bincount(np.frombuffer(block.as_py(), "<u4"))
                size = max(len(total), len(found))
                total = np.pad(total, (0, size - len(total))) + np.pad(found, (0, size - len(found)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used, "n": total[used]})

    # one row for each id of the vocabulary
    ranked = (
        ids.select("ids").mapInArrow(count, "id long, n long")
        .groupBy("id").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "id")
    )
    by_rank = np.array([r.id for r in ranked.select("id").collect()], np.int64)
    rank_of = np.zeros(int(by_rank.max(initial=-1)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame(
        [(i, int(x)) for i, x in enumerate(by_rank)], "rank long, id long"
    ).coalesce(1).write.parquet(f"{path}/ranks")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = rank_of[np.frombuffer(batch.column(4)[i].as_py(), "<u4")]
                control, data = encode(values)
                kept = [batch.column(k).slice(i, 1) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                    names=[f.name for f in _arrow(_BLOCKS)],
                )

    ids.mapInArrow(code, _BLOCKS).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a corpus folder: doc_id, start (ids of all documents before it),
    n_tokens, and ids as little-endian unsigned 32-bit integers, or with ``digest``
    their unsigned crc32 as ids_crc32."""
    by_rank = np.array(
        [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32
    )
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # one row for each part, of which there are as many as tasks that wrote
    sizes = blocks.groupBy("part").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")
    )
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    kind = "ids_crc32 long" if digest else "ids binary"
    out = pa.schema(
        [("doc_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()),
         ("n_tokens", pa.int64()), ("out", pa.int64() if digest else pa.binary())]
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                counts = np.array(block["counts"], np.int64)
                ends = np.cumsum(counts)
                ids = by_rank[decode(block["control"], block["data"], int(ends[-1]))]
                raw = ids.astype("<u4").tobytes()
                each = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["doc_ids"], pa.int64()),
                        pa.array(np.full(len(counts), block["part"])),
                        pa.array(block["first"] + ends - counts),
                        pa.array(counts),
                        pa.array([zlib.crc32(x) for x in each] if digest else each, out[4].type),
                    ],
                    schema=out,
                )

    found = blocks.mapInArrow(
        documents, f"doc_id long, part long, start long, n_tokens long, {kind}".replace(
            kind, f"out {kind.split(' ')[1]}"
        )
    )
    return found.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens",
        F.col("out").alias(kind.split(" ")[0]),
    )
