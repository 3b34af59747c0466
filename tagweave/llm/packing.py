"""Sum-of-squares packing of documents into token sequences.

An item of length s goes where the sum over all gaps g of N(g)**2 becomes smallest,
N(g) being the number of open sequences with g free tokens; ties go to the smallest
gap left. Only documents longer than a sequence are cut.

Items are dealt at random into shards of bounded size, each packed by one task, long
items first. The sequences that this leaves unfilled are packed again, first within the
shard and then together with those of other shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tagweave.llm.bpe import encoder
from tagweave.llm.store import durable, unused

CAPACITY = 1024
END_ID = 2
SHARD_ITEMS = 4096  # items that one task packs
UNFILLED = 0.015  # a sequence with a larger share free is packed again
MERGE_SHARDS = 16  # shards that take the unfilled sequences of all shards, or more

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    added_tokens: bool = False,
) -> DataFrame:
    """One row per piece of each document's ids (tokenizer ids, then ``end_id``).

    A document of at most ``capacity`` ids is one piece. A longer one is cut into
    pieces of ``capacity`` ids, of which the first has what is left over. Null and
    empty texts consist of the end id. Repeated and null doc_ids are kept as they are.
    """
    schema = to_arrow_schema(_parse_datatype_string(PIECES))
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer, added_tokens).ids
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "") + end
                total = len(ids) // 4
                low, high = 0, total % capacity or capacity
                piece = 0
                while low < total:
                    crc = zlib.crc32(ids[4 * low : 4 * high])
                    for column, value in zip(
                        rows, (doc_id, piece, low, high - low, crc), strict=True
                    ):
                        column.append(value)
                    low, high, piece = high, high + capacity, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each item in the order given."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    made = 0
    for i, size in enumerate(lengths.tolist()):
        # change of the sum when a sequence with gap g takes the item, for all g at once;
        # a sequence filled to the brim leaves the sum, and a new one only enters it
        gaps, left = count[size:], count[: capacity + 1 - size]
        change = np.where(gaps > 0, 2 * (left - gaps) + 2, never)
        if gaps[0]:
            change[0] = 1 - 2 * gaps[0]
        change[-1] = 2 * left[-1] + 1 if size < capacity else 0
        gap = size + int(change.argmin())
        if gap == capacity:
            number, made = made, made + 1
        else:
            number = open_at[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = number, capacity - gap
        if gap > size:
            open_at[gap - size].append(number)
            count[gap - size] += 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``pieces`` with the sequence and the place in it that each piece gets.

    ``length`` must be from 1 to ``capacity``. sequence_id is unique over all shards
    and rounds; offsets are gapless from 0. Other columns are carried along, those named
    sequence_id and offset are replaced, and an empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset")
    row, shard, again = unused(pieces, "_row", "_shard", "_again")
    # the row number is fixed by being written, so a retried task deals alike
    rest = durable(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    placed = {c: F.lit(0).cast("long") for c in ("sequence_id", "offset")}
    schema = rest.withColumns(placed).withColumn(again, F.lit(False)).schema
    names = rest.columns

    def packed(items: DataFrame, shards: int, turn: int) -> DataFrame:
        def pack_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            order = np.lexsort((table[row].to_numpy(), -table["length"].to_numpy()))
            table = table.select(names).take(pa.array(order))
            lengths = table["length"].to_numpy()
            sequence, offset = sum_of_squares(lengths, capacity)
            loose = _unfilled(sequence, lengths, capacity)
            retry = sum_of_squares(lengths[loose], capacity)
            if len(set(retry[0].tolist())) <= len(set(sequence[loose].tolist())):
                sequence[loose] = retry[0] + len(lengths)
                offset[loose] = retry[1]
            base = (turn << 60) + (key[0].as_py() << 20)
            return (
                table.append_column("sequence_id", pa.array(base + sequence))
                .append_column("offset", pa.array(offset))
                .append_column(again, pa.array(_unfilled(sequence, lengths, capacity)))
            )

        number = F.pmod(F.xxhash64(row, F.lit(turn)), F.lit(shards))
        return durable(
            items.withColumn(shard, number).groupBy(shard).applyInArrow(pack_shard, schema),
            "packed",
        )

    columns = [*pieces.columns, "sequence_id", "offset"]
    shards = -(-rest.count() // shard_items)
    if shards <= 1:
        return packed(rest, 1, 0).select(*columns)
    first = packed(rest, shards, 0)
    loose = first.filter(F.col(again)).select(*names)
    shards = max(MERGE_SHARDS, -(-loose.count() // shard_items))
    second = packed(loose, shards, 1)
    return first.filter(~F.col(again)).select(*columns).unionByName(second.select(*columns))


def _unfilled(sequence: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Which items are in a sequence with more than UNFILLED of it free."""
    if not len(sequence):
        return np.zeros(0, bool)
    return (np.bincount(sequence, weights=lengths) < capacity * (1 - UNFILLED))[sequence]


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, added_tokens: bool = False
) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) placed into sequences of ``capacity``."""
    return pack(cut_pieces(docs, tokenizer, capacity, added_tokens=added_tokens), capacity)
