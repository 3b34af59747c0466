"""Mixing the sources of a corpus to target weights.

The words of each source, its documents one after the other, are packed into blocks of a
fixed number of words. The mix is a list of slots, dealt over output shards. For each
source the numbers of its slots in the shards are one multinomial draw over all shards:
its total, and with it its share of the mix, is met exactly, the shards differ as random
draws do, and no source needs to know of another. The slots of a source are numbered
through the shards, and slot q takes block p(q mod n) of the source's n blocks, where p
is a pseudorandom permutation for each pass over the blocks. So a block is taken again
only when all others have been. Slots and blocks are joined by source and block number.

A permutation is computed where it is needed, from its seed alone: a Feistel network over
the smallest even number of bits that holds n, walked until the number is below n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.dataflow import global_rank
from tagweave.llm.shingles import mix64, slices
from tagweave.llm.store import durable, fresh_path

BLOCK_WORDS = 1024
SHARD_SLOTS = 4096  # expected slots of an output shard
WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MOST_TIMES = 3  # a source gives at most so many times its words
ROUNDS = 4  # of the Feistel network
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def permuted(index: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The images of ``index`` under a pseudorandom permutation of 0 to n - 1."""
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    start = np.full(1, seed & 0xFFFFFFFFFFFFFFFF, np.uint64)
    keys = [mix64(start + np.uint64(r * 0x632BE59BD9B4E019 & (2**64 - 1))) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        if inverse:
            for key in reversed(keys):
                left, right = right ^ (mix64(left ^ key) & mask), left
        else:
            for key in keys:
                left, right = right, left ^ (mix64(right ^ key) & mask)
        return left << shift | right

    out = once(np.asarray(index, np.uint64))
    while True:
        outside = np.flatnonzero(out >= n)
        if not len(outside):
            return out.astype(np.int64)
        out[outside] = once(out[outside])


def _word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of [^\\x20\\x09-\\x0D] in texts laid end to end."""
    word = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    return starts, np.flatnonzero(word & (~after | cut[1:])) + 1


def _sizes(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for low, data, bounds in slices(texts):
        starts, _ = _word_spans(data, bounds)
        out[low : low + len(bounds) - 1] = np.diff(np.searchsorted(starts, bounds))
    return out


def place(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """The documents of ``docs`` (doc_id, source, text), one row each: row (a number of
    its own), doc_id, source, size (words; a null text has none), sid (the number of its
    source, by code point, null last, from 1) and start (words of its source before it,
    by doc_id). ``keep_text`` keeps the texts."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()),
         ("tie", pa.int64())] + [("text", pa.string())] * keep_text
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0), batch.column(1), pa.array(_sizes(batch.column(3))),
                       batch.column(2)] + [batch.column(3)] * keep_text
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(
        measure, "doc_id long, source string, size long, tie long" + ", text string" * keep_text
    )
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "sized")
    # equal sources lie in neighbouring ranges; a large one takes several of them
    ranged = durable(
        rows.select("row", "doc_id", "source", "size", "tie")
        .sort(F.col("source").asc_nulls_last(), "doc_id", "size", "tie", "row")
        .withColumn("at", F.monotonically_increasing_id()),
        "by-source",
    ).withColumn("range", F.shiftright("at", 33))
    parts = durable(
        ranged.groupBy("range", "source").agg(F.sum("size").alias("words")), "source-parts"
    )
    names = global_rank(
        parts.select("source").distinct(), [F.col("source").asc_nulls_last()], "sid"
    )
    same = F.col("p.source").eqNullSafe(F.col("s.source"))
    numbered = parts.alias("p").join(names.alias("s"), same).select("p.range", "p.words", "s.*")
    earlier = W.partitionBy("sid").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    numbered = durable(
        numbered.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))), "offsets"
    )
    on = (F.col("r.range") == F.col("p.range")) & F.col("r.source").eqNullSafe(F.col("p.source"))
    inside = W.partitionBy("range", "source").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    light = (
        ranged.withColumn("in_range", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .alias("r").join(numbered.alias("p"), on)
        .select("r.row", "r.doc_id", "r.source", "r.size", "p.sid",
                (F.col("p.base") + F.col("r.in_range")).alias("start"))
    )
    if keep_text:
        light = light.join(rows.select("row", "text"), "row")
    return durable(light, "placed")


def targets(
    placed: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES
) -> DataFrame:
    """sid, source, source_size and target of every source of ``place``.

    All words together are shared by weight; a target stops at ``most`` times its
    source's size, and what is over is shared by weight among the others, again and again
    until no target is above. The rounds only carry sums to the driver."""
    weight = F.get(
        F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights)).cast("int")
    )
    sources = durable(
        placed.groupBy("sid", "source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight).withColumn("cap", F.col("source_size") * most),
        "sources",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        # a source is full when its weight at this level is above its cap
        full = F.col("weight") * F.lit(level) > F.col("cap")
        state = sources.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("given"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not state.open:
            break
        raised = (total - state.given) / state.open
        if raised <= level:
            break
        level = raised
    full = F.col("weight") * F.lit(level) > F.col("cap")
    return durable(
        sources.select(
            "sid", "source", "source_size",
            F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(level))
            .cast("double").alias("target"),
        ),
        "targets",
    )


def _draw(sources: DataFrame, shards: int, block: int, seed: int) -> DataFrame:
    """(sid, shard, first, n, blocks, source_size, words): the slots first to
    first + n - 1 of a source go to a shard; ``words`` is what the source gives in all."""
    schema = pa.schema(
        [(c, pa.int64()) for c in
         ("sid", "shard", "first", "n", "blocks", "source_size", "words")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, words = row["source_size"], round(row["target"])
                if not size or not words:
                    continue
                blocks = -(-size // block)
                passes, rest = divmod(words, size)
                slots = passes * blocks + _slots(rest, size, block, row["sid"], passes, seed)
                rng = np.random.default_rng([seed, row["sid"]])
                counts = rng.multinomial(slots, np.full(shards, 1 / shards))
                used = np.flatnonzero(counts)
                n = counts[used]
                fixed = [np.full(len(used), x) for x in (row["sid"], blocks, size, words)]
                yield pa.RecordBatch.from_arrays(
                    list(map(pa.array, (fixed[0], used, np.cumsum(n) - n, n, *fixed[1:]))),
                    schema=schema,
                )

    return sources.select("sid", "source_size", "target").mapInArrow(
        run, ", ".join(f"{n} long" for n in schema.names)
    )


def _pass_seed(sid: int, number: int, seed: int) -> int:
    return seed * 1_000_003 + sid * 8_191 + number


def _slots(rest: int, size: int, block: int, sid: int, number: int, seed: int) -> int:
    """How many blocks of pass ``number`` hold its first ``rest`` words."""
    if not rest:
        return 0
    blocks, short = -(-size // block), size % block
    n = -(-rest // block)
    if short:
        # the last block of the source is short
        at = permuted(np.array([blocks - 1]), blocks, _pass_seed(sid, number, seed), True)
        if at[0] < n:
            n = -(-(rest + block - short) // block)
            # without the short one, whole blocks may do already
            n = min(n, blocks)
    return n


def slots(sources: DataFrame, block: int = BLOCK_WORDS, seed: int = 1) -> DataFrame:
    """The slots of the mix: shard, slot (of its source), sid, block (number in its
    source), times (pass over the source) and words (how many of the block's words are
    taken; all but in the last slot of a source)."""
    total = sources.agg(F.sum("target")).first()[0] or 0
    shards = max(1, -(-int(total) // (block * SHARD_SLOTS)))
    drawn = durable(_draw(sources, shards, block, seed), "draws")
    schema = pa.schema(
        [(c, pa.int64()) for c in ("shard", "slot", "sid", "block", "times", "words")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                slot = r["first"] + np.arange(r["n"])
                times, at = np.divmod(slot, r["blocks"])
                number = np.zeros(len(slot), np.int64)
                before = np.zeros(len(slot), np.int64)
                short = -r["source_size"] % block
                for t in np.unique(times).tolist():
                    own = times == t
                    key = _pass_seed(r["sid"], t, seed)
                    number[own] = permuted(at[own], r["blocks"], key)
                    # words of the source's slots before each, less what the short block lacks
                    last = permuted(np.array([r["blocks"] - 1]), r["blocks"], key, True)[0]
                    before[own] = (
                        t * r["source_size"] + at[own] * block - short * (at[own] > last)
                    )
                length = block - short * (number == r["blocks"] - 1)
                words = np.minimum(length, r["words"] - before)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), r["shard"])), pa.array(slot),
                     pa.array(np.full(len(slot), r["sid"])), pa.array(number), pa.array(times),
                     pa.array(words)],
                    schema=schema,
                )

    # a large source has a row for each shard, so its slots are made by many tasks
    return drawn.repartition("sid", "shard").mapInArrow(
        run, ", ".join(f"{n} long" for n in schema.names)
    )


def blocks(placed: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """What the blocks of the sources hold: sid, block, at (words of the block before),
    row, word (words of the document before) and length; one row for each document that
    reaches into a block."""
    first = F.expr(f"start div {block}")
    last = F.expr(f"(start + size - 1) div {block}")
    low = F.greatest("start", F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return (
        placed.filter("size > 0")
        .select("sid", "row", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        .select("sid", "block", (low - F.col("block") * block).alias("at"), "row",
                (low - F.col("start")).alias("word"), (high - low).alias("length"))
    )


def mix(
    placed: DataFrame, sources: DataFrame, block: int = BLOCK_WORDS, seed: int = 1
) -> DataFrame:
    """The mix of the documents of ``place`` by the ``targets`` of their sources.

    One row for each stretch of a document in a slot: shard, slot, sid, block, times, at
    (words of the slot before), row, word (words of the document before) and length. Each
    source gives its target, rounded to a word; its documents, none more than once a pass.
    The same documents and seed give the same mix, however they are stored. Sources
    without words give nothing.
    """
    # Spark takes the slots for as few as the draws, but they grow with the corpus
    taken = slots(sources, block, seed).hint("merge")
    return (
        taken.join(blocks(placed, block), ["sid", "block"])
        .withColumn("length", F.least("length", F.col("words") - F.col("at")))
        .filter("length > 0")
        .select("shard", "slot", "sid", "block", "times", "at", "row", "word", "length")
    )


def mixed_texts(placed: DataFrame, mixed: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The texts of the stretches of ``mixed``: its columns and ``text``, from the first
    to the last of their words. ``placed`` must hold the texts.

    Each document is cut once, where the blocks cut it, so a long one is not repeated."""
    schema = pa.schema([("row", pa.int64()), ("word", pa.int64()), ("whole", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, offsets = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, start, text in zip(rows, offsets, batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                data = np.frombuffer(raw, np.uint8)
                begins, ends = _word_spans(data, np.array([0, len(data)]))
                low = 0
                words, pieces = [], []
                while low < len(begins):
                    high = min(len(begins), low + block - (start + low) % block)
                    words.append(low)
                    pieces.append(raw[begins[low] : ends[high - 1]].decode())
                    low = high
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(words), pa.int64()), pa.array(words, pa.int64()),
                     pa.array(pieces, pa.string())],
                    schema=schema,
                )

    pieces = placed.select("row", "start", "text").mapInArrow(
        cut, "row long, word long, whole string"
    )
    return (
        mixed.join(pieces, ["row", "word"])
        .withColumn("text", F.pandas_udf(_first_words, "string")("whole", "length"))
        .drop("whole")
    )


def _first_words(texts: pd.Series, lengths: pd.Series) -> pd.Series:
    """The first words of each text; the last slot of a source ends inside a block."""
    out = []
    for text, n in zip(texts, lengths, strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        _, ends = _word_spans(data, np.array([0, len(data)]))
        out.append(text if n >= len(ends) else data[: ends[n - 1]].tobytes().decode())
    return pd.Series(out, dtype=object)


def write_mix(docs: DataFrame, path: str | None = None, seed: int = 1) -> str:
    """Mix ``docs`` and write the output, a folder for each shard with the stretches of
    its slots and their texts; returns the path."""
    placed = place(docs, keep_text=True)
    out = mixed_texts(placed, mix(placed, targets(placed), seed=seed))
    path = path or fresh_path(docs.sparkSession, "mix")
    out.repartition("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def taken(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of the
    document, repeats counted) of every row of ``docs`` (doc_id, source, text).

    Rows with null or repeated doc_ids are rows of their own; a null source is a source.
    """
    placed = place(docs)
    sources = targets(placed)
    counted = mix(placed, sources, seed=seed).groupBy("row").agg(F.sum("length").alias("taken"))
    return (
        placed.join(counted.hint("merge"), "row", "left")
        .join(sources.select("sid", "source_size", "target"), "sid")
        .select("doc_id", "size", "source_size", "target",
                F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )
