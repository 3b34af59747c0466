"""Hard negatives of labelled vectors by the threshold algorithm on sorted lists.

The vectors are dealt at random into shards of bounded size. A shard keeps, for each
dimension, its rows sorted by that component. An anchor walks all lists of a shard at
once, from the largest component down where its own is positive and from the smallest
up where it is negative, so each list offers the rows that add most to the inner
product first. A row met for the first time is fetched and scored whole, in integers.
No row that is still unmet can score more than the sum over the lists of the anchor's
component times the component last met: the threshold. A window of scores is finished
when the threshold falls strictly below its k-th score so far (strictly, since equal
scores are ordered by id) or below the window itself. The bound is exact, so the result
is, whatever the vectors.

Shards are never copied: each goes to one task, through which all anchors stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.llm.store import durable

SHARD_BYTES = 16_000_000  # of the vectors and lists of a shard, four bytes a number each
LEAST_VECTORS = 1_024  # a shard is not made smaller to have more tasks
FIRST_STEP = 32  # places of each list that are read first; later steps double
LARGEST = 1 << 28  # components are kept within this, so that scores fit a long

_SHARD = "shard long, ids binary, labels binary, vectors binary, order binary"
_FOUND = pa.schema(
    [("key", pa.int64()), ("high", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
)


@dataclass
class Lists:
    """The rows of a shard and, for each dimension, their numbers by rising component."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # rows x dimensions
    order: np.ndarray  # dimensions x rows

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Lists:
        return cls(ids, labels, vectors, np.argsort(vectors, axis=0, kind="stable").T)

    def typed(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and query in a type in which their products are exact."""
        peak = int(np.abs(self.vectors).max(initial=0)) * int(np.abs(query).max(initial=0))
        exact = object if peak * max(1, len(query)) >= 1 << 53 else np.float64
        if self.vectors.dtype != exact:
            self.vectors = self.vectors.astype(np.int64).astype(exact)
        return self.vectors, query.astype(exact)


def threshold_search(
    lists: Lists,
    query: np.ndarray,
    allowed: np.ndarray,
    windows: Sequence[tuple[float, float]],
    k: int,
) -> list[list[tuple[int, int]]]:
    """For each window (low, high) of scores its k best (score, id) among the allowed
    rows, highest score first and then smallest id; all, if fewer."""
    vectors, query = lists.typed(query)
    n = len(lists.ids)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    rows, scores = np.zeros(0, np.int64), np.zeros(0, query.dtype)
    unmet = allowed.copy()
    unfinished = set(range(len(windows)))
    depth, step = 0, FIRST_STEP
    while unfinished and depth < n:
        stop = min(n, depth + step)
        if len(up) or len(down):
            met = np.zeros(n, bool)
            met[lists.order[up, n - stop : n - depth]] = True
            met[lists.order[down, depth:stop]] = True
        else:
            # every score is zero, and no list tells rows apart
            met, stop = np.ones(n, bool), n
        new = np.flatnonzero(met & unmet)
        unmet[new] = False
        rows = np.concatenate((rows, new))
        scores = np.concatenate((scores, vectors[new] @ query))
        depth, step = stop, 2 * step
        if depth == n:
            break
        limit = (query[up] * vectors[lists.order[up, n - depth], up]).sum() + (
            query[down] * vectors[lists.order[down, depth - 1], down]
        ).sum()
        for i in list(unfinished):
            low, high = windows[i]
            within = scores[(scores >= max(low, limit)) & (scores <= high)]
            if limit < low or (len(within) >= k and np.sort(within)[-k] > limit):
                unfinished.discard(i)
    out = []
    for low, high in windows:
        fit = np.flatnonzero((scores >= low) & (scores <= high))
        if len(fit) > k:
            kth = np.sort(scores[fit])[-k]
            fit = fit[scores[fit] >= kth]
        best = sorted((-int(scores[i]), int(lists.ids[rows[i]])) for i in fit)[:k]
        out.append([(-s, i) for s, i in best])
    return out


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dimensions), np.int32)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(column)), lengths), at] = values
    return out


def index(vectors: DataFrame, dimensions: int, rows: int) -> tuple[DataFrame, int]:
    """(sorted lists of ``vectors`` (row, vec_id, label, v), one shard in a row; how many
    shards there are)"""
    most = max(1, SHARD_BYTES // (8 * max(1, dimensions)))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-rows // most), min(-(-rows // LEAST_VECTORS), tasks))
    schema = pa.schema(
        [("shard", pa.int64())] + [(c, pa.binary()) for c in ("ids", "labels", "vectors", "order")]
    )

    def plant(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table.column("v").chunk(0)
        lists = Lists.of(
            table.column("vec_id").to_numpy(), table.column("label").to_numpy(),
            _matrix(column, dimensions),
        )
        return pa.Table.from_pydict(
            {
                "shard": [key[0].as_py()],
                "ids": [lists.ids.astype("<i8").tobytes()],
                "labels": [lists.labels.astype("<i8").tobytes()],
                "vectors": [lists.vectors.astype("<i4").tobytes()],
                "order": [np.ascontiguousarray(lists.order, "<i4").tobytes()],
            },
            schema,
        )

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return durable(dealt.groupBy("shard").applyInArrow(plant, _SHARD), "sorted-lists"), shards


def _searched(
    lists: DataFrame, shards: int, asked: DataFrame, dimensions: int, same: bool,
    k: int, percent: tuple[int, int] | None,
) -> DataFrame:
    """(key, high, vec_id, score): the best rows of every shard for each of ``asked``
    (key, vec_id, label, v, scores), of the same label or of others, in the windows that
    ``percent`` makes of the scores or anywhere; ``high`` is the score of the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            found: list[tuple[int, int | None, int, int]] = []
            for i in range(batch.num_rows):
                if at["kind"][i].as_py() == 0:
                    raw = {
                        c: np.frombuffer(at[c][i].as_buffer(), d)
                        for c, d in (("ids", "<i8"), ("labels", "<i8"), ("vectors", "<i4"),
                                     ("order", "<i4"))
                    }
                    n = len(raw["ids"])
                    shard = Lists(
                        raw["ids"], raw["labels"], raw["vectors"].reshape(n, dimensions),
                        raw["order"].reshape(dimensions, n),
                    )
                    continue
                if shard is None:
                    continue  # a shard without rows
                key, own = at["key"][i].as_py(), at["vec_id"][i].as_py()
                query = np.zeros(dimensions, np.int64)
                values = at["v"][i].as_py()
                query[: len(values)] = values
                alike = shard.labels == at["label"][i].as_py()
                allowed = (alike if same else ~alike) & (shard.ids != own)
                highs = at["scores"][i].as_py()
                windows = [(-np.inf, np.inf)]
                if percent:
                    windows = [_window(s, *percent) for s in highs]
                best = threshold_search(shard, query, allowed, windows, k)
                for high, each in zip(highs if percent else [0], best, strict=True):
                    found.extend((key, high, i, s) for s, i in each)
            columns = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_pydict(dict(zip(_FOUND.names, columns, strict=True)), _FOUND)

    def null(kind: str) -> Column:
        return F.lit(None).cast(kind)

    blobs = ("ids", "labels", "vectors", "order")
    index_side = lists.select(
        "shard", F.lit(0).alias("kind"), null("long").alias("key"), null("long").alias("vec_id"),
        null("long").alias("label"), null("array<int>").alias("v"),
        null("array<long>").alias("scores"), *blobs,
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    query_side = asked.select(
        every.alias("shard"), F.lit(1).alias("kind"), "key", "vec_id", "label", "v", "scores",
        *[null("binary").alias(c) for c in blobs],
    )
    return (
        index_side.unionByName(query_side)
        .repartitionByRange(shards, "shard")
        .sortWithinPartitions("shard", "kind")
        .mapInArrow(run, "key long, high long, vec_id long, score long")
    )


def _best(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: tuple[int, int] = (80, 100),
) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id long, label, v array of whole
    numbers) for which ``is_anchor`` holds.

    A row's score is its inner product with the anchor; higher scores come first, ties by
    smaller vec_id. An anchor's positives are its first ``positives`` other rows of the
    same label. For each positive of score p the first ``negatives`` rows of other labels
    with percent[0] * p <= 100 * score <= percent[1] * p are returned: anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score. Fewer rows
    are all returned; an anchor without positives, or a positive without such rows, has
    none.

    Rows with a null vec_id, label or v take no part. Shorter vectors are filled up with
    zeros, so an empty one scores zero. Components are kept within 2**28. Repeated rows
    all count as candidates; a repeated anchor row is answered once, and rows that share
    an anchor's vec_id are not compared with it.
    """
    usable = vectors.filter("vec_id is not null and label is not null and v is not null")
    clipped = F.transform(
        "v", lambda x: F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    )
    usable = durable(
        usable.select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"),
            F.col("label").cast("long"), clipped.alias("v"),
            F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        ),
        "labelled-vectors",
    )
    shape = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    dimensions = shape.d or 0
    lists, shards = index(usable, dimensions, shape.n)
    # equal anchor rows are one
    anchors = durable(
        usable.filter("asks").groupBy("vec_id", "label", "v").agg(F.min("row").alias("key")),
        "anchors",
    )
    no_scores = F.array().cast("array<long>").alias("scores")
    near = _searched(
        lists, shards, anchors.select("*", no_scores), dimensions, True, positives, None
    )
    chosen = durable(
        _best(near.select("key", "vec_id", "score"), ["key"], positives).select(
            "key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )
    # at most as many scores as an anchor has positives
    windows = chosen.groupBy("key").agg(F.collect_set("positive_score").alias("scores"))
    far = _searched(
        lists, shards, anchors.join(windows, "key"), dimensions, False, negatives, percent
    )
    hard = _best(far, ["key", "high"], negatives)
    return (
        chosen.join(hard.withColumnRenamed("high", "positive_score"), ["key", "positive_score"])
        .join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
        .select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )


def whole(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector is null or
    holds a null, an infinity or a NaN. An empty vector stays empty."""
    sound = F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    most = F.lit(float(LARGEST))
    return F.when(
        F.coalesce(sound, F.lit(False)),
        F.transform(
            embedding,
            lambda x: F.floor(
                F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), most), -most)
            ),
        ),
    )
