"""Exact top-k search by inner product over paged metric trees.

The vectors are dealt at random into shards, and each shard becomes an M-tree: pages of
entries, where an entry is a vector (in a leaf) or a child page with a routing vector
and a covering radius, and every entry stores its distance to the routing vector of its
page. A query goes through the pages of a shard by falling bound: no vector of a page
with routing vector c and radius r has a larger inner product with q than <q,c> + |q| r.
Since <q,p> is known for the routing vector p of a page, an entry at distance d from p
with radius r is passed over without a computation when <q,p> + |q| (d + r) is too
small. The bounds are exact, so the results are, whatever the vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.llm.store import durable

SHARD_VECTORS = 8192
PAGE_ENTRIES = 64
QUERY_BLOCK = 1024  # queries that one task takes through one shard
SLACK = 1e-9  # relative rounding error that the bounds allow for

_PAGES = (
    "shard long, page int, leaf boolean, router binary, ids binary, entries binary, "
    "radii binary, to_router binary, children binary"
)


def _split(vectors: np.ndarray, rows: np.ndarray, parts: int) -> list[np.ndarray]:
    """Rows in at most ``parts`` groups of near vectors, of bounded and similar size."""
    own = vectors[rows]
    # routing vectors far from each other, from a fixed start
    chosen = [int(((own - own.mean(0)) ** 2).sum(1).argmax())]
    near = ((own - own[chosen[0]]) ** 2).sum(1)
    while len(chosen) < parts and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((own - own[chosen[-1]]) ** 2).sum(1))
    centres = own[chosen]
    square = (own**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * own @ centres.T
    nearest = square.argmin(1)
    room = -(-2 * len(rows) // parts)
    groups = []
    for i in range(len(chosen)):
        group = rows[nearest == i]
        groups.extend(group[low : low + room] for low in range(0, len(group), room))
    return groups


def build(ids: np.ndarray, vectors: np.ndarray) -> list[dict]:
    """The pages of one tree; page 0 is the root."""
    vectors = vectors.astype(np.float64)
    pages: list[dict] = []

    def make(rows: np.ndarray) -> tuple[int, int, float]:
        """(page, row of its routing vector, covering radius)"""
        at = len(pages)
        pages.append({})
        own = vectors[rows]
        router = int(rows[((own - own.mean(0)) ** 2).sum(1).argmin()])
        radius = float(np.sqrt(((own - vectors[router]) ** 2).sum(1).max()))
        if len(rows) <= PAGE_ENTRIES:
            entries, radii, children = rows, np.zeros(len(rows)), np.full(len(rows), -1)
        else:
            parts = min(PAGE_ENTRIES, -(-2 * len(rows) // PAGE_ENTRIES))
            made = [make(group) for group in _split(vectors, rows, parts)]
            children, entries, radii = map(np.array, zip(*made, strict=True))
        pages[at] = {
            "page": at,
            "leaf": len(rows) <= PAGE_ENTRIES,
            "router": vectors[router],
            "ids": ids[entries],
            "entries": vectors[entries],
            "radii": radii,
            "to_router": np.sqrt(((vectors[entries] - vectors[router]) ** 2).sum(1)),
            "children": children,
        }
        return at, router, radius

    if len(ids):
        make(np.arange(len(ids)))
    return pages


def search(pages: list[dict], own: int | None, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id), highest score first and then smallest id, without id
    ``own``. Scores are inner products of integer vectors, computed exactly in doubles
    below 2**53."""
    if not pages:
        return []
    norm = float(np.sqrt(query @ query))
    best: list[tuple[float, int]] = []  # heap of (score, -id), the worst first
    todo = [(-np.inf, 0, float(query @ pages[0]["router"]))]
    while todo:
        bound, number, to_router = heapq.heappop(todo)
        floor = best[0][0] if len(best) == k else -np.inf
        if -bound < floor:
            break
        page = pages[number]
        reach = to_router + norm * (page["to_router"] + page["radii"])
        near = np.flatnonzero(reach + SLACK * (1 + np.abs(reach)) >= floor)
        if not len(near):
            continue
        score = page["entries"][near] @ query
        if page["leaf"]:
            good = score >= floor
            for s, i in zip(score[good].tolist(), page["ids"][near[good]].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            continue
        limit = score + norm * page["radii"][near]
        limit += SLACK * (1 + np.abs(limit))
        for s, u, e in zip(score.tolist(), limit.tolist(), near.tolist(), strict=True):
            if u >= floor:
                heapq.heappush(todo, (-u, int(page["children"][e]), s))
    return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def index(vectors: DataFrame, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """The pages of the trees over ``vectors`` (vec_id long, v array<long>), one in a
    row. Rows whose vec_id or v is null take no part; all v have one length. Repeated
    rows are all indexed."""
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    usable = durable(
        usable.select("vec_id", "v", F.monotonically_increasing_id().alias("_row")), "vectors"
    )
    shards = max(1, -(-usable.count() // shard_vectors))

    def plant(key, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("_row")
        pages = build(shard["vec_id"].to_numpy("int64"), np.stack(shard["v"].to_list()))
        rows = [
            {k: x.tobytes() if isinstance(x, np.ndarray) else x for k, x in _typed(p).items()}
            for p in pages
        ]
        return pd.DataFrame(rows).assign(shard=int(key[0]))[[f.split(" ")[0] for f in _FIELDS]]

    return durable(
        usable.withColumn("shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(plant, _PAGES),
        "metric-tree",
    )


_FIELDS = _PAGES.split(", ")
_KINDS = {"ids": "<i8", "children": "<i4"}


def _typed(page: dict) -> dict:
    return {
        k: x.astype(_KINDS.get(k, "<f8")) if isinstance(x, np.ndarray) else x
        for k, x in page.items()
    }


def _read(row: dict) -> dict:
    page = {
        k: np.frombuffer(x, _KINDS.get(k, "<f8")) if isinstance(x, bytes) else x
        for k, x in row.items()
    }
    page["entries"] = page["entries"].reshape(len(page["ids"]), -1)
    return page


def top_k(pages: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` indexed vectors with the largest inner product to each row of
    ``queries`` (vec_id long, v array<long>), itself left out; all, if fewer.

    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller vec_id.
    A query with a null vec_id or v, or without candidates, has no rows; a repeated query
    row is answered once. Queries meet every shard in blocks: a task takes one block
    through one shard.
    """
    asked = queries.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select(
        F.col("vec_id").alias("query_id"), "v"
    ).distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shards = (pages.agg(F.max("shard")).first()[0] or 0) + 1

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # a shard's pages and a block's queries once for each task that needs them
    index_side = pages.select("*", each(blocks).alias("block"))
    query_side = asked.select(
        "query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"),
        each(shards).alias("shard"),
    )

    def run(key, trees: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        tree = [_read(r) for r in trees.sort_values("page").to_dict("records")]
        rows = [
            (q, i, s)
            for q, v in zip(block["query_id"].tolist(), block["v"], strict=True)
            for s, i in search(tree, q, np.asarray(v, np.float64), k)
        ]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = (
        index_side.groupBy("shard", "block")
        .cogroup(query_side.groupBy("shard", "block"))
        .applyInPandas(run, "query_id long, vec_id long, score long")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a long; null if the vector is null, empty,
    or holds a null, an infinity or a NaN."""
    sound = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.when(
        (F.size(embedding) > 0) & F.coalesce(sound, F.lit(False)),
        F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))),
    )
