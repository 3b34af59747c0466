"""Weighted Louvain communities as DataFrame rounds without conflicting moves.

In each round every node names its best move. A community then either gives or receives,
by the best move that names it, so only moves from givers to receivers go on: nobody
leaves where others arrive. What is left between moves of one community is the weight
that the others bring or take away, and a move goes ahead only if it gains even when all
others do, or if it is the best of both its communities. Taken from the best to the
worst, every move of a round then raises modularity by itself; the best move of all is
always among them. Rounds end when no node has a gaining move, communities become the
nodes of the next level, and after the last level the nodes themselves have their turn
again, until no single move of a node or of a community gains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.dataflow import BLOCK_ROWS, durable
from tagweave.operators.graph import both_ways

_MIN_RISE = 1e-10  # share of the total weight that a move must gain, against rounding


def _spread(edges: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Edges with a salt per end, and nodes with their salt count, so that the links
    of a hub are spread over tasks in every round. Computed once per level."""
    links = edges.groupBy("src").agg(
        F.count(F.lit(1)).alias("links"), F.sum("w").alias("k")
    )
    nodes = durable(
        links.select(
            F.col("src").alias("node"),
            "k",
            F.ceil(F.col("links") / F.lit(block_rows)).cast("int").alias("salts"),
        ),
        "louvain-nodes",
    )
    heavy = nodes.filter("salts > 1")  # at most edges/block_rows rows
    salted = edges
    for end, other in (("src", "dst"), ("dst", "src")):
        counts = heavy.select(F.col("node").alias(end), F.col("salts").alias("_n"))
        salted = (
            salted.join(counts, end, "left")
            .withColumn(
                f"{end}_salt", F.pmod(F.xxhash64(other), F.coalesce("_n", F.lit(1))).cast("int")
            )
            .drop("_n")
        )
    return durable(salted, "louvain-edges"), nodes


def _labelled(
    edges: DataFrame, labels: DataFrame, ends: tuple[str, ...] = ("src", "dst")
) -> DataFrame:
    """Edges with the community of their ends. ``labels`` is (node, salts, k, comm)."""
    spread = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    out = edges
    for end in ends:
        out = out.join(
            spread.select(
                F.col("node").alias(end), F.col("salt").alias(f"{end}_salt"),
                F.col("comm").alias(f"{end}_comm"),
            ),
            [end, f"{end}_salt"],
        )
    return out


def _wanted(
    labelled: DataFrame, labels: DataFrame, total: float, resolution: float
) -> DataFrame:
    """(node, k, own, to, rise): the best move of each node that has a gaining one, to a
    neighbouring community or alone. Of ``labelled`` the communities of dst are needed."""
    totals = labels.groupBy("comm").agg(F.sum("k").alias("tot"))
    near = (
        labelled.filter(F.col("src") != F.col("dst"))
        .groupBy(F.col("src").alias("node"), F.col("dst_comm").alias("to"))
        .agg(F.sum("w").alias("w"))
    )
    own = labels.select("node", "k", F.col("comm").alias("own"))
    pull = F.lit(resolution) * F.col("k") / F.lit(total)
    rated = (
        near.join(own, "node")
        .join(totals.withColumnRenamed("comm", "to"), "to")
        .withColumn("stays", F.col("to") == F.col("own"))
        .withColumn(
            "gain", F.col("w") - pull * (F.col("tot") - F.when(F.col("stays"), F.col("k")).otherwise(0.0))
        )
    )
    best = rated.groupBy("node").agg(
        F.max(F.when(~F.col("stays"), F.struct("gain", (-F.col("to")).alias("neg")))).alias("best"),
        F.max(F.when(F.col("stays"), F.col("gain"))).alias("stay"),
    )
    rest = own.join(totals.withColumnRenamed("comm", "own"), "own").join(best, "node", "left")
    # a node without a neighbour of its own community, and one that would be alone
    stay = F.coalesce("stay", -pull * (F.col("tot") - F.col("k")))
    alone = F.struct(F.lit(0.0).alias("gain"), (-_alone(F.col("node"))).alias("neg"))
    move = F.greatest("best", F.when(F.col("tot") > F.col("k"), alone))
    return (
        rest.withColumn("move", move)
        .select("node", "k", "own", (-F.col("move.neg")).alias("to"),
                (F.col("move.gain") - stay).alias("rise"))
        .filter(F.col("rise") > _MIN_RISE * total)
    )


def _named(node: Column) -> Column:
    """The community that begins as this node."""
    return 2 * node


def _alone(node: Column) -> Column:
    """The community of a node that leaves all others."""
    return 2 * node + 1


def _without_conflicts(wanted: DataFrame, total: float, resolution: float) -> DataFrame:
    """(node, to): the moves of ``wanted`` that together gain what each promises, less
    what the others of their communities can take from it, which leaves a gain."""
    claim = F.struct("rise", "node")
    none = F.lit(None).cast("struct<rise:double,node:bigint>")
    roles = (
        wanted.select(F.col("to").alias("comm"), claim.alias("enter"), none.alias("leave"))
        .unionByName(wanted.select(F.col("own").alias("comm"), none.alias("enter"), claim.alias("leave")))
        .groupBy("comm").agg(F.max("enter").alias("enter"), F.max("leave").alias("leave"))
        .select("comm", (F.col("leave").isNull() | F.coalesce(F.col("enter") > F.col("leave"), F.lit(False)))
                .alias("receives"))
    )
    open_moves = (
        wanted.join(roles.select(F.col("comm").alias("to"), "receives"), "to")
        .filter("receives").drop("receives")
        .join(roles.select(F.col("comm").alias("own"), "receives"), "own")
        .filter("not receives")
    )
    shared = (
        open_moves.select(F.col("to").alias("comm"), "k", claim.alias("claim"))
        .unionByName(open_moves.select(F.col("own").alias("comm"), "k", claim.alias("claim")))
        .groupBy("comm").agg(F.sum("k").alias("moving"), F.max("claim").alias("first"))
    )
    for end in ("to", "own"):
        open_moves = open_moves.join(
            shared.select(
                F.col("comm").alias(end), F.col("moving").alias(f"{end}_moving"),
                F.col("first.node").alias(f"{end}_first"),
            ),
            end,
        )
    others = F.col("to_moving") + F.col("own_moving") - 2 * F.col("k")
    left = F.col("rise") - F.lit(resolution) * F.col("k") * others / F.lit(total)
    leads = (F.col("to_first") == F.col("node")) & (F.col("own_first") == F.col("node"))
    return open_moves.filter(leads | (left > _MIN_RISE * total)).select("node", "to")


def _local_moves(
    salted: DataFrame, labels: DataFrame, total: float, resolution: float
) -> tuple[DataFrame, bool]:
    """(labels after which no node has a gaining move, whether any moved)"""
    moved = False
    while True:
        wanted = durable(
            _wanted(_labelled(salted, labels, ("dst",)), labels, total, resolution), "louvain-wanted"
        )
        if wanted.isEmpty():
            return labels, moved
        moves = _without_conflicts(wanted, total, resolution)
        labels = durable(
            labels.join(moves, "node", "left")
            .select("node", "k", "salts", F.coalesce("to", "comm").alias("comm")),
            "louvain-labels",
        )
        moved = True


def louvain(
    graph: DataFrame,
    nodes: DataFrame,
    resolution: float = 1.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Community label of every node: (name, label). ``graph`` is (u, v, weight),
    ``nodes`` (id, name); nodes without links stay alone. Labels are node ids, the
    smallest of each community. No single node, and no community as a whole, can be moved
    to another community with a gain."""
    ids_u = nodes.select(F.col("id").cast("long").alias("src_id"), F.col("name").alias("src"))
    ids_v = nodes.select(F.col("id").cast("long").alias("dst_id"), F.col("name").alias("dst"))
    edges = durable(
        both_ways(graph.select("u", "v", "weight"))
        .filter("weight > 0")
        .join(ids_u, "src")
        .join(ids_v, "dst")
        .select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("weight").alias("w")),
        "louvain-graph",
    )
    total = edges.agg(F.sum("w")).first()[0]
    found = edges.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    if total:
        salted, base = _spread(edges, block_rows)
        found = _climbed(salted, base, total, resolution, block_rows)
    return nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "name", F.coalesce("label", "id").alias("label")
    )


def _climbed(
    salted: DataFrame, base: DataFrame, total: float, resolution: float, block_rows: int
) -> DataFrame:
    """(node, label) of the nodes of a level, by moves of nodes and of communities."""
    start = base.withColumn("comm", _named(F.col("node")))
    while True:
        labels, _ = _local_moves(salted, start, total, resolution)
        found = _renamed(labels)
        level, climbed = _contracted(salted, labels), False
        while True:
            upper, above = _spread(level, block_rows)
            moved, any_moved = _local_moves(
                upper, above.withColumn("comm", _named(F.col("node"))), total, resolution
            )
            if not any_moved:
                break
            climbed = True
            names = _renamed(moved).select(F.col("node").alias("label"), F.col("label").alias("up"))
            found = durable(
                found.join(names, "label").select("node", F.col("up").alias("label")),
                "louvain-found",
            )
            level = _contracted(upper, moved)
        if not climbed:
            return found
        start = durable(
            base.join(found.select("node", _named(F.col("label")).alias("comm")), "node"),
            "louvain-start",
        )


def _renamed(labels: DataFrame) -> DataFrame:
    """(node, label): each community under its smallest node."""
    names = labels.groupBy("comm").agg(F.min("node").alias("label"))
    return durable(labels.join(names, "comm").select("node", "label"), "louvain-names")


def _contracted(salted: DataFrame, labels: DataFrame) -> DataFrame:
    """The links between communities, each under its smallest node."""
    names = labels.groupBy("comm").agg(F.min("node").alias("label"))
    named = labels.join(names, "comm").select("node", "k", "salts", F.col("label").alias("comm"))
    return durable(
        _labelled(salted, named)
        .groupBy(F.col("src_comm").alias("src"), F.col("dst_comm").alias("dst"))
        .agg(F.sum("w").alias("w")),
        "louvain-level",
    )
