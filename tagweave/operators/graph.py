"""The competitor graph: building it, degrees, communities as facts, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.constants import MIN_COMMUNITY_SIZE, MIN_DISTANCE, MIN_SPLIT_MEMBERS
from tagweave.dataflow import durable, global_rank, seeded
from tagweave.functions.tags import tags
from tagweave.operators.edges import unordered, without_dangling


def build_graph(edges: DataFrame, companies: DataFrame) -> DataFrame:
    """Simple undirected weighted edges (u < v, weight, distance) between known
    companies. The last stored row of a pair wins; a missing score weighs 0."""
    known = unordered(without_dangling(edges.filter("active"), companies))
    return (
        known.filter(F.col("u") != F.col("v"))
        .groupBy("u", "v")
        .agg(F.max_by(F.coalesce("score", F.lit(0.0)), "id").alias("weight"))
        .withColumn(
            "distance", F.greatest(F.lit(MIN_DISTANCE), F.lit(1.0) - F.col("weight"))
        )
    )


def both_ways(graph: DataFrame) -> DataFrame:
    cols = [c for c in graph.columns if c not in ("u", "v")]
    return graph.select(F.col("u").alias("src"), F.col("v").alias("dst"), *cols).unionAll(
        graph.select(F.col("v").alias("src"), F.col("u").alias("dst"), *cols)
    )


def degrees(graph: DataFrame) -> DataFrame:
    return (
        both_ways(graph)
        .groupBy(F.col("src").alias("name"))
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def node_degrees(graph: DataFrame, companies: DataFrame) -> DataFrame:
    """Degree of every company, 0 for isolates."""
    return (
        companies.select("name")
        .join(degrees(graph), "name", "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    )


def graph_summary(
    graph: DataFrame, companies: DataFrame, communities: DataFrame | None = None
) -> DataFrame:
    """Nodes, edges, isolates and, if given, communities of reportable size."""
    nodes = node_degrees(graph, companies).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("degree") == 0).alias("isolates"),
        F.floor(F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("edges"),
    )
    if communities is None:
        return nodes.select("nodes", "edges", "isolates")
    n = communities.agg(F.countDistinct("community_id").alias("communities"))
    # both sides are single rows
    return nodes.crossJoin(F.broadcast(n)).select("nodes", "edges", "isolates", "communities")


def ranked_communities(
    membership: DataFrame, min_size: int = MIN_COMMUNITY_SIZE
) -> DataFrame:
    """Number communities of at least ``min_size`` from 0, largest first, ties by the
    smallest member. ``membership`` is (name, label); gives (label, community_id, size)."""
    sizes = (
        membership.groupBy("label")
        .agg(F.count(F.lit(1)).alias("size"), F.min("name").alias("first_member"))
        .filter(F.col("size") >= min_size)
    )
    ranked = global_rank(sizes, [F.col("size").desc(), F.col("first_member")], "_rank")
    return ranked.select("label", (F.col("_rank") - 1).alias("community_id"), "size")


def community_members(membership: DataFrame, min_size: int = MIN_COMMUNITY_SIZE) -> DataFrame:
    """Members of the numbered communities: (name, community_id)."""
    ranked = ranked_communities(membership, min_size)
    return membership.join(ranked, ["label"]).select("name", "community_id")


def _member_tags(communities: DataFrame, companies: DataFrame) -> DataFrame:
    return communities.join(
        companies.select("name", F.explode(tags("subsectors")).alias("subsector")), "name"
    )


def dominant_subsectors(communities: DataFrame, companies: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent subsectors of each community: (community_id, subsector, n, rank)."""
    counts = (
        _member_tags(communities, companies)
        .groupBy("community_id", "subsector")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = W.partitionBy("community_id").orderBy(F.col("n").desc(), F.col("subsector"))
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def subsector_splits(
    communities: DataFrame, companies: DataFrame, min_members: int = MIN_SPLIT_MEMBERS
) -> DataFrame:
    """Subsectors with a real foothold in two or more communities, one row per slice:
    (subsector, total_members, n_slices, community_id, members)."""
    held = companies.select("name", F.explode(F.array_distinct(tags("subsectors"))).alias("subsector"))
    totals = held.groupBy("subsector").agg(F.count(F.lit(1)).alias("total_members"))
    slices = (
        held.join(communities, "name")
        .groupBy("subsector", "community_id")
        .agg(F.count(F.lit(1)).alias("members"))
        .filter(F.col("members") >= min_members)
    )
    spread = (
        slices.groupBy("subsector")
        .agg(F.count(F.lit(1)).alias("n_slices"))
        .filter("n_slices >= 2")
        .join(totals, "subsector")
    )
    return slices.join(spread, "subsector").select(
        "subsector", "total_members", "n_slices", "community_id", "members"
    )


def split_samples(
    splits: DataFrame,
    communities: DataFrame,
    companies: DataFrame,
    size: int = 8,
    seed: int = 0,
) -> DataFrame:
    """Up to ``size`` members, in seeded random order, of each (subsector, community)
    slice, with their descriptions."""
    held = companies.select(
        "id", "name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.explode(F.array_distinct(tags("subsectors"))).alias("subsector"),
    )
    members = held.join(communities, "name")
    sliced = members.join(splits.select("subsector", "community_id"), ["subsector", "community_id"], "left_semi")
    # the rank filter keeps ``size`` rows per slice before the shuffle
    order = W.partitionBy("subsector", "community_id").orderBy(seeded(seed, "id"), "id")
    return (
        sliced.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= size)
        .select("subsector", "community_id", "rank", "name", "description")
    )


def top_nodes(
    scores: DataFrame, graph: DataFrame, companies: DataFrame, k: int = 20
) -> DataFrame:
    """The k nodes of highest score (name, score), with degree and subsectors."""
    top = scores.orderBy(F.col("score").desc(), "name").limit(k)
    # at most k rows
    facts = companies.select("name", tags("subsectors").alias("subsectors"))
    return (
        facts.join(F.broadcast(top), "name")
        .join(degrees(graph), "name", "left")
        .select("name", "score", F.coalesce("degree", F.lit(0)).alias("degree"), "subsectors")
    )


def top_communities(communities: DataFrame, k: int = 15, sample: int = 6) -> DataFrame:
    """The first k communities with their size and first few members by name."""
    wanted = communities.filter(F.col("community_id") < k)
    sizes = wanted.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    order = W.partitionBy("community_id").orderBy("name")
    names = (
        wanted.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= sample)
        .groupBy("community_id")
        .agg(F.array_sort(F.collect_list("name")).alias("sample"))
    )
    return sizes.join(names, "community_id")


def modularity(graph: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One-row frame with the weighted modularity of (name, label) on the graph."""
    a = membership.select(F.col("name").alias("src"), F.col("label").alias("_la"))
    b = membership.select(F.col("name").alias("dst"), F.col("label").alias("_lb"))
    labelled = both_ways(graph).join(a, "src").join(b, "dst")
    per = labelled.groupBy("_la").agg(
        F.sum("weight").alias("total"),
        F.sum(F.when(F.col("_la") == F.col("_lb"), F.col("weight")).otherwise(0.0)).alias("inner"),
    )
    return per.agg(
        F.sum("inner").alias("i"),
        F.sum("total").alias("t"),
        F.sum(F.col("total") * F.col("total")).alias("s"),
    ).select(
        (F.col("i") / F.col("t") - F.lit(resolution) * F.col("s") / (F.col("t") * F.col("t"))).alias(
            "modularity"
        )
    )


def components(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, component) of every node (id, name): the smallest id that links reach.

    Each round a node takes the smallest label near it and then the label of that label,
    so long chains shorten by half; the rounds end when no label falls."""
    named = nodes.select("name", F.col("id").cast("long").alias("id"))
    both = both_ways(graph.select("u", "v"))
    for end in ("src", "dst"):
        both = both.join(
            named.select(F.col("name").alias(end), F.col("id").alias(f"{end}_id")), end
        )
    both = durable(both.select("src_id", "dst_id").distinct(), "component-links")
    labels = durable(named.select("id", F.col("id").alias("component")), "components")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("dst_id"), "component"), "dst_id")
            .groupBy(F.col("src_id").alias("id")).agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "id", "left").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        stepped = durable(
            lower.join(far, "component")
            .select("id", "old", F.least("component", "far").alias("component")),
            "components",
        )
        labels = stepped.select("id", "component")
        if stepped.filter("component < old").isEmpty():
            return named.join(labels, "id").select("name", "component")


def gaining_moves(links: DataFrame, resolution: float = 1.0, least: float = 1e-9) -> DataFrame:
    """(src, to, rise): moves of one node to a neighbouring community that raise the
    modularity. ``links`` has both directions (src, dst, weight) with the communities of
    their ends, ``own`` and ``to``."""
    degree = links.groupBy("src", "own").agg(F.sum("weight").alias("k"))
    totals = degree.groupBy(F.col("own").alias("to")).agg(F.sum("k").alias("tot"))
    total = links.agg(F.sum("weight").alias("total"))
    pull = F.lit(resolution) * F.col("k") / F.col("total")
    rated = (
        links.groupBy("src", "to").agg(F.sum("weight").alias("w"))
        .join(degree, "src").join(totals, "to")
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("gain", F.col("w") - pull * (F.col("tot") - F.when(F.col("to") == F.col("own"), F.col("k")).otherwise(0.0)))
    )
    # a node without links into its own community stays at the cost of its size
    own = degree.join(totals.withColumnRenamed("to", "own"), "own").crossJoin(F.broadcast(total))
    stay = (
        own.select("src", (-pull * (F.col("tot") - F.col("k"))).alias("apart"))
        .join(rated.filter("to = own").select("src", "gain"), "src", "left")
        .select("src", F.coalesce("gain", "apart").alias("stay"))
    )
    return (
        rated.filter("to <> own").join(stay, "src")
        .select("src", "to", (F.col("gain") - F.col("stay")).alias("rise"), "total")
        .filter(F.col("rise") > F.lit(least) * F.col("total")).drop("total")
    )
