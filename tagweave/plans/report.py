"""The graph report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.graph import (
    dominant_subsectors,
    graph_summary,
    subsector_splits,
    top_communities,
    top_nodes,
)


def community_documents(communities: DataFrame, companies: DataFrame, k: int = 10) -> DataFrame:
    """One record per community: id, size and its k dominant subsectors."""
    sizes = communities.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    # at most k per community
    top = dominant_subsectors(communities, companies, k).groupBy("community_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "subsector", "n"))).alias("_top")
    )
    return sizes.join(top, "community_id", "left").select(
        F.col("community_id").alias("id"),
        "size",
        F.transform(
            "_top", lambda t: F.struct(t["subsector"].alias("subsector"), t["n"].alias("n"))
        ).alias("dominant_subsectors"),
    )


def graph_report(
    graph: DataFrame, companies: DataFrame, communities: DataFrame, scores: DataFrame
) -> DataFrame:
    """The report as rows (section, key, value JSON), of any length."""
    def rows(df: DataFrame, section: str, key: str) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"),
            F.col(key).cast("string").alias("key"),
            F.to_json(F.struct("*")).alias("value"),
        )

    parts = [
        rows(graph_summary(graph, companies, communities), "summary", "nodes"),
        rows(top_nodes(scores, graph, companies), "betweenness_top", "name"),
        rows(scores, "betweenness_all", "name"),
        rows(top_communities(communities), "communities_top", "community_id"),
        rows(communities, "members", "name"),
        rows(community_documents(communities, companies), "communities", "id"),
        rows(subsector_splits(communities, companies), "subsector_splits", "subsector"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
