"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave import fixtures as fx
from tagweave.catalog.registry import query
from tagweave.dataflow import durable, fresh_path
from tagweave.operators import edges as E
from tagweave.operators import graph as G
from tagweave.operators.betweenness import betweenness, sampled_betweenness
from tagweave.operators.louvain import louvain
from tagweave.plans.report import community_documents, graph_report


def _graph(spark, d):
    return G.build_graph(fx.messy_edge(spark, d), fx.company(spark, d))


@fx.derived
def _communities(spark, d):
    """Numbered groups of companies, from a grouping that SQL can repeat."""
    return G.community_members(fx.tag_group(spark, d))


@fx.derived
def _louvain(spark, d):
    graph = durable(_graph(spark, d), "graph")
    return louvain(graph, fx.company(spark, d).select("id", "name"))


@query("g01_graph", "select u, v, weight, distance from f_graph")
def g01(spark, d):
    return _graph(spark, d)


_BOTH = "(select u as name from f_graph union all select v from f_graph)"
_DEGREE = f"""select c.name, coalesce(n, 0) as degree from f_company c
    left join (select name, count(*) as n from {_BOTH} group by name) using (name)"""


@query("a09_degree", _DEGREE)
def a09(spark, d):
    return G.node_degrees(_graph(spark, d), fx.company(spark, d))


_LISTED = """(select company_a as source, company_b as target, coalesce(score, 0) as score from f_messy
    where active and company_a in (select name from f_company) and company_b in (select name from f_company))"""


@query(
    "a10_link_radius",
    f"""with deg as (select name, count(*) as degree from (
        select source as name from {_LISTED} union all select target from {_LISTED}) group by name)
        select name, degree, 5.0::double + 15.0::double * degree / (select max(degree) from deg) as radius from deg""",
)
def a10(spark, d):
    return E.link_radii(E.graph_links(fx.messy_edge(spark, d), fx.company(spark, d)))


@query(
    "a22_graph_summary",
    f"""select (select count(*) from f_company) as nodes, (select count(*) from f_graph) as edges,
        (select count(*) from ({_DEGREE}) where degree = 0) as isolates,
        (select count(*) from f_ranked) as communities""",
)
def a22(spark, d):
    return G.graph_summary(_graph(spark, d), fx.company(spark, d), _communities(spark, d))


@query("w07_community_rank", "select label, community_id, size from f_ranked")
def w07(spark, d):
    return G.ranked_communities(fx.tag_group(spark, d))


_DOMINANT = """select community_id, tag as subsector, n, rank from (
    select community_id, tag, count(*) as n,
        row_number() over (partition by community_id order by count(*) desc, tag) as rank
    from f_members join f_sub using (name) group by community_id, tag) where rank <= 10"""


@query("a11_dominant_subsectors", _DOMINANT)
def a11(spark, d):
    return G.dominant_subsectors(_communities(spark, d), fx.company(spark, d))


_SLICES = """slices as (select tag as subsector, community_id, count(distinct name) as members
        from f_members join f_sub using (name) group by tag, community_id having count(distinct name) >= 3),
    spread as (select subsector, count(*) as n_slices from slices group by subsector having count(*) >= 2),
    splits as (select s.subsector, t.total_members, n_slices, community_id, members from slices s
        join spread using (subsector)
        join (select tag as subsector, count(distinct name) as total_members from f_sub group by tag) t using (subsector))"""


@query("a12_subsector_splits", f"with {_SLICES} select * from splits")
def a12(spark, d):
    return G.subsector_splits(_communities(spark, d), fx.company(spark, d))


_SAMPLES = f"""with {_SLICES},
    ranked as (select s.subsector, s.community_id, c.name, coalesce(c.description, '') as description,
        row_number() over (partition by s.subsector, s.community_id order by md5('5|' || c.id), c.id) as rank
        from splits s join f_members m using (community_id) join f_company c on c.name = m.name
        where list_contains(c.subsectors, s.subsector))"""


@query(
    "j13_split_samples",
    f"{_SAMPLES} select subsector, community_id, rank, name, description from ranked where rank <= 8",
)
def j13(spark, d):
    companies, groups = fx.company(spark, d), _communities(spark, d)
    return G.split_samples(G.subsector_splits(groups, companies), groups, companies, seed=5)


@query(
    "r03_split_lookup",
    f"""with {_SLICES}, dom as ({_DOMINANT}) select s.subsector, s.community_id, s.members, r.size,
        (select array_to_string(list(subsector order by rank), '|') from dom
         where dom.community_id = s.community_id and rank <= 5) as dominant
        from splits s join f_ranked r using (community_id)""",
)
def r03(spark, d):
    from tagweave.sources.readers import COMMUNITY_REPORT, read_report
    from tagweave.sources.writers import write_report

    companies, groups = fx.company(spark, d), _communities(spark, d)
    path = fresh_path(spark, "communities")
    write_report(community_documents(groups, companies), path)
    facts = read_report(spark, path, COMMUNITY_REPORT).select(
        F.col("id").alias("community_id"),
        "size",
        F.transform(F.slice("dominant_subsectors", 1, 5), lambda x: x["subsector"]).alias("dominant"),
    )
    splits = G.subsector_splits(groups, companies)
    return splits.join(facts, "community_id").select(
        "subsector", "community_id", "members", "size", "dominant"
    )


@query(
    "s08_report_search",
    """select community_id as id, tag as subsector, n from (
       select community_id, tag, count(*) as n,
           row_number() over (partition by community_id order by count(*) desc, tag) as rank
       from f_members join f_sub using (name) group by community_id, tag)
       where rank <= 10 and tag = 'Brand#13'""",
)
def s08(spark, d):
    from tagweave.sources.readers import COMMUNITY_REPORT, read_report
    from tagweave.sources.writers import write_report

    path = fresh_path(spark, "communities")
    write_report(community_documents(_communities(spark, d), fx.company(spark, d)), path)
    entries = read_report(spark, path, COMMUNITY_REPORT).select(
        "id", F.explode("dominant_subsectors").alias("x")
    )
    return entries.select("id", "x.subsector", "x.n").filter("subsector = 'Brand#13'")


@query(
    "t02_top_communities",
    """select community_id, count(*) as size,
       array_to_string(list(name order by name)[1:6], '|') as sample
       from f_members where community_id < 15 group by community_id""",
)
def t02(spark, d):
    return G.top_communities(_communities(spark, d))


@query(
    "t01_top_degree_nodes",
    f"""select name, degree::double as score, degree, array_to_string(subsectors, '|') as subsectors
        from ({_DEGREE}) join f_company using (name) order by degree desc, name limit 20""",
)
def t01(spark, d):
    graph = _graph(spark, d)
    scores = G.node_degrees(graph, fx.company(spark, d)).select(
        "name", F.col("degree").cast("double").alias("score")
    )
    return G.top_nodes(scores, graph, fx.company(spark, d))


@query(
    "u04_neighbour_sets",
    """select company, count(distinct other) + 1 as n from f_links where company <> other group by company""",
)
def u04(spark, d):
    links = E.neighbours(fx.messy_edge(spark, d))
    centres = links.select("company", F.col("company").alias("other"))
    return links.union(centres).distinct().groupBy("company").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g04_nodes",
    """select name, array_to_string(sectors, '|') as sectors, '' as flaticon_url, '' as logo_url,
       coalesce(description, '') as description, coalesce(website, '') as website, '' as linkedin_url from f_company""",
)
def g04_nodes(spark, d):
    return E.graph_nodes(fx.company(spark, d))


@query("g04_links", f"select source, target, score from {_LISTED}")
def g04_links(spark, d):
    return E.graph_links(fx.messy_edge(spark, d), fx.company(spark, d))


@query(
    "g06_link_style",
    f"""select source, target, 1.0::double + 4.0::double * score as width, 1.5::double + 5.0::double * score as ego_width,
        0.15::double + 0.45::double * score as opacity, 10.0::double + 12.0::double * score as ego_radius from {_LISTED}""",
)
def g06(spark, d):
    styled = E.link_style(E.graph_links(fx.messy_edge(spark, d), fx.company(spark, d)))
    return styled.drop("score")


@query(
    "g07_node_colour",
    """select name, case sectors[1] when 'PROMO' then '#4e79a7' when 'SMALL' then '#e15759' else '#777' end as colour
       from f_blanked""",
)
def g07(spark, d):
    colours = {"PROMO": "#4e79a7", "SMALL": "#e15759"}
    return E.node_colour(fx.blanked_company(spark, d), colours)


# ---- no SQL form --------------------------------------------------------------


@fx.derived
def _betweenness(spark, d):
    return betweenness(durable(_graph(spark, d), "graph"), fx.company(spark, d))


@query("g02_betweenness")
def g02(spark, d):
    return _betweenness(spark, d).select("name", F.round("score", 9).alias("score"))


@query("g02_betweenness_sampled")
def g02_sampled(spark, d):
    """Scores that are all within their bounds of the exact ones, at 95 % confidence."""
    return sampled_betweenness(durable(_graph(spark, d), "graph"), fx.company(spark, d), 0.1)


@query("t01_top_betweenness")
def t01_between(spark, d):
    top = G.top_nodes(_betweenness(spark, d), _graph(spark, d), fx.company(spark, d))
    return top.withColumn("score", F.round("score", 9))


@query("g03_louvain")
def g03(spark, d):
    return _louvain(spark, d)


@query("g03_modularity")
def g03_modularity(spark, d):
    found = G.modularity(_graph(spark, d), _louvain(spark, d))
    return found.select(F.round("modularity", 6).alias("modularity"))


@query(
    "g03_louvain_checks",
    """select 'nodes' as fact, count(*) as n from f_company
       union all select 'names', count(distinct name) from f_company
       union all select 'labels that are not the smallest member', 0
       union all select 'links between communities of different components', 0
       union all select 'communities in several components', 0
       union all select 'single moves that gain', 0""",
)
def g03_checks(spark, d):
    """What must hold of the communities of any graph, counted over the whole of it."""
    graph, found = durable(_graph(spark, d), "graph"), _louvain(spark, d)
    ids = fx.company(spark, d).select("id", "name")
    labelled = found.join(ids, "name")
    parts = G.components(graph, ids)
    label = found.select(F.col("name").alias("src"), F.col("label").alias("own"))
    links = G.both_ways(graph.select("u", "v", "weight")).join(label, "src").join(
        label.select(F.col("src").alias("dst"), F.col("own").alias("to")), "dst"
    )
    facts = [
        ("nodes", found),
        ("names", found.select("name").distinct()),
        ("labels that are not the smallest member",
         labelled.groupBy("label").agg(F.min("id").alias("low")).filter("label <> low")),
        ("links between communities of different components",
         links.join(parts.select(F.col("name").alias("src"), F.col("component").alias("a")), "src")
         .join(parts.select(F.col("name").alias("dst"), F.col("component").alias("b")), "dst")
         .filter("a <> b")),
        ("communities in several components",
         found.join(parts, "name").groupBy("label")
         .agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b")),
        ("single moves that gain", G.gaining_moves(links)),
    ]
    out = None
    for fact, rows in facts:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(fact).alias("fact"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("g05_graph_report")
def g05(spark, d):
    companies, graph = fx.company(spark, d), _graph(spark, d)
    members = G.community_members(_louvain(spark, d))
    rows = graph_report(graph, companies, members, _betweenness(spark, d))
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
