"""Graph algorithms on graphs with known answers, and their invariants."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tagweave.operators.betweenness import betweenness, sampled_betweenness
from tagweave.operators.graph import modularity
from tagweave.operators.louvain import louvain

PATH = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
STAR = [("hub", x) for x in "abcde"]
CYCLE = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("a", "f")]
CLIQUES = [*itertools.combinations("abcd", 2), *itertools.combinations("wxyz", 2), ("d", "w")]


def _graph(spark, links, weight=0.5):
    rows = [(min(p), max(p), weight, 1 - weight) for p in links]
    return spark.createDataFrame(rows, "u string, v string, weight double, distance double")


def _nodes(spark, links, extra=("alone",)):
    names = sorted({n for p in links for n in p} | set(extra))
    return spark.createDataFrame(list(enumerate(names)), "id long, name string")


def _between(links, names):
    """All-pairs shortest path counts by brute force over hop distances."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    paths = {}
    for s in names:
        level, count, dist = [s], {s: 1}, {s: 0}
        while level:
            ahead = []
            for v in level:
                for w in near[v]:
                    if w not in dist:
                        dist[w], count[w] = dist[v] + 1, 0
                        ahead.append(w)
                    if dist[w] == dist[v] + 1:
                        count[w] += count[v]
            level = ahead
        paths[s] = (dist, count)
    n = len(names)
    out = {}
    for v in names:
        total = 0.0
        for s, t in itertools.permutations(names, 2):
            if v in (s, t):
                continue
            ds, cs = paths[s]
            dv, cv = paths[v]
            if t in ds and v in ds and t in dv and ds[v] + dv[t] == ds[t]:
                total += cs[v] * cv[t] / cs[t]
        out[v] = total / ((n - 1) * (n - 2))
    return out


@pytest.mark.parametrize(
    ("links", "batch"),
    [(PATH, 10_000), (STAR, 10_000), (CYCLE, 10_000), (CLIQUES, 10_000), (PATH, 3)],
)
def test_betweenness(spark, links, batch):
    nodes = _nodes(spark, links)
    names = [r.name for r in nodes.collect()]
    got = {r.name: r.score for r in betweenness(_graph(spark, links), nodes, batch).collect()}
    assert got == pytest.approx(_between(links, names))


def test_betweenness_follows_distances(spark):
    rows = [("a", "b", 0.9, 0.1), ("b", "c", 0.9, 0.1), ("a", "c", 0.1, 0.9)]
    graph = spark.createDataFrame(rows, "u string, v string, weight double, distance double")
    nodes = _nodes(spark, [("a", "b"), ("b", "c")], ())
    for batch in (100, 2):
        got = {r.name: r.score for r in betweenness(graph, nodes, batch).collect()}
        assert got == pytest.approx({"a": 0.0, "b": 1.0, "c": 0.0})


def test_sampled_betweenness_keeps_its_bound(spark):
    """Hubs with many leaves: few sources suffice, and no score is further off than its bound."""
    hubs = [f"h{i}" for i in range(4)]
    links = [*itertools.combinations(hubs, 2), *((hubs[i % 4], f"x{i}") for i in range(400))]
    graph, nodes = _graph(spark, links), _nodes(spark, links)
    exact = {r.name: r.score for r in betweenness(graph, nodes).collect()}
    for seed in range(2):
        rows = sampled_betweenness(graph, nodes, 0.45, seed=seed, first_sources=100).collect()
        assert {r.name for r in rows} == set(exact)
        assert 0 < rows[0].sources < 404 and all(0 < r.bound <= 0.45 for r in rows)
        assert all(abs(r.score - exact[r.name]) <= r.bound for r in rows)
    # an error that no sample reaches takes every source
    rows = sampled_betweenness(graph, nodes, 1e-9, first_sources=300).collect()
    assert {r.name: r.score for r in rows} == pytest.approx(exact)
    assert {r.bound for r in rows} == {0.0}


def test_sampled_betweenness_without_links(spark):
    graph = spark.createDataFrame([], "u string, v string, weight double, distance double")
    rows = sampled_betweenness(graph, _nodes(spark, [], ("x", "y", "z"))).collect()
    assert sorted((r.name, r.score, r.bound) for r in rows) == [(c, 0.0, 0.0) for c in "xyz"]


def test_louvain_finds_cliques(spark):
    graph, nodes = _graph(spark, CLIQUES), _nodes(spark, CLIQUES)
    groups = defaultdict(set)
    for r in louvain(graph, nodes).collect():
        groups[r.label].add(r.name)
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c", "d"], ["alone"], list("wxyz")]


def test_louvain_keeps_to_components_and_gains(spark):
    links = PATH + [("p", "q"), ("q", "r"), ("p", "r")]
    graph, nodes = _graph(spark, links), _nodes(spark, links)
    found = louvain(graph, nodes, block_rows=1)
    assert found.count() == nodes.count()
    across = (
        found.filter(F.col("name").isin("p", "q", "r"))
        .select("label")
        .intersect(found.filter(~F.col("name").isin("p", "q", "r")).select("label"))
    )
    assert across.count() == 0
    single = nodes.select("name", F.col("id").alias("label"))
    assert modularity(graph, found).first()[0] > modularity(graph, single).first()[0]


def test_louvain_without_links(spark):
    graph = spark.createDataFrame([], "u string, v string, weight double, distance double")
    nodes = _nodes(spark, [], ("x", "y"))
    assert louvain(graph, nodes).select("label").distinct().count() == 2


def _random_graph(seed, n=120, links=350):
    pick = random.Random(seed)
    pairs = {tuple(sorted(pick.sample(range(n), 2))) for _ in range(links)}
    return [(f"n{a:03d}", f"n{b:03d}", pick.randint(1, 10) / 10) for a, b in sorted(pairs)]


class _Plain:
    """Weighted modularity of labels, and a sequential search that moves node by node."""

    def __init__(self, rows):
        self.near = defaultdict(dict)
        for u, v, w in rows:
            self.near[u][v] = self.near[v][u] = w
        self.k = {u: sum(x.values()) for u, x in self.near.items()}
        self.total = sum(self.k.values())

    def modularity(self, label):
        inner = sum(w for u in self.near for v, w in self.near[u].items() if label[u] == label[v])
        tot = defaultdict(float)
        for u, k in self.k.items():
            tot[label[u]] += k
        return inner / self.total - sum((t / self.total) ** 2 for t in tot.values())

    def gain(self, label, tot, u, to):
        link = sum(w for v, w in self.near[u].items() if label[v] == to)
        rest = tot[to] - (self.k[u] if label[u] == to else 0)
        return link - self.k[u] * rest / self.total

    def best(self, label, tot, u):
        """(gain over staying, community)"""
        stay = self.gain(label, tot, u, label[u])
        options = {label[v] for v in self.near[u]} - {label[u]}
        return max([(self.gain(label, tot, u, c) - stay, c) for c in options] + [(-stay, None)],
                   key=lambda x: x[0])

    def totals(self, label):
        tot = defaultdict(float)
        for u, k in self.k.items():
            tot[label[u]] += k
        return tot

    def sequential(self):
        group = {u: {u} for u in self.near}  # nodes that move together
        label = {u: u for u in self.near}
        while True:
            again = False
            moving = True
            while moving:
                moving = False
                for members in group.values():
                    own = label[next(iter(members))]
                    tot = self.totals(label)
                    k = sum(self.k[u] for u in members)
                    link = defaultdict(float)
                    for u in members:
                        for v, w in self.near[u].items():
                            if v not in members:
                                link[label[v]] += w
                    value = {
                        c: w - k * (tot[c] - (k if c == own else 0)) / self.total
                        for c, w in {own: 0.0, **link}.items()
                    }
                    to = max(value, key=value.get)
                    if value[to] > value[own] + 1e-9:
                        for u in members:
                            label[u] = to
                        moving = again = True
            if not again:
                return label
            merged = defaultdict(set)
            for u, c in label.items():
                merged[c].add(u)
            group = dict(merged)


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain_ends_where_no_move_gains(spark, seed):
    rows = _random_graph(seed)
    graph = spark.createDataFrame(rows, "u string, v string, weight double")
    names = sorted({x for r in rows for x in r[:2]})
    nodes = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    label = {r.name: r.label for r in louvain(graph, nodes, block_rows=4).collect()}
    plain = _Plain(rows)
    tot = plain.totals(label)
    assert max(plain.best(label, tot, u)[0] for u in names) < 1e-6
    ids = dict(enumerate(names))
    assert all(label[ids[c]] == c for c in set(label.values()))
    assert plain.modularity(label) >= plain.modularity(plain.sequential()) - 0.02
    found = spark.createDataFrame(list(label.items()), "name string, label long")
    assert modularity(graph, found).first()[0] == pytest.approx(plain.modularity(label))


def test_louvain_moves_need_one_end_of_links(spark):
    from tagweave.operators.louvain import _labelled, _spread

    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, w double")
    salted, nodes = _spread(edges, 10)
    labels = nodes.selectExpr("*", "node as comm")
    one = _labelled(salted, labels, ("dst",))
    assert "src_comm" not in one.columns
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_dangling_edges_go_by_the_names_no_company_has(spark):
    from tagweave.operators.edges import without_dangling

    rows = [(1, "a", "b"), (2, "a", "ghost"), (3, "ghost", "b"), (4, None, "b"), (5, "a", None), (1, "a", "b"), (6, "b", "b")]
    edges = spark.createDataFrame(rows, "id long, company_a string, company_b string")
    companies = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string")
    got = without_dangling(edges, companies)
    assert got.columns == edges.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a", "b"), (1, "a", "b"), (6, "b", "b")]
    # a join that keeps known names would need every edge shuffled to all the names
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert without_dangling(edges, companies.limit(0)).isEmpty()
