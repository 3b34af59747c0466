"""Skew-proof joins and ranks give the plain result when keys are split."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.dataflow import pair_join, rank_within
from tagweave.functions.tags import jaccard, lenient_match, overlap
from tagweave.operators.overlap import (
    candidate_counts,
    overlap_candidates,
    sweep_candidates,
    two_hop_candidates,
    without_linked,
)
from tagweave.operators.similarity import similar_pairs


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 17}" if i % 11 else None) for i in range(600)]
    return spark.createDataFrame(rows, "id long, key string")


def test_pair_join_splits_hot_keys(skewed):
    left = skewed.dropna().withColumnRenamed("id", "a")
    right = skewed.dropna().withColumnRenamed("id", "b")
    plain = left.join(right, "key")
    split = pair_join(left, right, ["key"], ["a"], ["b"], block_rows=20)
    assert split.exceptAll(plain).count() == plain.exceptAll(split).count() == 0
    assert split.count() == plain.count()


def test_rank_within_matches_a_window(skewed):
    plain = skewed.withColumn(
        "pos", F.row_number().over(W.partitionBy("key").orderBy(F.col("id").desc())).cast("long")
    )
    # rows without a key are a group of their own
    ranked = rank_within(skewed, ["key"], [F.col("id").desc()])
    assert ranked.exceptAll(plain).count() == 0
    assert ranked.count() == skewed.count()


@pytest.fixture(scope="module")
def companies(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        if i % 3 == 0:  # a third are exact copies
            tags = (["A"], ["hot"], [])
        else:
            tags = (
                rng.sample(["A", "B", "C", "Uncategorized"], rng.randint(1, 2)),
                rng.sample(["hot", "x", "y", "z", "Uncategorized"], rng.randint(0, 4)),
                rng.sample(["s0", "s1", "s2"], rng.randint(0, 2)),
            )
        rows.append((i, f"c{i:04d}", *tags))
    return spark.createDataFrame(
        rows,
        "id long, name string, sectors array<string>, subsectors array<string>, "
        "sub_subsectors array<string>",
    ).cache()


def _brute(companies):
    a = companies.select(*[F.col(c).alias(f"{c}_a") for c in companies.columns])
    b = companies.select(*[F.col(c).alias(f"{c}_b") for c in companies.columns])
    return a.crossJoin(b).filter(
        (F.col("name_a") < F.col("name_b"))
        & overlap("sectors_a", "sectors_b")
        & overlap("subsectors_a", "subsectors_b")
    )


@pytest.mark.parametrize("block_rows", [10, 100_000])
def test_overlap_candidates_match_brute_force(companies, block_rows):
    brute = _brute(companies).filter(lenient_match("sub_subsectors_a", "sub_subsectors_b"))
    got = overlap_candidates(companies, ordered=True, block_rows=block_rows)
    assert got.count() == brute.count()
    assert got.select("id_a", "id_b").exceptAll(brute.select("id_a", "id_b")).count() == 0


def test_equal_tags_meet_once_and_hot_keys_are_split_by_companies(companies, monkeypatch):
    """80 companies with equal tags are one row of the join, which weighs as many."""
    from tagweave import dataflow
    from tagweave.operators import overlap as O

    seen = []

    def spied(left, right, keys, left_id, right_id, block_rows, weights):
        seen.append(left)
        hot = dataflow._hot_keys([left, right], keys, block_rows, weights)
        seen.append(hot and hot.count())
        return pair_join(left, right, keys, left_id, right_id, block_rows, weights=weights)

    monkeypatch.setattr(O, "pair_join", spied)
    got = overlap_candidates(companies, ordered=True, block_rows=70)
    brute = _brute(companies).filter(lenient_match("sub_subsectors_a", "sub_subsectors_b"))
    assert got.count() == brute.count()
    assert seen[0].filter("n_a >= 80").count() == 1 and seen[1] > 0


@pytest.mark.parametrize("twice", [False, True])
def test_listed_candidates_are_numbered_like_pairs(companies, monkeypatch, twice):
    """Lists in several ranges, parts and copies; rows of one name share their numbering."""
    from tagweave.operators import overlap as O
    from tagweave.operators.scoring import chunked

    monkeypatch.setattr(O, "LIST_RANGE", 50)
    monkeypatch.setattr(O, "LIST_ROWS", 7)
    monkeypatch.setattr(O, "LIST_READERS", 9)
    if twice:
        other = companies.filter("id % 40 < 5").withColumn("id", F.col("id") + 1000)
        null = companies.limit(3).withColumns({"id": F.col("id") + 2000, "name": F.lit(None)})
        companies = companies.unionByName(other.withColumn("subsectors", F.array(F.lit("x"))))
        companies = companies.unionByName(null.withColumn("name", F.col("name").cast("string")))
    cols = ["company_a", "company_b", "pos", "chunk"]
    plain = chunked(overlap_candidates(companies).select("company_a", "company_b")).select(*cols)
    listed = overlap_candidates(companies, listed=True)
    got = chunked(listed).select(*cols)
    assert listed.filter("size(others) > 50").isEmpty()
    assert got.count() == plain.count() > 0
    assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 0.85, 1.0])
@pytest.mark.parametrize("lenient", [True, False])
def test_similar_pairs_match_brute_force(companies, threshold, lenient):
    brute = _brute(companies)
    if lenient:
        brute = brute.filter(lenient_match("sub_subsectors_a", "sub_subsectors_b"))
    score = jaccard(
        F.array_union("sectors_a", "subsectors_a"), F.array_union("sectors_b", "subsectors_b")
    )
    brute = brute.select("id_a", "id_b", score.alias("score")).filter(F.col("score") >= threshold)
    got = similar_pairs(companies, threshold, lenient, block_rows=15).select("id_a", "id_b", "score")
    assert got.count() == brute.count()
    assert got.exceptAll(brute).count() == 0


def test_similar_pairs_of_a_probe(companies):
    probe = companies.filter("id % 5 = 0").select("id")
    every = similar_pairs(companies, 0.5).select("id_a", "id_b", "score")
    wanted = every.filter("id_a % 5 = 0 or id_b % 5 = 0")
    got = similar_pairs(companies, 0.5, probe=probe).select("id_a", "id_b", "score")
    assert got.exceptAll(wanted).count() == wanted.exceptAll(got).count() == 0


def test_two_hop_splits_hubs(spark, companies):
    links = [("c0000", f"c{i:04d}") for i in range(1, 90)] + [("c0100", "c0101"), ("c0101", "c0102")]
    edges = spark.createDataFrame(links, "company_a string, company_b string")
    few = two_hop_candidates(companies, edges, block_rows=5).select("company_a", "company_b")
    one = two_hop_candidates(companies, edges).select("company_a", "company_b")
    assert few.exceptAll(one).count() == one.exceptAll(few).count() == 0
    assert one.count() > 0


def _tagged(spark, rows):
    return spark.createDataFrame(
        rows, "id long, name string, sectors array<string>, subsectors array<string>, sub_subsectors array<string>"
    )


_ODD = [
    (1, "a", ["x"], ["s", "t"], []),
    (2, "b", ["x"], ["s", "t"], ["d"]),
    (3, "b", ["x"], ["s"], ["e"]),
    (4, None, ["x"], ["s", "t"], []),
    (5, "c", ["x", None], ["s", "t"], []),
    (6, "d", ["x", None], ["s", "t", None], ["d"]),
    (7, "e", [None], [None], []),
    (8, "f", None, None, None),
    (9, "g", ["y"], ["t", "s"], []),
]


def test_graph_edges_equal_filtered_scored_pairs(spark, monkeypatch):
    from tagweave import fixtures as fx

    monkeypatch.setattr(fx, "company", lambda spark, d: _tagged(spark, _ODD))
    fx_rows = lambda df: sorted(map(repr, df.collect()))
    strong = fx.edge_base.__wrapped__(spark, "odd").filter(F.col("score") >= fx.MIN_GRAPH_EDGE)
    found = fx.graph_base.__wrapped__(spark, "odd")
    assert fx_rows(found) == fx_rows(strong.select(*found.columns))
    assert found.count() > 5


def test_work_estimate_counts_as_many_as_the_sweep_forms(spark):
    companies = _tagged(spark, _ODD)
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "a"), ("c", "a"), ("a", "nobody"), ("a", "g"), (None, "a")],
        "company_a string, company_b string",
    )
    for probe in (None, companies.filter("id in (1, 2, 5)")):
        counts = candidate_counts(companies, edges, probe, block_rows=2)
        pairs = sweep_candidates(companies, edges, probe).groupBy("company_a").count()
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, pairs.collect()))
        assert "LeftAnti" not in counts._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block_rows", [2, 1000])
def test_known_pairs_are_left_out_where_pairs_form(spark, block_rows):
    """Also where names or ids repeat, and without a shuffle of the pairs."""
    rows = [*_ODD, *_ODD[:4], (20, "a", ["x"], ["s"], []), (9, "h", ["x"], ["s"], [])]
    companies = _tagged(spark, rows)
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "a"), ("c", "a"), ("a", "nobody"), ("g", "h"), (None, "a"), ("d", "d")],
        "company_a string, company_b string",
    )
    for probe in (None, companies.filter("id in (1, 2, 5, 20)")):
        every = overlap_candidates(companies, probe, ordered=True)
        got = sweep_candidates(companies, edges, probe, block_rows=block_rows)
        plain = without_linked(every, edges).select(*got.columns)
        assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0
        assert 0 < got.count() < every.count()
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan


def test_ranked_tags_need_no_shuffle_after_that_by_customer(spark):
    from tagweave import fixtures as fx

    rows = spark.createDataFrame(
        [(1, "t", "b1", "S0", 2.0), (1, "t", "b2", "S1", 3.0), (1, "u", "b2", None, 9.0), (2, None, "b1", "S0", 1.0)],
        "id long, p_type string, p_brand string, size string, q double",
    ).repartition("id")
    tags = fx._ranked_tags(rows)
    assert [tuple(r) for r in tags.orderBy("id").collect()] == [
        (1, ["u", "t"], ["b2", "b1"], [None, "S1", "S0"]),
        (2, [None], ["b1"], ["S0"]),
    ]
    assert tags._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    assert tags._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


@pytest.fixture(scope="module")
def odd_companies(spark):
    """Companies with null tags, rows that come twice and names that two ids share."""
    rng = random.Random(11)
    rows = []
    for i in range(150):
        rows.append(
            (
                i,
                f"c{i % 140:04d}" if i % 9 else f"c{i:04d}",
                rng.sample(["A", "B", None], rng.randint(1, 2)),
                rng.sample(["hot", "x", "y", None], rng.randint(0, 3)),
                rng.sample(["s0", "s1"], rng.randint(0, 2)),
            )
        )
    return _tagged(spark, rows + rows[::40]).cache()


def _same_rows(a, b):
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


@pytest.mark.parametrize("list_rows", [0, 3, 256])
def test_members_of_signatures_from_lists_and_rows(odd_companies, list_rows):
    brute = _brute(odd_companies).select(
        "id_a", "id_b",
        jaccard(
            F.concat("sectors_a", "subsectors_a"), F.concat("sectors_b", "subsectors_b")
        ).alias("score"),
    )
    got = similar_pairs(odd_companies, 1e-12, False, count_nulls=True, list_rows=list_rows)
    got = got.filter("company_a < company_b").select("id_a", "id_b", "score")
    assert got.count() > 0
    _same_rows(got, brute)


def test_company_pairs_are_not_shuffled(companies, monkeypatch):
    """Pairs of companies come from lists; only signatures meet by tags."""
    from tagweave.operators import similarity

    met = []

    def joined(left, right, keys, *rest):
        met.append(keys)
        return pair_join(left, right, keys, *rest)

    monkeypatch.setattr(similarity, "pair_join", joined)
    assert similar_pairs(companies, 0.5).count() > 0
    assert met == [["sector_key", "tag"]]


def test_two_hop_among_wanted_pairs(spark, odd_companies):
    links = [("c0000", f"c{i:04d}") for i in range(1, 60)] + [("c0070", "c0071"), ("c0071", "c0072")]
    edges = spark.createDataFrame(links, "company_a string, company_b string")
    every = two_hop_candidates(odd_companies, edges, keep_tags=True)
    wanted = spark.createDataFrame(
        [(a, b) for a in range(150) for b in range(0, 150, 3)], "id_a long, id_b long"
    )
    few = two_hop_candidates(odd_companies, edges, keep_tags=True, among=wanted)
    assert few.count() > 0
    _same_rows(few, every.filter("id_b % 3 = 0").select(*few.columns))


def test_new_companies_form_no_paths_of_weak_pairs(spark, companies, monkeypatch):
    """The built-in scorer looks paths up for pairs that reach the threshold, and finds what
    it finds when all paths are scored."""
    from tagweave.operators import overlap as O
    from tagweave.operators.scoring import jaccard_scorer
    from tagweave.plans.match import match_new

    new = companies.filter("id % 7 = 0")
    links = [(f"c{i:04d}", f"c{(i * 5 + 1) % 240:04d}") for i in range(0, 240, 2)]
    edges = spark.createDataFrame(links, "company_a string, company_b string")
    every = match_new(new, companies, edges, jaccard_scorer, 0.6).cache()

    def by_pairs(left, right, keys, *rest, **named):
        assert "hub" not in keys
        return pair_join(left, right, keys, *rest, **named)

    monkeypatch.setattr(O, "pair_join", by_pairs)
    got = match_new(new, companies, edges, threshold=0.6).cache()
    assert got.count() > 0
    _same_rows(got, every)


def test_similar_pairs_meet_in_generated_code(companies):
    """A function of a lambda in the join's condition would test every pair outside of it."""
    plan = similar_pairs(companies, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "tag_bits_a" in line]
    assert joins and not any("lambda" in line for line in joins)


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_rows_of_a_signature_make_no_difference(odd_companies, threshold):
    """Also for pairs of one name, for which the name decides inside a signature only."""
    probe = odd_companies.filter("id % 4 = 0").select("id")
    for of in (None, probe):
        few = similar_pairs(odd_companies, threshold, probe=of, list_rows=2)
        _same_rows(few, similar_pairs(odd_companies, threshold, probe=of, list_rows=1000))
        assert few.count() > 0


def test_edges_are_formed_and_not_written(spark, monkeypatch):
    """Of the edges only the lists that they come from are written, and stored edges that
    come twice come from one pass over the pairs."""
    from tagweave import fixtures as fx
    from tagweave.operators import similarity

    companies, met = _tagged(spark, [(13 * i, *r[1:]) for i, r in enumerate(_ODD)]), []

    def joined(*args):
        met.append(args[2])
        return pair_join(*args)

    def no_write(df, label):
        raise AssertionError(f"{label} written")

    monkeypatch.setattr(fx, "company", lambda spark, d: companies)
    monkeypatch.setattr(fx, "durable", no_write)
    monkeypatch.setattr(similarity, "pair_join", joined)
    base = fx.graph_base(spark, "formed").collect()
    want = []
    for a, b, first, second, score in base:
        for again in (False, True) if b % 13 == 0 else (False,):
            ends = (second, first) if (b % 7 == 0) != again else (first, second)
            end = f"Ghost#{b}" if b % 97 == 0 else ends[1]
            want.append((a + 1000000000 * again, b, ends[0], end, score / 2 if again else score))
    want = [(a * 1000000 + b, x, y, s, (a + b) % 10 != 0, (a + b) % 3 == 0) for a, b, x, y, s in want]
    got = fx.messy_edge(spark, "formed")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(want) and len(want) > len(base) > 5
    assert met == [["sector_key", "tag"]] and plan.count("Union") == 0
