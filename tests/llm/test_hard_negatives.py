"""Hard negatives against a plain computation over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import hard_negatives
from tagweave.llm.hard_negatives import Lists, threshold_search
from tagweave.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, label int, v array<long>"


def plain(rows, is_anchor, k=5, m=5, low=80, high=100):
    usable = [r for r in rows if None not in r]
    width = max((len(r[2]) for r in usable), default=0)
    usable = [(i, x, list(v) + [0] * (width - len(v))) for i, x, v in usable]
    out = []
    for anchor, label, v in {(i, x, tuple(v)) for i, x, v in usable if is_anchor(i)}:
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w, strict=True)), i, x == label)
            for i, x, w in usable if i != anchor
        )
        for s, positive, _ in [r for r in scored if r[2]][:k]:
            hard = [
                (-n, i) for n, i, same in scored
                if not same and low * -s <= 100 * -n <= high * -s
            ][:m]
            out += [(anchor, positive, r, i, -s, n) for r, (n, i) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(
        tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **options).collect()
    )


@pytest.mark.parametrize("spread", [2, 40])
def test_equals_all_pairs(spark, spread):
    pick = random.Random(spread)
    rows = [
        (i, pick.randrange(3), [pick.randint(-spread, spread) for _ in range(6)])
        for i in range(1500)
    ]
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    rows = [
        (0, 1, [3, 4]), (0, 1, [3, 4]), (10, 1, [3, 4]), (11, 1, [3, 4]), (12, 2, [3, 4]),
        (12, 2, [3, 4]), (13, 2, [3]), (14, 2, []), (20, 2, []), (30, 3, [0, 0]),
        (None, 1, [1, 1]), (15, None, [1, 1]), (16, 1, None), (40, 9, [1 << 27, -(1 << 27)]),
        (41, 9, [1 << 27, -(1 << 27)]), (42, 8, [(1 << 27) - 1, -(1 << 27)]), (-10, 1, [-3, -4]),
    ]
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []
    assert mined(spark, [(10, 1, [1])]) == []


def test_options(spark):
    pick = random.Random(5)
    rows = [(i, i % 4, [pick.randint(-9, 9) for _ in range(3)]) for i in range(300)]
    got = mined(spark, rows, positives=2, negatives=7, percent=(50, 120))
    assert got == plain(rows, lambda i: i % 10 == 0, 2, 7, 50, 120)


def test_the_search_stops_early():
    """One strong dimension: the anchor's own end of its list is enough."""
    n = 20_000
    rng = np.random.default_rng(1)
    vectors = np.column_stack((np.arange(n), rng.integers(0, 3, n), rng.integers(0, 3, n)))
    lists = Lists.of(np.arange(n), np.zeros(n, int), vectors)
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and isinstance(key[1], slice):
                reads.append(key[1].stop - key[1].start)
            return super().__getitem__(key)

    lists.order = lists.order.view(Watched)
    query = np.array([-5, 1, 1])
    best = threshold_search(lists, query, np.ones(n, bool), [(-np.inf, np.inf)], 3)
    scores = vectors @ query
    want = sorted(zip((-scores).tolist(), range(n), strict=True))[:3]
    assert best[0] == [(-s, i) for s, i in want]
    assert sum(reads) < n // 10


def test_vectors_of_the_query(spark):
    rows = [
        (1, [0.5, -0.001]), (2, [None, 1.0]), (3, None), (4, [float("nan")]),
        (5, [float("inf")]), (6, []), (7, [1e30]),
    ]
    df = spark.createDataFrame(rows, "i int, e array<float>")
    got = {r.i: r.v for r in df.select("i", hard_negatives.whole(F.col("e")).alias("v")).collect()}
    most = hard_negatives.LARGEST
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: [], 7: [most]}


def test_query_on_its_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = []
    for r in table:
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [int(np.floor(256 * float(x))) for x in r.embedding]))
    got = sorted(tuple(r) for r in op11_hard_negatives(spark, sf_dir).collect())
    assert got == plain(rows, lambda i: i % 100 == 0)
    assert got
