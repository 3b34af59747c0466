"""Indexed substring search, cosine pairs above a threshold, and progressive diagnosis."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tagweave.operators import pages as P
from tagweave.operators.cosine import candidate_pairs, similar_texts, vector_prefixes
from tagweave.operators.scoring import term_weights
from tagweave.operators.substring import (
    _asked,
    build_index,
    matching_postings,
    met_postings,
    search_many,
)

ROWS = [
    (1, "Acme Labs", "https://acme.example.org"),
    (2, "ACME", None),
    (3, "x", ""),
    (4, None, "https://labs.example.net/100%_sure"),
    (5, "Zürich Öl", "http://aaa.aaaa"),
    (6, "Acme Labs", "https://acme.example.org"),
]


def test_indexed_search_equals_the_scan(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "id long, name string, website string")
    path = str(tmp_path / "index")
    build_index(rows, ["name", "website"], path)
    texts = ["acme", " ACME ", "la", "bs", "x", "", None, "aaaa", "aaaaa", "%_s", "öl", "Öl", "e l", "org", "eorg",
             "https://", "labs.example", "acme.labs", "ZÜR", "g\u0001"]
    queries = spark.createDataFrame([(t,) for t in texts], "query string")
    got = {(r.query, r.id) for r in search_many(path, rows, queries, ["name", "website"]).collect()}
    asked = {t.strip().lower() for t in texts if t is not None and len(t.strip()) >= 2}
    expected = {
        (t, i) for t in asked for i, *fields in ROWS if any(t in (f or "").lower() for f in fields)
    }
    assert got == expected
    assert search_many(path, rows, queries.limit(0), ["name", "website"]).count() == 0


def test_search_reads_the_asked_folders_only(spark, tmp_path):
    rows = spark.range(2000).select("id", F.md5(F.col("id").cast("string")).alias("name"))
    path = str(tmp_path / "index")
    build_index(rows, ["name"], path)
    asked = spark.createDataFrame([("abc", 7, "ab")], "gram string, slot int, head string")
    postings = matching_postings(path, asked)
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*slot", plan)
    everything = spark.read.parquet(f"{path}/postings").count()
    assert 0 < postings.count() + 1 < everything / 20


def test_a_search_meets_its_own_rows_only(spark, tmp_path):
    """Numbered names share their runs of zeros: those once met each query with such a run."""
    names = [(i, f"Customer#{i * 7:09d}") for i in range(3000)]
    rows = spark.createDataFrame(names, "id long, name string")
    path = str(tmp_path / "index")
    build_index(rows, ["name"], path)
    texts = [f"{n:04d}" for n in range(0, 10000, 3)]
    queries = spark.createDataFrame([(t,) for t in texts], "query string")
    met = met_postings(path, _asked(queries, spark.read.parquet(f"{path}/counts")))
    held = Counter(n[i : i + 4] for _, n in names for i in range(len(n) - 3))
    assert met.count() <= sum(held[t] for t in texts)
    found = search_many(path, rows, queries, ["name"])
    assert found.count() == sum(len({n for _, n in names if t in n}) for t in texts if held[t])


def test_searches_of_any_length_equal_the_scan(spark, tmp_path):
    pick = random.Random(3)
    texts = ["".join(pick.choices("ab0", k=pick.randrange(0, 14))) for _ in range(150)]
    # rows may share an id
    stored = [(i // 2, t if i % 9 else None) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(stored, "id long, name string")
    path = str(tmp_path / "index")
    build_index(rows, ["name"], path)
    asked = {"".join(pick.choices("ab0", k=pick.randrange(2, 11))) for _ in range(300)} | set(texts[1:9])
    queries = spark.createDataFrame([(t,) for t in asked], "query string")
    got = Counter((r.query, r.id, r.name) for r in search_many(path, rows, queries, ["name"]).collect())
    expected = Counter((t, i, n) for t in asked if len(t) >= 2 for i, n in stored if n and t in n)
    assert got == expected


def _cosines(texts):
    words = {i: Counter(w for w in re.split(r"[^a-z]+", t.lower()) if w) for i, t in texts if t is not None}
    df = Counter(w for c in words.values() for w in c)
    unit = {}
    for i, c in words.items():
        v = {w: n * math.log((1 + len(words)) / (1 + df[w])) for w, n in c.items()}
        v = {w: x for w, x in v.items() if x > 0}
        norm = math.sqrt(sum(x * x for x in v.values()))
        if norm:
            unit[i] = {w: x / norm for w, x in v.items()}
    return {
        (a, b): sum(x * unit[b].get(w, 0) for w, x in unit[a].items())
        for a in unit for b in unit if a < b
    }


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "abcdef" for b in "ghij" for c in "klm"]
    out = [(0, None), (1, ""), (2, "common"), (3, "common")]
    for i in range(4, 120):
        if i % 3 == 1 and i > 10:
            words = out[i - 3][1].split()
            for _ in range(pick.randrange(4)):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
        else:
            words = ["common", *pick.choices(vocabulary, k=pick.randrange(3, 25))]
        out.append((i, " ".join(words)))
    return [*out, (500, out[20][1]), (501, out[20][1])]


@pytest.mark.parametrize("threshold", [0.9, 0.75, 0.3])
def test_cosine_pairs_equal_brute_force(spark, texts, threshold):
    rows = spark.createDataFrame(texts, "id long, description string")
    got = {(r.id_a, r.id_b): r.score for r in similar_texts(rows, threshold).collect()}
    expected = {p: s for p, s in _cosines(texts).items() if s >= threshold}
    assert got == pytest.approx(expected)
    assert (500, 501) in got and len(got) > 10


def test_most_pairs_are_never_formed(spark, texts):
    weights = term_weights(spark.createDataFrame(texts, "id long, description string"))
    pairs = candidate_pairs(vector_prefixes(weights, 0.9), 0.9).count()
    sharing = sum(1 for s in _cosines(texts).values() if s > 0)
    assert pairs < sharing / 5


def test_diagnosis_extracts_up_to_twice_its_cut(spark, monkeypatch):
    pages = spark.range(300).select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("https://site"), "id", F.lit(".example.org/")).alias("url"),
        F.lit("<html><body><p>Some words of a page.</p></body></html>").alias("html"),
    )
    sizes = defaultdict(int)
    plain = P.characterized

    def counting(texts):
        sizes["extracted"] += texts.count()
        return plain(texts)

    monkeypatch.setattr(P, "characterized", counting)
    known = spark.createDataFrame([("site3.example.org",)], "subject string")
    reviews, summary = P.diagnose(pages, known, seed=1, streak=5)
    row = summary.first()
    assert (row.characterized, row.stop_reason) == (reviews.count(), "stability_reached")
    assert 0 < sizes["extracted"] <= 2 * row.characterized
    # a streak that never comes takes all pages but the known one
    reviews, summary = P.diagnose(pages, known, seed=1, streak=1000)
    assert (reviews.count(), summary.first().stop_reason) == (299, "sample_exhausted")
