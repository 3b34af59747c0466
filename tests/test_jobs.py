"""Reviews, classification, upserts, and repeatability of jobs."""

import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave import fixtures as fx
from tagweave.catalog import streams
from tagweave.constants import HORIZONTAL_SUBSECTORS
from tagweave.operators import audit as A
from tagweave.operators import edges as E
from tagweave.operators import reviews as R
from tagweave.operators.taxonomy import TagRules, classify
from tagweave.sources import parts
from tagweave.sources.readers import read_edges
from tagweave.sources.writers import upsert_changes, upsert_companies, upsert_entities
from tagweave.streaming import jobs as J

TAXONOMY = [
    ("Cybersecurity", "IAM / PAM", None),
    ("Cybersecurity", "Uncategorized", None),
    ("AI & Machine Learning", "General Purpose AI Models", None),
    ("AI & Machine Learning", "Speech & Audio AI", None),
    ("AI & Machine Learning", "Uncategorized", None),
    ("Enterprise Software", "ERP & Business Operations", None),
    ("Enterprise Software", "Productivity Tools", "Notes"),
    ("Enterprise Software", "Productivity Tools", "Mail"),
    ("Enterprise Software", "Uncategorized", None),
]

REVIEWS = [
    ("not_a_real_type", "x", "ambiguous", None),
    ("taxonomy_split", "IAM / PAM", "isolated mis-tag", "IAM / PAM"),
    ("taxonomy_split", "IAM / PAM", "structural gap", "IAM / PAM"),
    ("taxonomy_split", "IAM / PAM", "scraping artifact", "IAM / PAM"),
    ("taxonomy_split", "IAM / PAM", "ambiguous", "IAM / PAM"),
    ("taxonomy_split", "AI & Machine Learning", "ambiguous", None),
    ("taxonomy_split", "Not A Real Sector", "ambiguous", None),
    ("taxonomy_split", "IAM / PAM", "not a real verdict", None),
    ("taxonomy_split", "IAM / PAM", "", None),
    ("scraping_diagnostic", "example.com", "   ", None),
    ("scraping_diagnostic", "https:///path", "blocking page", None),
    ("scraping_diagnostic", "https://Example.com/", "blocking page", "example.com"),
    ("scraping_diagnostic", "example.com", "free text", "example.com"),
    ("redundant_uncategorized_cleanup", "  Acme ", "fixed", "Acme"),
    ("empty_subsectors_backfill", "  ", "fixed", None),
]


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame(TAXONOMY, "sector string, subsector string, sub_subsector string")


def test_review_rules(spark, taxonomy):
    rows = [(i, *r) for i, r in enumerate(REVIEWS)]
    df = spark.createDataFrame(
        rows, "id long, review_type string, subject string, verdict string, expected string"
    )
    got = R.checked_reviews(df, taxonomy)
    assert got.filter(~F.col("clean_subject").eqNullSafe(F.col("expected"))).collect() == []
    assert got.filter("expected is null and error is null").count() == 0


def test_refused_requests_answer_nothing(spark, taxonomy):
    stored = spark.createDataFrame(
        [(1, "taxonomy_split", "IAM / PAM"), (2, "scraping_diagnostic", "example.com")],
        "id long, review_type string, subject string",
    )
    requests = spark.createDataFrame(
        [
            ("bad type", "nope", None),
            ("a sector", "taxonomy_split", "Cybersecurity"),
            ("no domain", "scraping_diagnostic", "https:///path"),
            ("ok", "scraping_diagnostic", "https://www.example.com/x"),
            ("all", "taxonomy_split", None),
        ],
        "request_id string, review_type string, subject string",
    )
    got = {r.request_id for r in R.query_reviews(stored, requests, taxonomy).collect()}
    assert got == {"ok", "all"}


def test_a_question_of_many_requests_is_answered_once(spark, taxonomy):
    stored = spark.createDataFrame(
        [(i, "scraping_diagnostic", "example.com") for i in range(30)]
        + [(50, "taxonomy_split", "IAM / PAM"), (51, "redundant_uncategorized_cleanup", "Acme")],
        "id long, review_type string, subject string",
    )
    requests = spark.createDataFrame(
        [(f"page {i}", "scraping_diagnostic", f"https://www.example.com/{i}") for i in range(40)]
        + [
            ("bad type", "nope", None),
            ("all", "taxonomy_split", None),
            ("again", "taxonomy_split", None),
            ("one", "taxonomy_split", "IAM / PAM"),
            ("one", "taxonomy_split", "IAM / PAM"),
            ("plain", "redundant_uncategorized_cleanup", "Acme"),
            ("blanks", "redundant_uncategorized_cleanup", " Acme "),
            (None, "redundant_uncategorized_cleanup", "Acme"),
            ("unknown", "scraping_diagnostic", "https://elsewhere.example.org/"),
        ],
        "request_id string, review_type string, subject string",
    )
    questions, asked = R.distinct_questions(requests, taxonomy)
    assert questions.count() == 5
    answers = R.query_reviews(stored, questions, taxonomy).select(F.col("request_id").alias("question"), "id")
    assert answers.count() == 30 + 1 + 1 + 1
    expected = R.query_reviews(stored, requests, taxonomy).select("request_id", "id")
    got = asked.join(answers, "question").select("request_id", "id")
    assert got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0
    assert got.count() == 40 * 30 + 2 + 2 + 3


def _predict(spark, sectors, subs, deep=()):
    rows = [(1, "sector", None, None, s, i + 1, 0.9) for i, s in enumerate(sectors)]
    rows += [(1, "subsector", sec, None, lab, i + 1, c) for i, (sec, lab, c) in enumerate(subs)]
    rows += [(1, "sub_subsector", *d[:2], d[2], i + 1, d[3]) for i, d in enumerate(deep)]
    return spark.createDataFrame(
        rows,
        "id long, level string, sector string, subsector string, label string, pos int, confidence double",
    )


AI, ERP, SEC = "AI & Machine Learning", "Enterprise Software", "Cybersecurity"


@pytest.mark.parametrize(
    "orig, kept",
    [
        (["Uncategorized"], False),
        (["General Purpose AI Models"], True),
        (["Speech & Audio AI", "Uncategorized"], True),
        (["Speech & Audio AI", "ERP & Business Operations"], False),
    ],
)
def test_sector_without_tags_stays_only_if_all_were_horizontal(spark, orig, kept):
    # the sector under test may hold any of the labels
    tax = spark.createDataFrame(
        [("S", x, None) for x in orig] + [(ERP, "Productivity Tools", None)],
        "sector string, subsector string, sub_subsector string",
    )
    subs = [("S", x, 0.95) for x in orig] + [(ERP, "Productivity Tools", 0.95)]
    row = classify(_predict(spark, ["S", ERP], subs), tax).first()
    assert ("S" in row.sectors) is kept
    assert row.subsectors == ["Productivity Tools"]


def test_never_drops_every_sector(spark, taxonomy):
    subs = [(SEC, "IAM / PAM", 0.8), (ERP, "Productivity Tools", 0.8)]
    row = classify(_predict(spark, [SEC, ERP], subs), taxonomy).first()
    assert (row.sectors, row.subsectors) == ([SEC], ["IAM / PAM"])


def test_low_confidence_and_details(spark, taxonomy):
    weak = _predict(spark, [SEC], [(SEC, "IAM / PAM", 0.9)]).withColumn("confidence", F.lit(0.5))
    row = classify(weak, taxonomy).first()
    assert (row.sectors, row.subsectors) == (["Uncategorized"], ["Uncategorized"])
    deep = [(ERP, "Productivity Tools", "Notes", 0.7), (ERP, "Productivity Tools", "Mail", 0.9),
            (ERP, "Productivity Tools", "Other", 1.0)]
    row = classify(_predict(spark, [ERP], [(ERP, "Productivity Tools", 0.95)], deep), taxonomy).first()
    assert row.sub_subsectors == ["Mail", "Notes"]
    assert HORIZONTAL_SUBSECTORS == TagRules().horizontal


def test_jobs_repeat_without_effect(spark, sf_dir):
    edges = fx.edge(spark, sf_dir)
    once = E.recalibrated(edges, 0.6)
    assert E.recalibration_counts(once, 0.6).first().newly_inactive == 0
    assert E.recalibrated(once, 0.6).exceptAll(once).count() == 0
    companies = fx.company(spark, sf_dir)
    fixed = A.apply_fixes(companies, A.redundant_uncategorized_fixes(companies))
    assert A.redundant_uncategorized_fixes(fixed).count() == 0
    filled = A.apply_fixes(companies, A.empty_subsector_fixes(companies))
    assert A.empty_subsector_fixes(filled).count() == 0


COMPANY_COLS = "id long, name string, website string, description string, taxonomy_version string"


def test_upsert_follows_arrival_order(spark):
    stored = fx_company(spark, [(1, "A", "https://a.com", "old", "v1"), (2, "B", None, "b", "v1")])
    batch = spark.createDataFrame(
        [
            (1, "Anew", "https://a.com", None),  # by website
            (2, "B", "https://b.com", "bb"),  # by name
            (3, "C", "https://c.com", "c1"),  # new
            (4, "C2", "https://c.com", "c2"),  # same new company by website
            (5, "D", None, "d"),  # new
            (6, "", "https://x.com", "nameless"),
        ],
        "pos long, name string, website string, description string",
    )
    table, actions = upsert_companies(stored, batch)
    got = {r.id: (r.name, r.website, r.description, r.taxonomy_version) for r in table.collect()}
    assert got == {
        1: ("Anew", "https://a.com", "old", "v2"),
        2: ("B", "https://b.com", "bb", "v2"),
        3: ("C2", "https://c.com", "c2", "v2"),
        4: ("D", None, "d", "v2"),
    }
    assert [r.action for r in actions.orderBy("pos").collect()] == [
        "updated", "updated", "saved", "updated", "saved", "refused",
    ]
    again, second = upsert_companies(table, batch)
    assert again.exceptAll(table).count() == 0
    assert {r.action for r in second.collect()} == {"updated", "refused"}


def test_upsert_sees_what_earlier_rows_left(spark):
    columns = "pos long, name string, website string, description string"

    def run(stored, batch, **how):
        table, actions = upsert_companies(
            fx_company(spark, stored), spark.createDataFrame(batch, columns), **how
        )
        rows = sorted((r.id, r.name, r.website, r.description) for r in table.collect())
        return rows, [r.action for r in actions.orderBy("pos").collect()]

    # a stored company takes a new name, by which the next row finds it
    assert run([(1, "A", "https://a", "d", "v1")], [(1, "X", "https://a", "p"), (2, "X", None, "q")]) == (
        [(1, "X", "https://a", "q")], ["updated", "updated"],
    )
    # and no longer has the old one
    assert run([(1, "A", "https://a", "d", "v1")], [(1, "X", "https://a", "p"), (2, "A", None, "q")]) == (
        [(1, "X", "https://a", "p"), (2, "A", None, "q")], ["updated", "saved"],
    )
    chain = [(1, "N1", "s1", "1"), (2, "N2", "s1", "2"), (3, "N2", "s3", "3"), (4, "N4", "s3", "4"),
             (5, "N4", "s5", "5")]
    assert run([(9, "Z", "z", "z", "v1")], chain) == (
        [(9, "Z", "z", "z"), (10, "N4", "s5", "5")], ["saved"] + ["updated"] * 4,
    )
    # nulls overwrite where that is asked for
    assert run([(1, "A", "a", "d", "v1")], [(5, "A", None, None)], write_nulls=True) == (
        [(1, "A", None, None)], ["updated"],
    )


def replayed(stored, batch, write_nulls):
    """Rows applied one after the other: pos -> (stored?, number)."""
    state = {(0, i): [name, site] for i, name, site in stored}
    out = {}
    for pos, name, site in batch:
        found = [c for c, (_, s) in state.items() if site and s == site]
        found = found or [c for c, (n, _) in state.items() if name and n == name]
        company = min(found) if found else (1, pos)
        old = state.get(company, [None, None])
        state[company] = [
            new if new is not None or write_nulls else was for new, was in zip((name, site), old)
        ]
        out[pos] = company
    return out


def placed_rows(spark, stored, batch, write_nulls=False):
    placed = upsert_entities(
        spark.createDataFrame(stored, "id long, name string, website string"),
        spark.createDataFrame(batch, "pos long, name string, website string"),
        write_nulls,
    )
    return {r.pos: (0, r.match_id) if r.entity is None else (1, r.entity) for r in placed.collect()}


@pytest.mark.parametrize("seed, kinds, write_nulls", [(1, 4, False), (2, 12, True), (3, 40, False)])
def test_upsert_in_rounds_equals_replay(spark, seed, kinds, write_nulls):
    pick = random.Random(seed)

    def row(number):
        name = f"n{pick.randrange(kinds)}"
        return number, name, pick.choice([None, "", *[f"s{pick.randrange(kinds)}"] * 4])

    stored = [row(i) for i in range(1, kinds)]
    batch = [row(pos) for pos in pick.sample(range(-50, 1000), 80)]
    expected = replayed(stored, sorted(batch), write_nulls)
    assert placed_rows(spark, stored, batch, write_nulls) == expected


def test_upsert_of_long_chains_and_hot_keys(spark):
    stored = [(i, f"old {i}", f"https://old/{i}") for i in range(500)]
    # each row shares a name or a website with the next one
    chain = [(i, f"link {(i + 1) // 2}", f"https://link/{i // 2}") for i in range(10_000)]
    assert set(placed_rows(spark, stored, chain).values()) == {(1, 0)}
    # a website in a third of the rows, under a new name each time; a name in another third,
    # for stored companies and for unknown websites
    hot = []
    for i in range(1500):
        hot.append((3 * i, f"name {i}", "https://hot"))
        hot.append((3 * i + 1, "Hot", f"https://old/{i}"))
        hot.append((3 * i + 2, f"plain {i}", None))
    assert placed_rows(spark, stored, hot) == replayed(stored, hot, False)


def fx_company(spark, rows):
    from tagweave.schemas import COMPANY, evolve

    return evolve(spark.createDataFrame(rows, COMPANY_COLS), COMPANY)


def test_ingest_stream_equals_batches(spark, sf_dir, tmp_path):
    """The stream leaves what upserting its waves one after the other leaves."""
    pages = streams.arrivals(spark, sf_dir).drop("event_time")
    companies, edges = fx.company(spark, sf_dir), fx.known_edge(spark, sf_dir)
    root = str(tmp_path / "ingest")

    def start(stream):
        return J.ingest_batches(
            stream, fx.prediction(spark, sf_dir), fx.taxonomy(spark, sf_dir),
            companies, edges, root, fx.RULES, threshold=0.6,
        )

    streams.feed(pages, "page_id", start, 2)
    after = J.current_companies(companies, f"{root}/companies")
    assert after.count() == after.select("id").distinct().count() >= companies.count()
    tags = classify(fx.prediction(spark, sf_dir), fx.taxonomy(spark, sf_dir), fx.RULES)
    from tagweave.operators.pages import page_facts

    good = page_facts(pages).filter("gate = 'accepted'").join(pages.select("page_id", "name"), "page_id")
    arrivals = good.join(tags.select(F.col("id").alias("page_id"), "sectors", "subsectors", "sub_subsectors"), "page_id").select(
        F.col("page_id").alias("pos"), "name", F.col("url").alias("website"),
        "sectors", "subsectors", "sub_subsectors", "linkedin_url",
    )
    cut = pages.agg(F.percentile_approx("page_id", [0.5])).first()[0][0]
    expected = companies
    for part in (arrivals.filter(F.col("pos") <= cut), arrivals.filter(F.col("pos") > cut)):
        expected, _ = upsert_companies(expected, part)
    assert after.exceptAll(expected).count() == expected.exceptAll(after).count() == 0
    added = J.batches_before(spark, f"{root}/edges", edges.schema)
    pair = added.select(F.least("company_a", "company_b"), F.greatest("company_a", "company_b"))
    assert pair.count() == pair.distinct().count()


def test_old_edge_files_take_defaults(spark, tmp_path):
    path = str(tmp_path / "edges")
    old = spark.createDataFrame([(1, "A", "B", 0.9)], "id long, company_a string, company_b string, score double")
    old.write.parquet(path)
    row = read_edges(spark, path, active_only=True).first()
    assert (row.active, row.checked, row.validated) == (True, False, None)


def test_only_changed_companies_are_written(spark):
    stored = fx_company(spark, [(1, "A", None, "a", "v1"), (2, "B", None, "b", "v1")])
    batch = spark.createDataFrame([(1, "B", "new")], "pos long, name string, description string")
    changed, _ = upsert_changes(stored, batch)
    assert [(r.id, r.description) for r in changed.collect()] == [(2, "new")]


def test_files_of_two_versions_in_one_folder(spark, tmp_path):
    """A missing column has its default in the old file only; a stored null stays."""
    path = str(tmp_path / "edges")
    old = spark.createDataFrame([(1, "a", "b", 0.9)], "id long, company_a string, company_b string, score double")
    new = spark.createDataFrame(
        [(2, "a", "c", 0.8, None, True), (3, "b", "c", 0.7, False, None)],
        "id long, company_a string, company_b string, score double, active boolean, checked boolean",
    )
    old.write.parquet(path)
    new.write.mode("append").parquet(path)
    rows = {r.id: (r.active, r.checked, r.validated) for r in read_edges(spark, path).collect()}
    assert rows == {1: (True, False, None), 2: (None, True, None), 3: (False, None, None)}
    active = read_edges(spark, path, active_only=True)
    assert [r.id for r in active.collect()] == [1]
    plan = active._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(active,true)" in plan.replace(" ", "") or "IsNotNull(active)" in plan


def test_partitioned_folder_of_several_versions(spark, tmp_path):
    """Partition columns stay, in folders of one version and of two."""
    from tagweave.schemas import COMPANY
    from tagweave.sources.readers import read_versions

    path = str(tmp_path / "companies")
    old = spark.createDataFrame([(1, "a", "FR"), (2, "b", "DE")], "id long, name string, country string")
    old.write.partitionBy("country").parquet(path)
    first = read_versions(spark, path, COMPANY)
    assert {(r.id, r.country) for r in first.collect()} == {(1, "FR"), (2, "DE")}
    new = old.withColumns({"id": F.col("id") + 10, "website": F.lit("x.org")})
    new.write.mode("append").partitionBy("country").parquet(path)
    both = read_versions(spark, path, COMPANY)
    assert {(r.id, r.country, r.website) for r in both.collect()} == {
        (1, "FR", None), (2, "DE", None), (11, "FR", "x.org"), (12, "DE", "x.org"),
    }


SCORE_ITEM = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("score", T.StringType())]
)


def test_missing_scores_count_and_null_scores_do_not(spark):
    from tagweave.functions.text import reply_items
    from tagweave.operators.scoring import accepted_scores

    reply = '[{"name": "a"}, {"name": "b", "score": null}, {"name": "c", "score": 0.4}, {"name": "d", "score": "x"}]'
    rows = spark.createDataFrame([("me", reply)], "company_a string, reply string")
    items = rows.select(
        "company_a", F.explode(reply_items("reply", SCORE_ITEM, {"score": "0"})).alias("i")
    ).select("company_a", "i.*")
    chunks = spark.createDataFrame(
        [("me", x, 1) for x in "abcd"], "company_a string, company_b string, pos int"
    )
    got = {r.company_b: r.score for r in accepted_scores(items, chunks).collect()}
    assert got == {"a": 0.0, "c": 0.4}


def test_reviews_by_date_survive_restarts_late_rows_and_copies(spark, tmp_path):
    """Rows wait for their place by date; late ones drop out, copies count once."""
    schema = "id long, source string, verdict string, date_diagnosed timestamp"

    def row(id, source, verdict, day):
        return (id, source, verdict, None if day is None else datetime(2024, 1, day))

    waves = [
        [row(1, "a", "ok", 1), row(2, "a", "ok", 3), row(3, "a", "bad", 10), row(4, None, "ok", 4)],
        # after day 10 all up to day 8 is late
        [row(5, "a", "slow", 9), row(6, "a", "gone", 2), row(7, "a", "edge", 8), row(3, "a", "bad", 10)],
        [row(8, "a", "none", None), row(9, "b", "ok", 11)],
        [row(None, None, None, 31)],
    ]
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    for wave in waves:
        df = spark.createDataFrame(wave, schema).coalesce(1)
        df.write.mode("append").parquet(path)
        stream = J.file_stream(spark, path, df.schema)
        J.running_stability_by_date(stream, root, "2 days").awaitTermination()
    firsts = J.batches_before(spark, f"{root}/firsts", J._FIRSTS).groupBy("source", "verdict").agg(
        F.min("first")
    )
    assert {tuple(r) for r in firsts.collect()} == {
        ("a", "ok", 1), ("a", "slow", 3), ("a", "bad", 4), ("b", "ok", 1), (None, "ok", 1),
    }
    assert {tuple(r) for r in J.lengths_written(spark, root).collect()} == {
        ("a", 4), ("b", 1), (None, 1),
    }
    cuts = {r.source: r.cut for r in J.stability_written(spark, root, 2).collect()}
    assert cuts == {"a": None, "b": None, None: None}


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    """Folders without a changed row keep their files; new ids open new folders."""
    path = str(tmp_path / "companies")
    stored = fx_company(spark, [(i, f"c{i}", None, "d", "v1") for i in range(100)])
    parts.write_parts(stored, path, 10)

    def files():
        return {f.parent.name: {f.name for f in f.parent.glob("*.parquet")} for f in Path(path).glob("part=*/*.parquet")}

    before = files()
    batch = spark.createDataFrame(
        [(1, "c42", "new"), (2, "c45", "newer"), (3, "d", "fresh")],
        "pos long, name string, description string",
    )
    actions, touched = parts.upsert_parts(spark, path, batch, 10)
    after = files()
    assert touched == [4, 10]
    assert {k for k in after if before.get(k) != after[k]} == {"part=4", "part=10"}
    assert {(r.name, r.action, r.id) for r in actions.collect()} == {
        ("c42", "updated", 42), ("c45", "updated", 45), ("d", "saved", 100),
    }
    expected, _ = upsert_companies(stored, batch)
    got = parts.read_parts(spark, path, stored.schema).drop("part")
    assert got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0
    # a second run of the same rows, as after a break, leaves the same table
    parts.upsert_parts(spark, path, batch, 10)
    again = parts.read_parts(spark, path, stored.schema).drop("part")
    assert again.exceptAll(expected).count() == expected.exceptAll(again).count() == 0
    # an update reads its folders only, and unknown ids change nothing
    changes = spark.createDataFrame([(7, "x"), (999, "y")], "id long, country string")
    assert parts.update_parts(spark, path, changes, ["country"], stored.schema, 10) == [0]
    rows = parts.read_parts(spark, path, stored.schema).filter("country is not null").collect()
    assert [(r.id, r.country) for r in rows] == [(7, "x")]
    assert parts.replace_rows(spark, path, expected.limit(0), stored.schema, 10) == []
