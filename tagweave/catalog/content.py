"""Page jobs and review-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave import fixtures as fx
from tagweave.catalog.registry import query
from tagweave.dataflow import durable, fresh_path, global_rank, seeded
from tagweave.functions import html as H
from tagweave.functions.text import short_label
from tagweave.functions.urls import file_extension, normalize_domain, resolve_url, slugify
from tagweave.operators import pages as P
from tagweave.operators import reviews as R
from tagweave.schemas import REVIEW

# ---- page columns -------------------------------------------------------------


@query("x01_normalize_domain", "select page_id, domain from pages join f_domain using (url)")
def x01(spark, d):
    return fx.table(spark, d, "pages").select("page_id", normalize_domain("url").alias("domain"))


@query(
    "x02_slugify",
    "select p_partkey, translate(lower(p_name || '/' || p_brand), ' /', '__') as slug from part",
)
def x02(spark, d):
    name = F.concat("p_name", F.lit("/"), "p_brand")
    return fx.table(spark, d, "part").select("p_partkey", slugify(name).alias("slug"))


_ATTR = r"""regexp_extract(t, '(?i)(?:^|[^\w:-])NAME=["'']([^"'']*)["'']', 1)"""


def attr_sql(name: str) -> str:
    return _ATTR.replace("NAME", name)


@query(
    "x03_image_sources",
    f"""select page_id, {attr_sql('src')} as src, {attr_sql('alt')} as alt from (
        select page_id, unnest(regexp_extract_all(html, '(?i)<img[^>]+>')) as t from f_page)""",
)
def x03(spark, d):
    tag = F.col("t")
    rows = fx.page(spark, d).select("page_id", F.explode(H.all_tags("html", "<img[^>]+>")).alias("t"))
    return rows.select("page_id", H.attribute(tag, "src").alias("src"), H.attribute(tag, "alt").alias("alt"))


@query(
    "x04_profile_link",
    f"""select page_id, list_filter(list_transform(regexp_extract_all(html, '(?i)<a[^>]+>'),
        lambda t: {attr_sql('href')}), lambda h: contains(lower(h), 'linkedin.com/company/'))[1] as profile
        from f_page""",
)
def x04(spark, d):
    return fx.page(spark, d).select("page_id", H.profile_link("html", "url").alias("profile"))


# every base here is scheme://host/path; references are absolute, //host, /path or path
def resolve_sql(ref: str, base: str = "url") -> str:
    return rf"""case when regexp_matches({ref}, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') then {ref}
        when {ref}[1:2] = '//' then regexp_extract({base}, '^([a-z]+:)', 1) || {ref}
        when {ref}[1:1] = '/' then regexp_extract({base}, '^([a-z]+://[^/?#]*)', 1) || {ref}
        else regexp_replace(regexp_extract({base}, '^([a-z]+://[^?#]*)', 1), '[^/]*$', '') || {ref} end"""


_ICONS = f"""select page_id, url, i, lower({attr_sql('rel')}) as rel, {attr_sql('href')} as href from (
    select page_id, url, unnest(l) as t, generate_subscripts(l, 1) as i from (
        select page_id, url, regexp_extract_all(html, '(?i)<link[^>]+>') as l from f_page))
    where contains(lower({attr_sql('rel')}), 'icon') and {attr_sql('href')} <> ''"""


@query(
    "x05_favicon",
    f"""select p.page_id, {resolve_sql('h')} as favicon from f_page p left join (
        select page_id, arg_min(href, (not contains(rel, 'apple-touch-icon'), i)) as h
        from ({_ICONS}) group by page_id) using (page_id)""",
)
def x05(spark, d):
    return fx.page(spark, d).select("page_id", H.favicon_link("html", "url").alias("favicon"))


_LOGOS = f"""select page_id, {resolve_sql('ref')} as logo, hint, k, i from (
    select page_id, url, {attr_sql('src')} as ref, 'img alt=''' || {attr_sql('alt')} || '''' as hint, 1 as k, i
    from (select page_id, url, unnest(l) as t, generate_subscripts(l, 1) as i from (
        select page_id, url, list_filter(regexp_extract_all(html, '(?i)<img[^>]+>'),
            lambda t: contains(lower(t), 'logo') and {attr_sql('src')} <> '')[1:5] as l from f_page))
    union all select page_id, url, href, rel, 2, i from ({_ICONS})
    union all select page_id, url, {attr_sql('content')}, 'og:image', 3, i from (
        select page_id, url, unnest(l) as t, generate_subscripts(l, 1) as i from (
            select page_id, url, regexp_extract_all(html, '(?i)<meta[^>]+og:image[^>]+>') as l from f_page))
    where {attr_sql('content')} <> '')"""


@query(
    "x06_logo_candidates",
    f"""select page_id, n - 1 as at, logo as url, hint from (
        select *, row_number() over (partition by page_id order by k, i) as n from (
            select *, row_number() over (partition by page_id, logo order by k, i) as copy from ({_LOGOS}))
        where copy = 1) where n <= 8""",
)
def x06(spark, d):
    rows = fx.page(spark, d).select(
        "page_id", F.posexplode(H.logo_candidates("html", "url")).alias("at", "c")
    )
    return rows.select("page_id", "at", "c.url", "c.hint")


@query(
    "t05_top_logos",
    f"""select page_id, logo as url from (
        select *, row_number() over (partition by page_id order by k, i) as n from ({_LOGOS})) where n <= 2""",
)
def t05(spark, d):
    rows = fx.page(spark, d).select(
        "page_id", F.explode(H.logo_candidates("html", "url", max_candidates=2)).alias("c")
    )
    return rows.select("page_id", "c.url")


_HREF = f"""select page_id, url, {attr_sql('href')} as ref from (
    select page_id, url, unnest(regexp_extract_all(html, '(?i)<a[^>]+>')) as t from f_page)
    where {attr_sql('href')} <> ''"""


@query("x07_resolved_links", f"select page_id, ref, {resolve_sql('ref')} as link from ({_HREF})")
def x07(spark, d):
    rows = fx.page(spark, d).select(
        "page_id", "url", F.explode(H.all_tags("html", "<a[^>]+>")).alias("t")
    ).select("page_id", "url", H.attribute(F.col("t"), "href").alias("ref")).filter("ref <> ''")
    return rows.select("page_id", "ref", resolve_url("url", "ref").alias("link"))


@query(
    "x08_file_extension",
    f"""select page_id, k, i, case when ext in ('svg', 'png', 'jpg', 'jpeg', 'webp', 'ico') then ext else 'png' end as ext
        from (select *, lower(regexp_extract(regexp_replace(regexp_replace(logo, '[?#].*$', ''),
            '^[^:/]*:?//[^/]*', ''), '\\.([^.]*)$', 1)) as ext from ({_LOGOS}))
        union all select page_id, 9, 1, case when e in ('svg', 'png', 'jpg', 'jpeg', 'webp', 'ico') then e else 'png' end
        from (select page_id, lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''),
            '^[^:/]*:?//[^/]*', ''), '\\.([^.]*)$', 1)) as e from f_page)""",
)
def x08(spark, d):
    page = fx.page(spark, d)
    logos = page.select("page_id", F.explode(H.logo_candidates("html", "url")).alias("c")).select(
        "page_id",
        F.when(F.col("c.hint").startswith("img"), 1).when(F.col("c.hint") == "og:image", 3).otherwise(2).alias("k"),
        file_extension("c.url").alias("ext"),
        F.col("c.url").alias("logo"),
    )
    ranks = page.select(
        "page_id", F.posexplode(H.all_tags("html", "<link[^>]+>")).alias("n", "t"), "url"
    ).select(
        "page_id", (F.col("n") + 1).alias("i"),
        resolve_url("url", H.attribute(F.col("t"), "href")).alias("logo"),
    )
    placed = logos.join(ranks, ["page_id", "logo"], "left").select(
        "page_id", "k", F.when(F.col("k") == 2, F.col("i")).otherwise(1).alias("i"), "ext"
    )
    own = page.select("page_id", F.lit(9).alias("k"), F.lit(1).alias("i"), file_extension("url").alias("ext"))
    return placed.unionByName(own)


@query("x09_noise_ratio", "select page_id, noise from f_lines")
def x09(spark, d):
    texts = fx.page(spark, d).select("page_id", H.page_text("html").alias("body"))
    return H.with_text_facts(texts, "body").select("page_id", "noise")


@query("x16_page_text", "select page_id, body from f_text")
def x16(spark, d):
    return fx.page(spark, d).select("page_id", H.page_text("html").alias("body"))


_PHRASE = """len(list_filter(['enable javascript', 'verify you are human', 'checking your browser',
    'captcha', 'access denied', 'are you a robot', 'unusual traffic'], lambda p: contains(lower(body), p))) > 0"""
_GATE = rf"""case when length(body) < 200 then 'too_short'
    when regexp_matches(body, '\{{\{{[^}}]+\}}\}}|\{{%[^%]+%\}}') then 'template_syntax'
    when {_PHRASE} then 'blocking_page' when noise > 0.85 then 'noise' else 'accepted' end"""


@query("x17_light_gate", f"select page_id, {_GATE} as gate from f_text join f_lines using (page_id)")
def x17(spark, d):
    return P.page_facts(fx.page(spark, d)).select("page_id", "gate")


@query(
    "x18_prefixed_text",
    """select page_id, case when page_id % 7 = 0 then ('LinkedIn: https://www.LinkedIn.com/company/c' || page_id
       || '/' || chr(10) || chr(10) || body)[1:30000] else body[1:30000] end as text from f_text""",
)
def x18(spark, d):
    return P.page_facts(fx.page(spark, d)).select("page_id", "text")


@query("x19_characterize", "select page_id, verdict, notes from f_found")
def x19(spark, d):
    return P.page_diagnoses(fx.page(spark, d)).select("page_id", "verdict", "notes")


@query(
    "t04_random_order",
    "select page_id, row_number() over (order by md5('3|' || url), page_id) as pos from f_page",
)
def t04(spark, d):
    sites = fx.page(spark, d).select("page_id", "url")
    return global_rank(sites, [seeded(3, "url"), F.col("page_id")]).select("page_id", "pos")


# the run's order, first page per unknown domain, and where the run stops
_RUN = """
    sites as (select page_id, url, domain, md5('3|' || url) as k from f_page join f_domain using (url)),
    firsts as (select *, row_number() over (order by k, page_id) as pos from (
        select *, row_number() over (partition by domain order by k, page_id) as c from sites
        where domain <> '' and domain not in (select clean_subject from f_checked
            where review_type = 'scraping_diagnostic' and error is null and verdict = 'scrape_exception')) where c = 1),
    found as (select f.pos, f.page_id, f.domain, f.k, x.verdict, x.notes from firsts f join f_found x using (page_id)),
    streaks as (select *, pos - max(case when fresh then pos end) over (order by pos) as streak from (
        select *, row_number() over (partition by verdict order by pos) = 1 as fresh from found)),
    cut as (select min(pos) as cut from streaks where streak >= 5)"""


def _known(spark, d):
    """Domains with a failed scrape on record."""
    return R.accepted_reviews(fx.review(spark, d), fx.taxonomy(spark, d)).filter(
        "review_type = 'scraping_diagnostic' and verdict = 'scrape_exception'"
    ).select("subject").distinct()


@query(
    "x20_diagnose",
    f"""with {_RUN.strip()} select 'scraping_diagnostic' as review_type, domain as subject, verdict, notes, pos
        from found, cut where pos <= coalesce(cut, pos)""",
)
def x20(spark, d):
    return P.diagnose(fx.page(spark, d), _known(spark, d), seed=3)[0]


@query(
    "a17_diagnose_summary",
    f"""with {_RUN.strip()}, done as (select * from found, cut where pos <= coalesce(cut, pos)),
        fin as (select max((k, page_id)) as e from done)
        select (select count(*) from done) as characterized,
            (select count(*) from sites, cut, fin where domain <> '' and (cut is null or (k, page_id) <= e))
                - (select count(*) from done) as skipped_known,
            (select count(*) from sites, cut, fin where domain = '' and (cut is null or (k, page_id) <= e)) as skipped_invalid,
            (select array_to_string(list_sort(list(distinct verdict)), '|') from done) as labels_seen,
            case when cut is null then 'sample_exhausted' else 'stability_reached' end as stop_reason
        from cut""",
)
def a17(spark, d):
    return P.diagnose(fx.page(spark, d), _known(spark, d), seed=3)[1]


_SEQ = """seq as (select subject as source, verdict, row_number() over (partition by subject
        order by date_diagnosed, id) as pos from f_accepted where review_type = 'scraping_diagnostic'),
    fresh as (select *, row_number() over (partition by source, verdict order by pos) = 1 as is_new from seq),
    streak as (select *, pos - max(case when is_new then pos end) over (partition by source order by pos) as s from fresh),
    cuts as (select source, min(pos) as cut from streak where s >= 5 group by source)"""


@query(
    "w03_stop_on_stability",
    f"""with {_SEQ} select source, cut, case when cut is null then 'sample_exhausted' else 'stability_reached' end
        as stop_reason from (select distinct source from seq) left join cuts using (source)""",
)
def w03(spark, d):
    from tagweave.dataflow import rank_within

    rows = R.accepted_reviews(fx.review(spark, d), fx.taxonomy(spark, d)).filter(
        "review_type = 'scraping_diagnostic'"
    ).select(F.col("subject").alias("source"), "verdict", "date_diagnosed", "id")
    ordered = rank_within(rows, ["source"], [F.col("date_diagnosed"), F.col("id")])
    return R.stability_cut(ordered, "verdict", 5, ("source",)).select("source", F.col("cut"), "stop_reason")


# ---- review log ---------------------------------------------------------------


@query("r01_checked_reviews", "select id, clean_subject, error from f_checked")
def r01(spark, d):
    return R.checked_reviews(fx.review(spark, d), fx.taxonomy(spark, d)).select("id", "clean_subject", "error")


@query("r01_rejected_reviews", "select id, error from f_checked where error is not null")
def r01_rejected(spark, d):
    return R.rejected_reviews(fx.review(spark, d), fx.taxonomy(spark, d)).select("id", "error")


@query(
    "s14_constraints",
    """select error, count(*) as n from (select id, case when trim(review_type) = '' then 'blank review_type'
       when trim(subject) = '' then 'blank subject'
       when snap is not null and (try_cast(snap as json) is null or json_type(try_cast(snap as json)) <> 'OBJECT')
           then 'snapshot is no object' end as error
       from (select id, case when id % 7 = 0 then ' ' else review_type end as review_type,
                case when id % 11 = 0 then '' else subject end as subject,
                case when id % 5 = 0 then '[1]' when id % 5 = 1 then 'oops' when id % 5 = 2 then null
                    else source_snapshot end as snap from f_review)) group by error""",
)
def s14(spark, d):
    i = F.col("id")
    spoiled = fx.review(spark, d).withColumns(
        {
            "review_type": F.when(i % 7 == 0, " ").otherwise(F.col("review_type")),
            "subject": F.when(i % 11 == 0, "").otherwise(F.col("subject")),
            "source_snapshot": F.when(i % 5 == 0, "[1]")
            .when(i % 5 == 1, "oops")
            .when(i % 5 == 2, F.lit(None))
            .otherwise(F.col("source_snapshot")),
        }
    )
    checked = R.constraint_split(spoiled)
    return checked.groupBy(F.col("violation").alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s09_append_reviews",
    """select row_number() over (order by clean_subject, id) as seq, review_type, clean_subject as subject, verdict,
       null::varchar as resolution from f_checked where error is null""",
)
def s09(spark, d):
    from tagweave.sources.writers import append, review_rows

    path = fresh_path(spark, "reviews")
    good = R.accepted_reviews(fx.review(spark, d), fx.taxonomy(spark, d)).withColumnRenamed("id", "event")
    append(review_rows(good, 0, ("subject", "event")), path)
    return spark.read.schema(REVIEW).parquet(path).select(
        F.col("id").alias("seq"), "review_type", "subject", "verdict", "resolution"
    )


_REQUESTS = """select 'all ' || review_type as request_id, review_type, null as subject
    from (select distinct review_type from f_review)
    union all select 'one ' || review_type || ' ' || subject, review_type, subject
    from (select distinct review_type, subject from f_review)"""


@query(
    "r02_query_reviews",
    f"""select request_id, count(*) as n from (
        select q.request_id, a.id from ({_REQUESTS}) q join f_accepted a on a.review_type = q.review_type
            where q.subject is null
        union all select q.request_id, a.id from ({_REQUESTS}) q left join f_domain u on u.url = q.subject
            join f_accepted a on a.review_type = q.review_type and a.subject =
                case when q.review_type = 'scraping_diagnostic' then u.domain else trim(q.subject) end
        where q.subject is not null) group by request_id""",
)
def r02(spark, d):
    reviews, taxonomy = fx.review(spark, d), fx.taxonomy(spark, d)
    kinds = reviews.select("review_type").distinct().select(
        F.concat(F.lit("all "), "review_type").alias("request_id"),
        "review_type", F.lit(None).cast("string").alias("subject"),
    )
    ones = reviews.select("review_type", "subject").distinct().select(
        F.concat(F.lit("one "), "review_type", F.lit(" "), "subject").alias("request_id"),
        "review_type", "subject",
    )
    # answered twice, by type and by subject, but cleaned once
    stored = durable(R.accepted_reviews(reviews, taxonomy).select("id", "review_type", "subject"), "stored")
    # a question asked by many requests is answered once
    questions, asked = R.distinct_questions(kinds.unionByName(ones), taxonomy)
    answers = R.query_reviews(stored, questions, taxonomy)
    counts = answers.groupBy(F.col("request_id").alias("question")).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counts, "question").groupBy("request_id").agg(F.sum("n").alias("n"))


_LATEST = """select subject, arg_max(id, (date_diagnosed, -id)) as id, arg_max(verdict, (date_diagnosed, -id)) as verdict
    from f_accepted where review_type = 'KIND' group by subject"""


@query("w01_latest_review", _LATEST.replace("KIND", "scraping_diagnostic"))
def w01(spark, d):
    rows = R.accepted_reviews(fx.review(spark, d), fx.taxonomy(spark, d)).filter(
        "review_type = 'scraping_diagnostic'"
    )
    return R.latest_per_subject(rows).select("subject", "id", "verdict")


@query(
    "w02_recency",
    """select subject, id, row_number() over (order by date_diagnosed desc, id) <= 3 as recent from (
       select subject, arg_max(id, (date_diagnosed, -id)) as id, max(date_diagnosed) as date_diagnosed
       from f_accepted where review_type = 'taxonomy_split' group by subject)""",
)
def w02(spark, d):
    rows = R.accepted_reviews(fx.review(spark, d), fx.taxonomy(spark, d)).filter(
        "review_type = 'taxonomy_split'"
    )
    return R.with_recency(R.latest_per_subject(rows)).select("subject", "id", "recent")


_QUEUE = "('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8', 'Brand#9', 'Brand#10', 'Brand#11')"
_READY = f"""diag as (select subject, verdict, row_number() over (order by newest desc, id) as r from (
        select subject, arg_max(verdict, (date_diagnosed, -id)) as verdict, max(date_diagnosed) as newest,
            arg_max(id, (date_diagnosed, -id)) as id
        from f_accepted where review_type = 'taxonomy_split' and subject in {_QUEUE} group by subject)),
    ready as (select (select count(*) from diag) as diagnosed, (select coalesce(list_sort(list(distinct verdict)), [])
        from diag where r <= 3 and verdict not in (select verdict from diag where r > 3)) as new_types)"""


@query(
    "a15_queue_count",
    f"with {_READY} select diagnosed, diagnosed >= 9 as count_ready from ready",
)
def a15(spark, d):
    return r05(spark, d).select("diagnosed", "count_ready")


@query(
    "a16_stability",
    f"""with {_READY} select array_to_string(new_types, '|') as new_types,
        diagnosed >= 3 and len(new_types) = 0 as stability_ready from ready""",
)
def a16(spark, d):
    return r05(spark, d).select("new_types", "stability_ready")


@query(
    "r05_readiness",
    f"""with {_READY} select diagnosed, diagnosed >= 9 as count_ready, array_to_string(new_types, '|') as new_types,
        diagnosed >= 3 and len(new_types) = 0 as stability_ready,
        diagnosed >= 9 and diagnosed >= 3 and len(new_types) = 0 as ready,
        concat_ws('; ', case when diagnosed < 9 then 'only ' || diagnosed || '/9 minimum diagnosed' end,
            case when len(new_types) > 0
                then 'new fracture type(s) in the last 3: ' || array_to_string(new_types, ', ')
            when diagnosed < 3 then 'fewer than 3 diagnosed subsectors so far' end) as reasons from ready""",
)
def r05(spark, d):
    rows = R.accepted_reviews(fx.review(spark, d), fx.taxonomy(spark, d))
    return R.readiness(rows, fx.QUEUE)


_COVERED = f"""select distinct s.tag as subsector, c.id, c.name, u.domain, l.verdict, l.verdict <> 'ok' as problem
    from f_company c join f_domain u on u.url = c.website
    join ({_LATEST.replace('KIND', 'scraping_diagnostic')}) l on l.subject = u.domain
    join (select distinct id, tag from f_sub) s on s.id = c.id"""


@query("j12_guardrail", _COVERED)
def j12(spark, d):
    rows = R.accepted_reviews(fx.review(spark, d), fx.taxonomy(spark, d))
    return R.guardrail(fx.company(spark, d), rows)


@query(
    "r04_guardrail_outcome",
    f"""select t.subsector, coalesce(n, 0) as covered, coalesce(p, 0) as problems,
        case when coalesce(n, 0) = 0 then 'not_diagnosed' when p = 0 then 'no_problem' else 'problems' end as outcome
        from (select distinct subsector from f_taxonomy) t left join (
            select subsector, count(*) as n, count(*) filter (problem) as p from ({_COVERED}) group by subsector)
        using (subsector)""",
)
def r04(spark, d):
    rows = R.accepted_reviews(fx.review(spark, d), fx.taxonomy(spark, d))
    covered = R.guardrail(fx.company(spark, d), rows)
    return R.guardrail_outcome(covered, fx.taxonomy(spark, d).select("subsector"))


@query(
    "f01_short_labels",
    """select page_id, case when length(url) > 20 then url[1:18] || '…' else url end as label from pages""",
)
def f01(spark, d):
    return fx.table(spark, d, "pages").select("page_id", short_label("url").alias("label"))
