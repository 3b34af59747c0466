"""Query registration and the SQL form of the derived tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Arrays of text as one text, which compares alike everywhere."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType) and isinstance(
            field.dataType.elementType, T.StringType
        ):
            out.append(F.array_join(field.name, "|").alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` may use the f_* tables below."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return register


# The derived tables, in dependency order.
TABLES = {
    "f_qty": """
        select o_custkey as id, p_type, p_brand, p_size, sum(l_quantity) as q
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
        group by all""",
    "f_types": """
        select id, list(p_type order by q desc, p_type) as r
        from (select id, p_type, sum(q) as q from f_qty group by all) group by id""",
    "f_brands": """
        select id, list(p_brand order by q desc, p_brand) as r
        from (select id, p_brand, sum(q) as q from f_qty group by all) group by id""",
    "f_sizes": """
        select id, list(s order by q desc, s) as r
        from (select id, 'S' || (p_size % 5) as s, sum(q) as q from f_qty group by all) group by id""",
    "f_company": """
        select c_custkey as id, c_name as name, n_name as country, d.text as description,
            case when c_custkey % 5 <> 0 then p.url end as website,
            coalesce(t.r, []::varchar[])[1:(1 + c_custkey % 2)] as sectors,
            list_concat(
                case when c_custkey % 17 = 0 then []::varchar[]
                     else coalesce(b.r, []::varchar[])[1:(1 + c_custkey % 4)] end,
                case when c_custkey % 11 = 0 then ['Uncategorized'] else []::varchar[] end
            ) as subsectors,
            case when c_custkey % 3 = 0 then []::varchar[]
                 else coalesce(s.r, []::varchar[])[1:2] end as sub_subsectors,
            null::varchar as linkedin_url, null::varchar as flaticon_url,
            null::varchar as logo_url, 'v2' as taxonomy_version
        from customer left join nation on c_nationkey = n_nationkey
        left join documents d on d.doc_id = c_custkey
        left join pages p on p.page_id = c_custkey % (select count(*) from pages)
        left join f_types t on t.id = c_custkey
        left join f_brands b on b.id = c_custkey
        left join f_sizes s on s.id = c_custkey""",
    "f_blanked": """
        select * replace (case when id % 101 = 0 then []::varchar[] else sectors end as sectors)
        from f_company""",
    "f_taxonomy": """
        select sector, subsector, sub_subsector, subsector || ' of ' || sector as definition
        from (
            select sector, subsector,
                unnest(case when subsector in ('Brand#10', 'Brand#11', 'Brand#12')
                    then ['S0', 'S1', 'S2', 'S3', 'S4'] else [null] end) as sub_subsector
            from (select p_type as sector, p_brand as subsector from part
                  where p_brand not in ('Brand#24', 'Brand#25')
                  union select p_type, 'Uncategorized' from part))""",
    "f_sub": """
        select id, name, sectors, subsectors, sub_subsectors, unnest(subsectors) as tag
        from f_company""",
    "f_overlap": """
        select distinct a.id as id_a, a.name as company_a, b.id as id_b, b.name as company_b,
            a.sectors as sectors_a, a.subsectors as subsectors_a, a.sub_subsectors as subs_a,
            b.sectors as sectors_b, b.subsectors as subsectors_b, b.sub_subsectors as subs_b
        from f_sub a join f_sub b on a.tag = b.tag and a.name <> b.name
        where list_has_any(a.sectors, b.sectors)""",
    "f_candidates": """
        select *, len(list_intersect(list_concat(sectors_a, subsectors_a),
                                     list_concat(sectors_b, subsectors_b)))::double
            / len(list_distinct(list_concat(list_concat(sectors_a, subsectors_a),
                                            list_concat(sectors_b, subsectors_b)))) as score
        from f_overlap
        where len(subs_a) = 0 or len(subs_b) = 0 or list_has_any(subs_a, subs_b)""",
    "f_base": """
        select id_a as a_id, id_b as b_id, company_a, company_b,
                len(list_intersect(list_concat(sectors_a, subsectors_a),
                                   list_concat(sectors_b, subsectors_b)))::double
                / len(list_distinct(list_concat(list_concat(sectors_a, subsectors_a),
                                                list_concat(sectors_b, subsectors_b)))) as score
            from f_overlap where id_a < id_b""",
    "f_edge": """
        select a_id * 1000000 + b_id as id, company_a, company_b, score,
            (a_id + b_id) % 10 <> 0 as active, (a_id + b_id) % 3 = 0 as checked,
            null::boolean as validated
        from f_base""",
    "f_known": """
        select a_id * 1000000 + b_id as id, company_a, company_b, score,
            (a_id + b_id) % 10 <> 0 as active, (a_id + b_id) % 3 = 0 as checked,
            null::boolean as validated
        from f_base where score >= 0.6 and (a_id * 31 + b_id * 17) % 5 = 0""",
    "f_once": """
        select a_id, b_id, score,
            case when b_id % 7 = 0 then company_b else company_a end as company_a,
            case when b_id % 7 = 0 then company_a else company_b end as company_b
        from f_base where score >= 0.6""",
    "f_messy": """
        select a_id * 1000000 + b_id as id, company_a,
            case when b_id % 97 = 0 then 'Ghost#' || b_id else company_b end as company_b,
            score, (a_id + b_id) % 10 <> 0 as active, (a_id + b_id) % 3 = 0 as checked,
            null::boolean as validated
        from (select a_id, b_id, score, company_a, company_b from f_once
              union all
              select a_id + 1000000000, b_id, score / 2, company_b, company_a
              from f_once where b_id % 13 = 0)""",
    "f_graph": """
        select u, v, arg_max(coalesce(score, 0), id) as weight,
            greatest(1e-6, 1 - arg_max(coalesce(score, 0), id)) as distance
        from (select least(company_a, company_b) as u, greatest(company_a, company_b) as v, score, id
              from f_messy
              where active and company_a in (select name from f_company)
                and company_b in (select name from f_company))
        where u <> v group by u, v""",
    "f_links": """
        select company_a as company, company_b as other from f_messy
        union all select company_b, company_a from f_messy""",
    "f_domain": r"""
        select url, rtrim(regexp_replace(lower(
            case when host like '%[%' then regexp_extract(host, '\[([^\]]*)', 1)
                 else regexp_extract(host, '^([^:]*)', 1) end), '^www\.', ''), '.') as domain
        from (select url, regexp_replace(regexp_extract(regexp_replace(
                url, '^([a-zA-Z][a-zA-Z0-9+.\-]*:)?//', ''), '^([^/?#]*)', 1), '^.*@', '') as host
              from (select distinct url from pages))""",
    "f_review": """
        select event_id as id,
            case event_type when 'signup' then 'taxonomy_split' when 'error' then 'scraping_diagnostic'
                when 'click' then 'redundant_uncategorized_cleanup'
                when 'view' then 'empty_subsectors_backfill' else 'not_a_real_type' end as review_type,
            case event_type when 'signup' then 'Brand#' || (user_id % 25 + 1) when 'error' then url
                else 'Customer#' || lpad(user_id::varchar, 9, '0') end as subject,
            case event_type
                when 'signup' then ['isolated mis-tag', 'structural gap', 'scraping artifact',
                    'ambiguous', ' '][floor(value)::bigint % 5 + 1]
                when 'error' then ['ok', 'blocking_page', 'incomplete_content',
                    'content_drowned_in_noise', 'scrape_exception'][floor(value)::bigint % 5 + 1]
                else 'fixed' end as verdict,
            ts as date_diagnosed, props as source_snapshot
        from events left join pages on page_id = user_id % (select count(*) from pages)""",
    "f_checked": """
        select *, case when error is null then clean end as clean_subject from (
            select r.*, c.clean, case
                when review_type not in ('taxonomy_split', 'scraping_diagnostic',
                    'redundant_uncategorized_cleanup', 'empty_subsectors_backfill')
                    then 'unknown review_type'
                when trim(verdict) = '' then 'blank verdict'
                when review_type = 'taxonomy_split'
                    and subject not in (select subsector from f_taxonomy) then 'unknown subsector'
                when review_type = 'taxonomy_split' and verdict not in ('isolated mis-tag',
                    'structural gap', 'scraping artifact', 'ambiguous') then 'unknown verdict'
                when review_type = 'scraping_diagnostic' and clean = '' then 'no domain'
                when review_type <> 'taxonomy_split' and clean = '' then 'blank subject' end as error
            from f_review r join (
                select id, case when review_type = 'scraping_diagnostic' then domain
                    else trim(subject) end as clean
                from f_review left join f_domain on subject = url) c using (id))""",
    "f_accepted": """
        select id, review_type, clean_subject as subject, verdict, date_diagnosed, source_snapshot
        from f_checked where error is null""",
    "f_prediction": """
        with sec as (
            select id, p_type as label, pos from (
                select id, p_type, row_number() over (partition by id order by q desc, p_type) as pos
                from (select id, p_type, sum(q) as q from f_qty group by all)) where pos <= 3),
        brand as (
            select id, p_type as sector, p_brand as brand, pos from (
                select id, p_type, p_brand,
                    row_number() over (partition by id, p_type order by q desc, p_brand) as pos
                from (select id, p_type, p_brand, sum(q) as q from f_qty group by all)) x
            where pos <= 3 and exists (select 1 from sec where sec.id = x.id and sec.label = x.p_type)),
        deep as (
            select id, p_type as sector, p_brand as subsector, s as label, pos from (
                select id, p_type, p_brand, s,
                    row_number() over (partition by id, p_type, p_brand order by q desc, s) as pos
                from (select id, p_type, p_brand, 'S' || (p_size % 5) as s, sum(q) as q
                      from f_qty group by all)) x
            where pos <= 3 and p_brand in ('Brand#10', 'Brand#11', 'Brand#12')
                and exists (select 1 from brand b where b.id = x.id and b.sector = x.p_type
                            and b.brand = x.p_brand))
        select id, 'sector' as level, null::varchar as sector, null::varchar as subsector, label, pos,
            (id * 7 % 50 + 50)::double / 100 as confidence from sec
        union all
        select id, 'subsector', sector, null,
            case when id % 19 = 0 and pos = 3 then 'Invented' else brand end, pos,
            ((id * 13 + pos * 17 + length(sector)) % 30 + 70)::double / 100 from brand
        union all
        select id, 'sub_subsector', sector, subsector, label, pos,
            ((id * 13 + pos * 17 + length(sector)) % 30 + 70)::double / 100 from deep""",
    "f_raw": """
        select company_a,
            case when b_id % 41 = 0 then 'Nobody#' || b_id else company_b end as name,
            case when b_id % 29 = 0 then 'n/a' when b_id % 31 = 0 then null
                 when b_id % 37 = 0 then '1.7' else score::varchar end as score
        from f_base""",
    "f_page": """
        select page_id, url,
            case when page_id % 3 = 0 then '<link rel="icon" href="/f' || page_id || '.ico">' else '' end
            || case when page_id % 6 = 0 then '<link rel="apple-touch-icon" href="https://cdn.example.com/t'
                || page_id || '.png">' else '' end
            || case when page_id % 4 = 0 then '<img alt="Acme logo" data-src="lazy.png" src="img/logo'
                || page_id || '.svg">' else '' end
            || case when page_id % 5 = 0 then '<meta property="og:image" content="//img.example.com/og'
                || page_id || '.jpg">' else '' end
            || case when page_id % 7 = 0 then '<a class="x" href="https://www.LinkedIn.com/company/c'
                || page_id || '/">follow</a>' else '' end
            || case when page_id % 13 = 0 then '<p>Please enable JavaScript</p>' else '' end
            || case when page_id % 17 = 0 then '<p>{{ company.name }}</p>' else '' end
            || html as html
        from pages""",
    "f_text": r"""
        select page_id, url, html, regexp_replace(regexp_replace(
            replace(replace(replace(replace(replace(replace(
                regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                    regexp_replace(html,
                        '(?is)<script\b.*?</script\s*>', chr(10), 'g'),
                        '(?is)<style\b.*?</style\s*>', chr(10), 'g'),
                        '(?is)<nav\b.*?</nav\s*>', chr(10), 'g'),
                        '(?is)<footer\b.*?</footer\s*>', chr(10), 'g'),
                        '(?s)<!--.*?-->', chr(10), 'g'),
                        '<[^>]*>', chr(10), 'g'),
                '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
            '[ \t]*[\r\n]+[\s\x{0b}]*', chr(10), 'g'),
            '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') as body
        from f_page""",
    "f_lines": r"""
        select page_id, len(ls) as n_lines, len(list_filter(ls, lambda s: length(s) < 40)) as n_short,
            case when len(ls) = 0 then 0.0::double
                 else len(list_filter(ls, lambda s: length(s) < 40))::double / len(ls) end as noise
        from (select page_id, list_filter(list_transform(
                regexp_split_to_array(body, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]'),
                lambda s: regexp_replace(s,
                    '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g')),
                lambda s: s <> '') as ls
              from f_text)""",
    "f_found": """
        select page_id, url, case
            when phrase is not null then 'blocking_page'
            when length(body) < 500 then 'incomplete_content'
            when noise > 0.85 then 'content_drowned_in_noise' else 'ok' end as verdict,
          case
            when phrase is not null
                then 'matched trigger phrase: ''' || phrase || ''' (length=' || length(body) || ')'
            when length(body) < 500 then 'markdown length=' || length(body) || ' < 500'
            when noise > 0.85 then 'noise_ratio=' || printf('%.2f', noise) || ' over ' || n_lines
                || ' lines (length=' || length(body) || ')'
            else 'length=' || length(body) end as notes
        from (select *, list_filter(['enable javascript', 'verify you are human',
                'checking your browser', 'captcha', 'access denied', 'are you a robot',
                'unusual traffic'], lambda p: contains(lower(body), p))[1] as phrase from f_text)
        join f_lines using (page_id)""",
    "f_group": """
        select name, sectors[1] || '/' || subsectors[1] as label from f_company
        where len(sectors) > 0 and len(subsectors) > 0""",
    "f_ranked": """
        select label, row_number() over (order by size desc, first_member) - 1 as community_id, size
        from (select label, count(*) as size, min(name) as first_member from f_group group by label)
        where size >= 3""",
    "f_members": "select name, community_id from f_group join f_ranked using (label)",
}

_NAME = re.compile(r"\bf_[a-z_]+\b")


def with_tables(sql: str) -> str:
    """Prefix a statement with the derived tables it uses."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in TABLES and name not in needed:
                needed.add(name)
                visit(TABLES[name])

    visit(sql)
    parts = [f"{n} as materialized ({TABLES[n].strip()})" for n in TABLES if n in needed]
    if not parts:
        return sql.strip()
    own = sql.strip()
    # the statement's own named parts follow the tables
    glue = ",\n" + own[len("with ") :] if own.startswith("with ") else "\n" + own
    if glue.startswith(",\nrecursive "):
        return "with recursive " + ",\n".join(parts) + glue.replace("recursive ", "", 1)
    return "with " + ",\n".join(parts) + glue
