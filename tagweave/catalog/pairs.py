"""Scans, predicates, candidate pairs and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave import fixtures as fx
from tagweave.catalog.registry import query
from tagweave.dataflow import fresh_path
from tagweave.functions.tags import has_tag, is_empty, overlap, tags
from tagweave.functions.text import reply_items
from tagweave.operators import edges as E
from tagweave.operators import overlap as O
from tagweave.operators import scoring as S
from tagweave.operators.cosine import similar_texts
from tagweave.operators.similarity import similar_pairs
from tagweave.operators.substring import build_index, first_matches, search_many
from tagweave.plans import match as M
from tagweave.schemas import COMPANY, EDGE
from tagweave.sources import parts
from tagweave.sources import readers as R


# ---- scans --------------------------------------------------------------------


@query("s01_company_scan", "select id, name, sectors[1] as first_sector, website from f_company")
def s01(spark, d):
    path = fresh_path(spark, "companies")
    fx.company(spark, d).write.parquet(path)
    rows = R.read_companies(spark, path, ["id", "name", "sectors", "website"])
    return rows.select("id", "name", F.get("sectors", F.lit(0)).alias("first_sector"), "website")


def _stored_edges(spark, d):
    """The edge table as files of two versions: weak ones from before ``active``."""
    path = fresh_path(spark, "edges")
    edges = fx.edge(spark, d)
    weak = F.col("active") & (F.col("score") < 0.5) & ~F.col("checked") & F.col("validated").isNull()
    edges.filter(weak).select("id", "company_a", "company_b", "score").write.parquet(path)
    edges.filter(~weak).write.mode("append").parquet(path)
    return path


@query("s02_active_edges", "select id, company_a, company_b, score from f_edge where active")
def s02(spark, d):
    rows = R.read_edges(spark, _stored_edges(spark, d), active_only=True)
    return rows.select("id", "company_a", "company_b", "score")


@query("s03_all_edges", "select id, company_a, company_b, score, active from f_edge")
def s03(spark, d):
    rows = R.read_edges(spark, _stored_edges(spark, d))
    return rows.select("id", "company_a", "company_b", "score", "active")


@query(
    "s04_ordered_slice",
    """select id, name from (select id, name, row_number() over (order by name, id) as p from f_company)
       where p > (select count(*) // 10 from f_company) and p <= (select count(*) // 2 from f_company)""",
)
def s04(spark, d):
    companies = fx.company(spark, d).select("id", "name")
    n = companies.count()
    return R.ordered_slice(companies, "name", n // 10, n // 2)


@query(
    "s05_key_list",
    "select distinct website from f_company where coalesce(website, '') <> '' and list_contains(sectors, 'PROMO')",
)
def s05(spark, d):
    path = fresh_path(spark, "keys")
    listed = _listed(spark, d).select(F.concat(F.lit("  "), "website", F.lit(" ")).alias("value"))
    listed.unionByName(listed.select(F.lit("   ").alias("value"))).write.text(path)
    return R.key_list(spark, path)


def _listed(spark, d):
    return (
        fx.company(spark, d)
        .filter(has_tag("sectors", "PROMO") & (F.coalesce("website", F.lit("")) != ""))
        .select("website")
        .distinct()
    )


def _processed(spark, d):
    """Names a former, interrupted sweep has dealt with: one country's companies."""
    return fx.company(spark, d).filter(F.col("country") == "NATION_3").select("name")


@query(
    "s06_resume",
    "select name from f_company where name not in (select name from f_company where country = 'NATION_3')",
)
def s06(spark, d):
    from tagweave.sources.writers import append, read_or_empty

    path = fresh_path(spark, "processed")
    names = _processed(spark, d)
    append(names, path)
    return R.unprocessed(fx.company(spark, d), read_or_empty(spark, path, names)).select("name")


@query(
    "s13_schema_evolution",
    """select id, company_a, company_b, score, true as active, false as checked, null::boolean as validated
       from f_edge where score >= 0.6 union all select * from f_edge where score < 0.6""",
)
def s13(spark, d):
    edges = fx.edge(spark, d)
    path = fresh_path(spark, "edges")
    old = edges.filter("score >= 0.6").select("id", "company_a", "company_b", "score")
    old.write.parquet(path)
    edges.filter("score < 0.6").write.mode("append").parquet(path)
    return R.read_edges(spark, path)


# ---- predicates and projections -----------------------------------------------


@query(
    "p01_lookup",
    "select c.id, c.name, website from f_company c join (select distinct company_b from f_known) on c.name = company_b",
)
def p01(spark, d):
    wanted = fx.known_edge(spark, d).select(F.col("company_b").alias("name")).distinct()
    return fx.company(spark, d).join(wanted, "name", "left_semi").select("id", "name", "website")


@query(
    "p02_in_list",
    """select id, name from f_company where website in
       (select website from f_company where list_contains(sectors, 'PROMO') and website <> '')""",
)
def p02(spark, d):
    return fx.company(spark, d).join(_listed(spark, d), "website", "left_semi").select("id", "name")


@query("p03_array_contains", "select id, name from f_company where list_contains(subsectors, 'Brand#13')")
def p03(spark, d):
    return fx.company(spark, d).filter(has_tag("subsectors", "Brand#13")).select("id", "name")


@query(
    "p04_array_overlap",
    """select id, name from f_company where list_has_any(sectors, ['PROMO', 'SMALL'])
       and list_has_any(subsectors, ['Brand#13', 'Brand#7'])
       and (len(sub_subsectors) = 0 or list_has_any(sub_subsectors, ['S1']))
       and name <> 'Customer#000000001'""",
)
def p04(spark, d):
    probe = {
        "name": "Customer#000000001",
        "sectors": ["PROMO", "SMALL"],
        "subsectors": ["Brand#13", "Brand#7"],
        "sub_subsectors": ["S1"],
    }
    return O.overlap_filter(fx.company(spark, d), probe).select("id", "name")


def search(companies, text: str, limit: int = 10):
    """Companies whose name or website contains the text, by name."""
    text = text.strip()
    if len(text) < 2:
        return companies.limit(0)
    safe = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.col("name").ilike(safe) | F.coalesce(F.col("website").ilike(safe), F.lit(False))
    return companies.filter(hit).orderBy("name").limit(limit)


@query(
    "p05_search",
    """select name, website, sectors[1] as sector from f_company
       where name ilike '%BLOG%' or website ilike '%BLOG%' order by name limit 10""",
)
def p05(spark, d):
    return search(fx.company(spark, d), " BLOG ").select(
        "name", "website", F.get("sectors", F.lit(0)).alias("sector")
    )


_ASKED = """(select right(s_name, 4) as query from supplier union select substr(url, 9, 5) from pages
    union select upper(substr(url, 13, 2)) from pages)"""


@query(
    "p05_search_many",
    f"""with q as (select distinct lower(trim(query)) as query from {_ASKED})
       select query, id, name, website, rank from (
         select query, id, name, website, row_number() over (partition by query order by name, id) as rank
         from q join f_company on contains(lower(name), query) or contains(lower(coalesce(website, '')), query)
         where length(query) >= 2) where rank <= 10""",
)
def p05_many(spark, d):
    """The first companies of each of many searches, from one index."""
    pages = fx.table(spark, d, "pages")
    asked = (
        fx.table(spark, d, "supplier").select(F.expr("right(s_name, 4)").alias("query"))
        .unionByName(pages.select(F.substring("url", 9, 5).alias("query")))
        .unionByName(pages.select(F.upper(F.substring("url", 13, 2)).alias("query")))
    )
    rows = fx.company(spark, d).select("id", "name", "website")
    index = fresh_path(spark, "runs")
    build_index(rows, ["name", "website"], index)
    return first_matches(search_many(index, rows, asked, ["name", "website"]))


@query("p06_empty_array", "select id, name from f_company where len(subsectors) = 0")
def p06(spark, d):
    return fx.company(spark, d).filter(is_empty("subsectors")).select("id", "name")


@query(
    "p07_array_size",
    "select id, len(subsectors) > 1 as several, len(subsectors) > 3 as many from f_company",
)
def p07(spark, d):
    n = F.size(tags("subsectors"))
    return fx.company(spark, d).select("id", (n > 1).alias("several"), (n > 3).alias("many"))


@query(
    "p08_unchecked_edges",
    "select id, company_a, company_b from f_edge where not checked and active order by id limit 100",
)
def p08(spark, d):
    return E.unchecked(fx.edge(spark, d)).orderBy("id").limit(100).select("id", "company_a", "company_b")


@query("p09_threshold", "select id, score from f_messy where coalesce(score, 0) >= 0.85")
def p09(spark, d):
    return fx.messy_edge(spark, d).filter(E.reaches("score")).select("id", "score")


@query(
    "p10_canonical_order",
    """select least(company_a, company_b) as company_a, greatest(company_a, company_b) as company_b, id
       from f_messy where company_a <> company_b""",
)
def p10(spark, d):
    return E.unordered(fx.messy_edge(spark, d)).filter("company_a <> company_b").select(
        F.col("u").alias("company_a"), F.col("v").alias("company_b"), "id"
    )


@query("p11_has_website", "select id, website from f_company where website is not null and website <> ''")
def p11(spark, d):
    return fx.company(spark, d).filter("website is not null and website <> ''").select("id", "website")


@query(
    "p12_default_fill",
    """select name, array_to_string(sectors, '|') as sectors, '' as flaticon_url, '' as logo_url,
       coalesce(description, '') as description, coalesce(website, '') as website, '' as linkedin_url
       from f_blanked""",
)
def p12(spark, d):
    return E.graph_nodes(fx.blanked_company(spark, d))


@query("p13_drop_transient", "select id, sector, label, pos from f_prediction where level = 'subsector'")
def p13(spark, d):
    from tagweave.operators.taxonomy import without_transient

    rows = fx.prediction(spark, d).filter("level = 'subsector'").withColumn("_raw", F.lit(1))
    return without_transient(rows.drop("level", "subsector"))


@query(
    "p14_payload",
    """select company_a, (p - 1) // 20 as chunk, count(*) as n, min(company_b) as first_b, max(company_b) as last_b
       from (select company_a, company_b, row_number() over (partition by company_a order by company_b) as p
             from f_candidates) group by all""",
)
def p14(spark, d):
    chunks = S.chunked(O.overlap_candidates(fx.company(spark, d), listed=True))
    payloads = S.chunk_payloads(chunks, fx.company(spark, d))
    slim = T.StructType([T.StructField("name", T.StringType())])
    request = T.StructType(
        [T.StructField("new_company", slim), T.StructField("candidates", T.ArrayType(slim))]
    )
    parsed = payloads.withColumn("r", F.from_json("payload", request))
    return parsed.select(
        F.col("r.new_company.name").alias("company_a"),
        "chunk",
        F.size("r.candidates").cast("long").alias("n"),
        F.get("r.candidates.name", F.lit(0)).alias("first_b"),
        F.element_at("r.candidates.name", -1).alias("last_b"),
    )


# ---- joins --------------------------------------------------------------------


@query("j01_overlap_candidates", "select id_a, company_a, id_b, company_b from f_candidates")
def j01(spark, d):
    return O.overlap_candidates(fx.company(spark, d))


@query(
    "j02_sweep_candidates",
    """select id_a, company_a, id_b, company_b from f_candidates where company_a < company_b
       and (company_a, company_b) not in (select (company_a, company_b) from f_known)
       and (company_b, company_a) not in (select (company_a, company_b) from f_known)""",
)
def j02(spark, d):
    return O.sweep_candidates(fx.company(spark, d), fx.known_edge(spark, d))


@query(
    "j03_targeted_candidates",
    """select id_a, company_a, id_b, company_b from f_candidates where id_a in (select id from f_company
       where website in (select website from f_company where list_contains(sectors, 'PROMO') and website <> ''))""",
)
def j03(spark, d):
    return O.targeted_candidates(fx.company(spark, d), _listed(spark, d))


@query("j04_neighbours", "select company, other from f_links")
def j04(spark, d):
    return E.neighbours(fx.messy_edge(spark, d))


@query(
    "j05_pair_exists",
    """select a_id, b_id from f_base where (company_a, company_b) in (select (company_a, company_b) from f_messy)""",
)
def j05(spark, d):
    return E.existing_pairs(fx.edge_base(spark, d), fx.messy_edge(spark, d)).select("a_id", "b_id")


@query(
    "j06_save_undirected",
    """select company_a, company_b, max(score) as score from f_base b where score >= 0.5
       and not exists (select 1 from f_links l where l.company = b.company_a and l.other = b.company_b)
       group by all""",
)
def j06(spark, d):
    scored = fx.edge_base(spark, d).select("company_a", "company_b", "score")
    return E.to_save(scored, fx.messy_edge(spark, d), 0.5)


@query(
    "j07_save_directed",
    """select company_a, company_b, max(score) as score from f_base b where score >= 0.5
       and not exists (select 1 from f_messy m where m.company_a = b.company_a and m.company_b = b.company_b)
       group by all""",
)
def j07(spark, d):
    scored = fx.edge_base(spark, d).select("company_a", "company_b", "score")
    return E.to_save_directed(scored, fx.messy_edge(spark, d), 0.5)


@query(
    "j08_two_hop",
    """with l as (select distinct company, other from f_links)
       select distinct a.id as id_a, a.name as company_a, x.id as id_b, x.name as company_b
       from l p join l q on p.other = q.company and p.company <> q.other
       join f_company a on a.name = p.company join f_company x on x.name = q.other
       where not exists (select 1 from l k where k.company = a.name and k.other = x.name)
       and list_has_any(a.sectors, x.sectors) and list_has_any(a.subsectors, x.subsectors)
       and (len(a.sub_subsectors) = 0 or list_has_any(a.sub_subsectors, x.sub_subsectors))""",
)
def j08(spark, d):
    return O.two_hop_candidates(fx.company(spark, d), fx.messy_edge(spark, d))


@query(
    "j09_drop_dangling",
    """select id, company_a, company_b from f_messy where company_a in (select name from f_company)
       and company_b in (select name from f_company)""",
)
def j09(spark, d):
    return E.without_dangling(fx.messy_edge(spark, d), fx.company(spark, d)).select(
        "id", "company_a", "company_b"
    )


_EGO = """select centre, source, target, score from (
    select centre, company_a as source, company_b as target, score,
        row_number() over (partition by centre, other order by incoming, id) as rn
    from (select id, company_a as centre, company_b as other, company_a, company_b, score, false as incoming
          from f_messy where active
          union all select id, company_b, company_a, company_a, company_b, score, true
          from f_messy where active)) where rn = 1"""


@query("j10_ego_links", _EGO)
def j10(spark, d):
    return E.ego_links(fx.messy_edge(spark, d))


@query(
    "j10_ego_nodes",
    f"""with e as ({_EGO}),
    n as (select centre, case when source = centre then target else source end as name from e
          union select centre, centre from e)
    select centre, n.name, array_to_string(coalesce(sectors, []), '|') as sectors,
        array_to_string(coalesce(subsectors, []), '|') as subsectors, coalesce(website, '') as website,
        n.name = centre as is_centre
    from n left join f_company c on c.name = n.name""",
)
def j10_nodes(spark, d):
    return E.ego_nodes(fx.messy_edge(spark, d), fx.company(spark, d)).select(
        "centre", "name", "sectors", "subsectors", "website", "is_centre"
    )


@query(
    "j11_pair_facts",
    """select m.id, a.name as name_a, array_to_string(a.sectors, '|') as sectors_a, b.name as name_b,
       array_to_string(b.subsectors, '|') as subsectors_b from f_messy m
       left join f_company a on a.name = m.company_a left join f_company b on b.name = m.company_b""",
)
def j11(spark, d):
    joined = E.with_company_facts(
        fx.messy_edge(spark, d).select("id", "company_a", "company_b"), fx.company(spark, d)
    )
    return joined.select(
        "id",
        F.col("facts_a.name").alias("name_a"),
        F.col("facts_a.sectors").alias("sectors_a"),
        F.col("facts_b.name").alias("name_b"),
        F.col("facts_b.subsectors").alias("subsectors_b"),
    )


_BATCH = """select page_id as pos, case when page_id % 25 < 6 then 'Chain ' || ((page_id + 1) // 2)
        when page_id % 3 = 0 then 'Newcomer ' || (page_id // 2)
        else 'Customer#' || lpad((page_id % (select count(*) from customer))::varchar, 9, '0') end as name,
    case when page_id % 25 < 6 then 'https://chain.example.org/' || (page_id // 2)
        when page_id % 4 = 0 then 'https://new.example.org/' || (page_id // 3) else url end as website,
    'from page ' || page_id as description from pages"""


def upsert_batch(spark, d):
    """Arrivals: known and new names, known and new websites, with repeats, renames, and
    chains whose rows share a name or a website in turn."""
    n = fx.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))
    i = F.col("page_id")
    text = lambda c: c.cast("string")
    known = F.concat(F.lit("Customer#"), F.lpad(text(i % F.col("n")), 9, "0"))
    return fx.table(spark, d, "pages").crossJoin(F.broadcast(n)).select(
        i.alias("pos"),
        F.when(i % 25 < 6, F.concat(F.lit("Chain "), text(F.floor((i + 1) / 2))))
        .when(i % 3 == 0, F.concat(F.lit("Newcomer "), text(F.floor(i / 2))))
        .otherwise(known)
        .alias("name"),
        F.when(i % 25 < 6, F.concat(F.lit("https://chain.example.org/"), text(F.floor(i / 2))))
        .when(i % 4 == 0, F.concat(F.lit("https://new.example.org/"), text(F.floor(i / 3))))
        .otherwise(F.col("url"))
        .alias("website"),
        F.concat(F.lit("from page "), text(i)).alias("description"),
    )


_MATCHED = f"""select pos, b.name, b.website, b.description, coalesce(s.id, n.id) as match_id from ({_BATCH}) b
    left join (select website, min(id) as id from f_company where website <> '' group by website) s
        on s.website = b.website
    left join (select name, min(id) as id from f_company group by name) n on n.name = b.name"""


@query("j14_upsert_match", f"select pos, name, match_id from ({_MATCHED})")
def j14(spark, d):
    from tagweave.sources.writers import upsert_matches

    return upsert_matches(fx.company(spark, d), upsert_batch(spark, d)).select("pos", "name", "match_id")


# one row after the other, each against the companies as the rows before it left them
_REPLAY = f"""batch as (select *, row_number() over (order by pos) as k from ({_BATCH})),
    replay as (
      select 0::bigint as k, null::bigint as hit, null::varchar as action,
        (select list({{'id': id, 'name': name, 'site': website}} order by id) from f_company) as s
      union all
      select k, coalesce(found, fresh), case when found is null then 'saved' else 'updated' end,
        case when found is null then list_append(s, {{'id': fresh, 'name': name, 'site': website}})
          else list_transform(s, lambda x: case when x.id = found
            then {{'id': found, 'name': name, 'site': website}} else x end) end
      from (select b.k, b.name, b.website, r.s, list_max([x.id for x in r.s]) + 1 as fresh,
              coalesce(list_min([x.id for x in r.s if x.site = b.website and b.website <> '']),
                       list_min([x.id for x in r.s if x.name = b.name])) as found
            from replay r join batch b on b.k = r.k + 1)),
    applied as (select b.*, r.hit, r.action from batch b join replay r using (k))"""


_UPSERTED = f"""with recursive {_REPLAY},
    last as (select hit as id, arg_max(name, pos) as name, arg_max(website, pos) as website,
                arg_max(description, pos) as description from applied group by hit)
    select id, coalesce(l.name, c.name) as name, coalesce(l.website, c.website) as website,
        coalesce(l.description, c.description) as description, country,
        array_to_string(sectors, '|') as sectors, coalesce(taxonomy_version, 'v2') as taxonomy_version
    from f_company c full join last l using (id)"""


@query("s11_upsert", _UPSERTED)
def s11(spark, d):
    from tagweave.sources.writers import upsert_companies

    table, _ = upsert_companies(fx.company(spark, d), upsert_batch(spark, d))
    return table.select(
        "id", "name", "website", "description", "country", "sectors", "taxonomy_version"
    )


def _rows_per_part(df) -> int:
    """Ranges of ids for a table of some 64 folders."""
    return df.agg(F.max("id")).first()[0] // 64 + 1


@query("s11_upsert_parts", _UPSERTED)
def s11_parts(spark, d):
    """The upsert into a table in folders by id, of which the touched ones are rewritten."""
    path, stored = fresh_path(spark, "company-parts"), fx.company(spark, d)
    rows = _rows_per_part(stored)
    parts.write_parts(stored, path, rows)
    parts.upsert_parts(spark, path, upsert_batch(spark, d), rows)
    return parts.read_parts(spark, path, COMPANY).select(
        "id", "name", "website", "description", "country", "sectors", "taxonomy_version"
    )


@query(
    "s11_upsert_actions",
    f"with recursive {_REPLAY} select pos, name, action from applied",
)
def s11_actions(spark, d):
    from tagweave.sources.writers import upsert_companies

    actions = upsert_companies(fx.company(spark, d), upsert_batch(spark, d))[1]
    return actions.select("pos", "name", "action")


@query(
    "s12_update_by_key",
    """select e.id, case when k.id is not null then false else e.active end as active
       from f_edge e left join f_known k on k.id = e.id""",
)
def s12(spark, d):
    from tagweave.sources.writers import update_by_key

    changes = fx.known_edge(spark, d).select("id", F.lit(False).alias("active"))
    return update_by_key(fx.edge(spark, d), changes, ["id"], ["active"]).select("id", "active")


@query(
    "s12_update_parts",
    """select e.id, case when k.id is not null then false else e.active end as active
       from f_edge e left join (select id from f_known where id % 3 = 0) k on k.id = e.id""",
)
def s12_parts(spark, d):
    """A third of the known edges set inactive in a table in folders by id."""
    path, stored = fresh_path(spark, "edge-parts"), fx.edge(spark, d)
    rows = _rows_per_part(stored)
    parts.write_parts(stored, path, rows)
    changes = fx.known_edge(spark, d).filter("id % 3 = 0").select("id", F.lit(False).alias("active"))
    parts.update_parts(spark, path, changes, ["active"], EDGE, rows)
    return parts.read_parts(spark, path, EDGE).select("id", "active")


def _verdicts(spark, d):
    """Validator replies for known edges: a competitor if the score is high."""
    return fx.known_edge(spark, d).select(
        "company_a", "company_b", (F.col("score") >= 0.7).alias("is_competitor")
    )


@query(
    "j17_validation_merge",
    """select e.id, case when k.id is not null then true else e.checked end as checked,
       case when k.id is not null then k.score >= 0.7 end as validated
       from f_edge e left join f_known k on k.id = e.id""",
)
def j17(spark, d):
    return E.with_verdicts(fx.edge(spark, d), _verdicts(spark, d)).select("id", "checked", "validated")


@query(
    "j18_logo_guard",
    """select page_id, case when page_id % 4 = 0 then null else 'https://img.example.com/og' || page_id || '.jpg' end as logo
       from pages where page_id % 5 = 0 or page_id % 4 = 0
       union all select page_id, 'https://img.example.com/og' || page_id || '.jpg' from pages
       where page_id % 5 <> 0 and page_id % 4 <> 0""",
)
def j18(spark, d):
    from tagweave.operators.taxonomy import guarded_logo

    # previews only, as the icon and image links of a page may not be its choice
    n = F.col("page_id")
    preview = F.concat(F.lit("https://img.example.com/og"), n.cast("string"), F.lit(".jpg"))
    listed = F.array(F.struct(preview.alias("url")))
    other = F.array(F.struct(F.concat(preview, F.lit("?x")).alias("url")))
    none = F.array().cast("array<struct<url:string>>")
    cands = F.when(n % 4 == 0, other).when(n % 5 == 0, listed).otherwise(none)
    return fx.page(spark, d).select("page_id", guarded_logo(preview, cands).alias("logo"))


# ---- scoring ------------------------------------------------------------------


@query(
    "w04_chunks",
    """select company_a, company_b, p as pos, (p - 1) // 20 as chunk from (
       select company_a, company_b, row_number() over (partition by company_a order by company_b) as p
       from f_candidates)""",
)
def w04(spark, d):
    return S.chunked(O.overlap_candidates(fx.company(spark, d), listed=True))


_ACCEPTED = """select r.company_a, r.name as company_b,
    least(greatest(try_cast(r.score as double), 0), 1) as score
    from f_raw r join f_base b on b.company_a = r.company_a and b.company_b = r.name
    where try_cast(r.score as double) is not null"""


@query("x10_accepted_scores", _ACCEPTED)
def x10(spark, d):
    chunks = S.chunked(fx.edge_base(spark, d).select("company_a", "company_b"))
    return S.accepted_scores(fx.raw_score(spark, d), chunks).select("company_a", "company_b", "score")


@query(
    "w05_ranked_scores",
    f"""select company_a, company_b, score, row_number() over
       (partition by company_a order by score desc, company_b) as rank from ({_ACCEPTED})""",
)
def w05(spark, d):
    return S.ranked_scores(x10(spark, d), "company_b")


@query(
    "x11_json_reply",
    """select company_a, name,
       case when score is null and length(name) % 2 = 0 then '0' else score end as score from f_raw""",
)
def x11(spark, d):
    item = T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("score", T.StringType())]
    )
    rows = fx.raw_score(spark, d)
    # a bare list without the scores that are null, and a wrapped one with them
    one = F.array(F.struct("name", "score"))
    kept = F.to_json(one, {"ignoreNullFields": "false"})
    wrapped = F.concat(F.lit('{"note": "done", "results": '), kept, F.lit("}"))
    reply = F.when(F.length("name") % 2 == 0, F.to_json(one)).otherwise(wrapped)
    items = reply_items(reply, item, {"score": "0"})
    parsed = rows.select("company_a", F.explode(items).alias("i"))
    return parsed.select("company_a", "i.name", "i.score")


@query(
    "w06_first_per_pair",
    """select u, v, arg_min(score, id) as score, min(id) as id from (
       select *, least(company_a, company_b) as u, greatest(company_a, company_b) as v from f_messy)
       group by u, v""",
)
def w06(spark, d):
    return E.unordered(E.first_per_pair(fx.messy_edge(spark, d), "id")).select("u", "v", "score", "id")


@query(
    "x13_jaccard",
    """select company_a, company_b, score, case when score >= 0.9 then 'substitute'
       when score >= 0.75 then 'overlap' else 'none' end as band
       from f_candidates where company_a < company_b""",
)
def x13(spark, d):
    pairs = O.overlap_candidates(fx.company(spark, d), keep_tags=True, ordered=True)
    return S.jaccard_scorer(pairs).select(
        "company_a", "company_b", "score", S.score_band("score").alias("band")
    )


@query(
    "x13_jaccard_threshold",
    "select company_a, company_b, score from f_candidates where company_a < company_b and score >= 0.5",
)
def x13_threshold(spark, d):
    return similar_pairs(fx.company(spark, d), 0.5).select("company_a", "company_b", "score")


@query(
    "x13_cosine",
    """with v as (select vec_id as id, list_transform(embedding, lambda e: e::double) as e from embeddings)
       select company_a, company_b, round(list_dot_product(a.e, b.e)
           / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) as score
       from f_candidates join v a on a.id = id_a join v b on b.id = id_b where company_a < company_b""",
)
def x13_cosine(spark, d):
    # companies without a vector have no score, so they need not meet
    vectors = fx.vectors(spark, d)
    known = fx.company(spark, d).join(vectors.select("id"), "id", "left_semi")
    scored = S.cosine_scorer(vectors)(O.overlap_candidates(known, ordered=True))
    return scored.filter("score is not null").select(
        "company_a", "company_b", F.round("score", 6).alias("score")
    )


_UNIT_TERMS = r"""with words as (select id, unnest(regexp_split_to_array(lower(description), '[^\p{L}]+')) as term
                       from f_company where description is not null),
       tf as (select id, term, count(*) as tf from words where term <> '' group by all),
       df as (select term, count(*) as df from tf group by all),
       w as (select id, term, tf * ln(((select count(*) from f_company where description is not null) + 1.0::double)
                / (df + 1.0::double)) as w from tf join df using (term)),
       n as (select id, sqrt(sum(w * w)) as n from w where w > 0 group by id),
       u as (select id, term, w / n as w from w join n using (id) where w > 0)"""


@query(
    "x13_tfidf",
    rf"""{_UNIT_TERMS},
       dots as (select id_a, id_b, sum(x.w * y.w) as s from f_candidates join u x on x.id = id_a
                join u y on y.id = id_b and y.term = x.term where company_a < company_b group by id_a, id_b)
       select company_a, company_b, round(coalesce(s, 0), 6) as score
       from f_candidates left join dots using (id_a, id_b) where company_a < company_b""",
)
def x13_tfidf(spark, d):
    pairs = O.overlap_candidates(fx.company(spark, d), ordered=True)
    scored = S.tfidf_scorer(fx.company(spark, d).select("id", "description"))(pairs)
    return scored.select("company_a", "company_b", F.round("score", 6).alias("score"))


@query(
    "x13_tfidf_threshold",
    rf"""{_UNIT_TERMS}
       select x.id as id_a, y.id as id_b, round(sum(x.w * y.w), 6) as score
       from u x join u y on y.term = x.term and x.id < y.id group by x.id, y.id
       having sum(x.w * y.w) >= 0.75 - 1e-9""",
)
def x13_tfidf_threshold(spark, d):
    found = similar_texts(fx.company(spark, d).select("id", "description"), 0.75)
    return found.select("id_a", "id_b", F.round("score", 6).alias("score"))


@query(
    "x12_custom_scorer",
    """select company_a, company_b, len(list_intersect(sectors_a, sectors_b))::double
       / len(list_distinct(list_concat(sectors_a, sectors_b))) as score from f_candidates
       where company_a < company_b""",
)
def x12(spark, d):
    """A scorer is any function from pairs to pairs with a score."""
    pairs = O.overlap_candidates(fx.company(spark, d), keep_tags=True, ordered=True)
    common = F.size(F.array_intersect("sectors_a", "sectors_b"))
    either = F.size(F.array_union("sectors_a", "sectors_b"))
    return pairs.select("company_a", "company_b", (common / either).alias("score"))


# ---- composed jobs ------------------------------------------------------------

_FRESH = """select company_a, company_b, score from f_candidates c where company_a < company_b
    and not exists (select 1 from f_known k where k.company_a = c.company_a and k.company_b = c.company_b)
    and not exists (select 1 from f_known k where k.company_b = c.company_a and k.company_a = c.company_b)"""


def flagship_sql(threshold: float, k: int) -> str:
    return f"""select company_a, company_b, score, rank from (
        select company_a, company_b, score,
            row_number() over (partition by company_a order by score desc, company_b) as rank
        from ({_FRESH}) where score >= {threshold}) where rank <= {k}"""


@query("flagship_top_competitors", flagship_sql(0.5, 5))
def flagship(spark, d):
    top = M.flagship(fx.company(spark, d), fx.known_edge(spark, d), 0.5, 5)
    return top.select("company_a", "company_b", "score", "rank")


@query(
    "x15_sweep",
    f"""select company_a, company_b, max(score) as score from ({_FRESH}) where score >= 0.6
       and company_a not in (select name from f_company where country = 'NATION_3') group by all""",
)
def x15(spark, d):
    return M.sweep(
        fx.company(spark, d), fx.known_edge(spark, d), _processed(spark, d), threshold=0.6
    ).saved


@query(
    "x15_sweep_scorer",
    f"""select company_a, company_b, max(score) as score from ({_FRESH}) where score >= 0.6
       and company_a not in (select name from f_company where country = 'NATION_3') group by all""",
)
def x15_scorer(spark, d):
    return M.sweep(
        fx.company(spark, d), fx.known_edge(spark, d), _processed(spark, d), S.jaccard_scorer, 0.6
    ).saved


@query(
    "a08_work_estimate",
    f"""select sum(n)::bigint as pairs, sum(ceil(n / 20.0))::bigint as calls from (
       select company_a, count(*) as n from ({_FRESH})
       where company_a not in (select name from f_company where country = 'NATION_3') group by company_a)""",
)
def a08(spark, d):
    return M.sweep_estimate(fx.company(spark, d), fx.known_edge(spark, d), _processed(spark, d))


_LISTED = """select name from f_company where website in
    (select website from f_company where list_contains(sectors, 'PROMO') and website <> '')"""
_TARGETED = f"""select c.company_a, c.company_b, max(score) as score from f_candidates c where score >= 0.6
    and company_a in ({_LISTED})
    and (company_a < company_b or company_b not in ({_LISTED}))
    and not exists (select 1 from f_known k where k.company_a = c.company_a and k.company_b = c.company_b)
    and not exists (select 1 from f_known k where k.company_b = c.company_a and k.company_a = c.company_b)
    group by all"""


@query("x21_targeted_backfill", _TARGETED)
def x21(spark, d):
    return M.targeted_backfill(
        fx.company(spark, d), fx.known_edge(spark, d), _listed(spark, d), threshold=0.6
    )


@query(
    "a23_targeted_status",
    f"""select l.name, coalesce(n, 0) as candidates, coalesce(s, 0) as saved from ({_LISTED}) l
       left join (select company_a, count(*) as n from f_candidates group by company_a) c on c.company_a = l.name
       left join (select company_a, count(*) as s from ({_TARGETED}) group by company_a) t on t.company_a = l.name""",
)
def a23(spark, d):
    return M.targeted_status(fx.company(spark, d), _listed(spark, d), x21(spark, d))


@query("x21_targeted_backfill_scorer", _TARGETED)
def x21_scorer(spark, d):
    return M.targeted_backfill(
        fx.company(spark, d), fx.known_edge(spark, d), _listed(spark, d), S.jaccard_scorer, 0.6
    )


# newly entered companies: those of one country
_NEW = "select name from f_company where country = 'NATION_3'"
_DIRECT = f"""select c.company_a, c.company_b, max(score) as score from f_candidates c where score >= 0.6
    and company_a in ({_NEW}) and (company_a < company_b or company_b not in ({_NEW}))
    and not exists (select 1 from f_known k where k.company_a = c.company_a and k.company_b = c.company_b)
    and not exists (select 1 from f_known k where k.company_b = c.company_a and k.company_a = c.company_b)
    group by all"""
_X14 = f"""with direct as ({_DIRECT}),
    stored as (select company_a, company_b from f_known union all select company_a, company_b from direct),
    sym as (select distinct company_a as x, company_b as y from stored
            union select company_b, company_a from stored),
    hop as (select distinct d.company_a, s.y as company_b from direct d join sym s on s.x = d.company_b
            where s.y <> d.company_a
            and not exists (select 1 from sym k where k.x = d.company_a and k.y = s.y)),
    scored as (select h.company_a, h.company_b,
            len(list_intersect(list_concat(a.sectors, a.subsectors), list_concat(b.sectors, b.subsectors)))::double
            / len(list_distinct(list_concat(list_concat(a.sectors, a.subsectors),
                                            list_concat(b.sectors, b.subsectors)))) as score
        from hop h join f_company a on a.name = h.company_a join f_company b on b.name = h.company_b
        where list_has_any(a.sectors, b.sectors) and list_has_any(a.subsectors, b.subsectors)
        and (len(a.sub_subsectors) = 0 or list_has_any(a.sub_subsectors, b.sub_subsectors))),
    further as (select * from scored s where score >= 0.5 and (company_a < company_b or not exists
        (select 1 from scored t where t.company_a = s.company_b and t.company_b = s.company_a)))
    select company_a, company_b, score, 'direct' as via from direct
    union all select company_a, company_b, score, 'transitive' from further"""


def _new_and_links(spark, d):
    companies = fx.company(spark, d)
    return companies.filter(F.col("country") == "NATION_3"), companies, fx.known_edge(spark, d)


@query("x14_match_new", _X14.replace("score >= 0.5", "score >= 0.6"))
def x14(spark, d):
    return M.match_new(*_new_and_links(spark, d), threshold=0.6)


@query(
    "a24_saved_per_company",
    f"select company_a, count(*) as saved from ({_X14.replace('score >= 0.5', 'score >= 0.6')}) group by company_a",
)
def a24(spark, d):
    return M.saved_per_company(x14(spark, d))


@query(
    "t03_validation_sample",
    """select id, company_a, company_b from (select * from f_edge where not checked and active order by id limit 100)
       order by md5('7|' || id), id limit 5""",
)
def t03(spark, d):
    return E.validation_sample(fx.edge(spark, d), seed=7).select("id", "company_a", "company_b")


@query(
    "x22_validation_round",
    """with s as (select * from (select * from f_edge where not checked and active order by id limit 100)
                  order by md5('7|' || id), id limit 5)
       select company_a, company_b, s.score, array_to_string(a.sectors, '|') as sectors_a,
           array_to_string(b.sectors, '|') as sectors_b
       from s left join f_company a on a.name = company_a left join f_company b on b.name = company_b""",
)
def x22(spark, d):
    rows = M.validation_round(fx.company(spark, d), fx.edge(spark, d), seed=7)
    return rows.select(
        "company_a", "company_b", "score",
        F.col("facts_a.sectors").alias("sectors_a"), F.col("facts_b.sectors").alias("sectors_b"),
    )


@query(
    "x22_validation_counts",
    """select count(*) filter (score >= 0.7) as validated, count(*) filter (score < 0.7) as invalidated,
       (select count(*) from f_edge where active and not checked and id not in (select id from f_known)) as remaining
       from f_known""",
)
def x22_counts(spark, d):
    return M.apply_validation(fx.edge(spark, d), _verdicts(spark, d))[1]


@query("a13_remaining", "select count(*) as remaining from f_edge where active and not checked")
def a13(spark, d):
    return E.unchecked(fx.edge(spark, d)).agg(F.count(F.lit(1)).alias("remaining"))


@query(
    "a14_verdict_counts",
    "select count(*) filter (score >= 0.7) as validated, count(*) filter (score < 0.7) as invalidated from f_known",
)
def a14(spark, d):
    return E.verdict_counts(_verdicts(spark, d))


@query(
    "a07_recalibrate",
    "select id, active and score >= 0.6 as active from f_edge",
)
def a07(spark, d):
    return E.recalibrated(fx.edge(spark, d), 0.6).select("id", "active")


@query(
    "a07_recalibration_counts",
    """select count(*) as total, count(*) filter (score < 0.6 and active) as newly_inactive,
       count(*) filter (score < 0.6 and not active) as already_inactive,
       count(*) filter (score >= 0.6) as still_active, 0.6::double as threshold_used from f_edge""",
)
def a07_counts(spark, d):
    return E.recalibration_counts(fx.edge(spark, d), 0.6)


@query(
    "s10_append_edges",
    """select (select max(id) from f_edge) + row_number() over (order by company_a, company_b) as id,
       company_a, company_b, score, true as active, false as checked from (
       select company_a, company_b, max(score) as score from f_base b where score >= 0.5
       and not exists (select 1 from f_links l where l.company = b.company_a and l.other = b.company_b)
       group by all)""",
)
def s10(spark, d):
    from tagweave.sources.writers import append, edge_rows

    path = fresh_path(spark, "edges")
    top = fx.edge(spark, d).agg(F.max("id")).first()[0]
    append(edge_rows(j06(spark, d), top), path)
    return R.read_edges(spark, path).select(
        "id", "company_a", "company_b", "score", "active", "checked"
    )


@query("u02_array_sets", """select id, list_has_any(sectors, ['PROMO']) as has_promo,
    len(list_filter(subsectors, lambda s: not list_contains(['Brand#1', 'Brand#2'], s))) as others,
    len(list_filter(sectors, lambda s: not list_contains(['MEDIUM', 'LARGE'], s))) = 0 as all_exempt
    from f_company""")
def u02(spark, d):
    from tagweave.functions.tags import is_subset, literals

    return fx.company(spark, d).select(
        "id",
        overlap("sectors", literals(["PROMO"])).alias("has_promo"),
        F.size(F.array_except("subsectors", literals(["Brand#1", "Brand#2"]))).cast("long").alias("others"),
        is_subset("sectors", literals(["MEDIUM", "LARGE"])).alias("all_exempt"),
    )
