"""Tag distributions, audits, classification rules and clean-up jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave import fixtures as fx
from tagweave.catalog.registry import query
from tagweave.dataflow import fresh_path
from tagweave.functions.tags import (
    default_uncategorized,
    demote_generic,
    drop_horizontal,
    drop_redundant_uncategorized,
    has_vertical,
    unique_tags,
)
from tagweave.operators import audit as A
from tagweave.operators import taxonomy as X

_HORIZONTAL = "['Brand#1', 'Brand#2', 'Brand#3', 'Brand#4']"
_AUDITED = "['Brand#1', 'Brand#2', 'Brand#9']"
_RULES = {"audited": fx.AUDITED, "horizontal": fx.RULES.horizontal}


def _vertical(col: str) -> str:
    return (
        f"len(list_filter({col}, lambda s: not list_contains({_HORIZONTAL}, s)"
        " and s <> 'Uncategorized')) > 0"
    )


def c04_sql(subs: str, sectors: str = "sectors") -> str:
    return f"""case when (len({sectors}) > 0
        and len(list_filter({sectors}, lambda s: not list_contains(['MEDIUM', 'LARGE'], s))) = 0)
        or not ({_vertical(subs)}) then {subs}
        else list_filter({subs}, lambda s: not list_contains({_HORIZONTAL}, s)) end"""


def c05_sql(subs: str) -> str:
    return f"""case when list_has_any({subs}, ['Brand#6', 'Brand#7', 'Brand#8'])
        then list_filter({subs}, lambda s: s <> 'Brand#5') else {subs} end"""


def c06_sql(subs: str) -> str:
    return f"""case when len({subs}) > 1 then list_filter({subs}, lambda s: s <> 'Uncategorized')
        else {subs} end"""


# ---- distributions and audit --------------------------------------------------


@query(
    "a01_sector_distribution",
    "select tag, count(*) as n from (select unnest(sectors) as tag from f_company) group by tag",
)
def a01(spark, d):
    return A.tag_distribution(fx.company(spark, d), "sectors")


@query(
    "a02_subsector_distribution",
    "select tag, count(*) as n from (select unnest(subsectors) as tag from f_company) group by tag",
)
def a02(spark, d):
    return A.tag_distribution(fx.company(spark, d), "subsectors")


@query(
    "a03_singletons",
    """select tag from (select unnest(sectors || subsectors || [country || '/' || description[1:3]]) as tag from f_company)
       where tag is not null group by tag having count(*) = 1""",
)
def a03(spark, d):
    # opening letters per country, as every brand here has many companies
    start = F.concat("country", F.lit("/"), F.substring("description", 1, 3))
    tagged = fx.company(spark, d).select(
        F.filter(F.concat("sectors", "subsectors", F.array(start)), lambda t: t.isNotNull()).alias("all")
    )
    return A.singleton_tags(tagged, "all")


_FLAGS = f"""select c.id, len(subsectors) = 0 and len(sectors) > 0 as empty_subsectors,
    len(sectors) = 0 as empty_sectors, list_contains(subsectors, 'Uncategorized') as uncategorized,
    len(subsectors) > 3 as over_tagged,
    list_has_any(subsectors, {_AUDITED}) and {_vertical('subsectors')} as conflict,
    len(list_filter(subsectors, lambda s: s in ('Brand#24', 'Brand#25'))) > 0 as drift,
    len(sectors) > 0 and len(subsectors) > 0 as classified
    from f_blanked c"""


@query("p15_anomaly_flags", f"select * exclude (classified) from ({_FLAGS})")
def p15(spark, d):
    flagged = A.anomaly_flags(fx.blanked_company(spark, d), fx.taxonomy(spark, d), **_RULES)
    return flagged.select("id", *A.FLAGS)


_ANY = "(empty_subsectors or empty_sectors or uncategorized or over_tagged or conflict or drift)"


@query(
    "a04_audit_summary",
    f"""select count(*) as total, count(*) filter (classified) as classified,
       round_even(100.0::double * count(*) filter (classified) / count(*), 1) as pct_classified,
       count(*) filter {_ANY} as with_anomalies,
       round_even(100.0::double * count(*) filter {_ANY} / count(*), 1) as pct_anomalies from ({_FLAGS})""",
)
def a04(spark, d):
    return A.audit_summary(
        A.anomaly_flags(fx.blanked_company(spark, d), fx.taxonomy(spark, d), **_RULES)
    )


@query(
    "a05_anomaly_lists",
    f"""select flag, c.name, array_to_string(sectors, '|') as sectors, array_to_string(subsectors, '|') as subsectors
        from (select id, 'empty_subsectors' as flag from ({_FLAGS}) where empty_subsectors
              union all select id, 'empty_sectors' from ({_FLAGS}) where empty_sectors
              union all select id, 'uncategorized' from ({_FLAGS}) where uncategorized
              union all select id, 'over_tagged' from ({_FLAGS}) where over_tagged) f
        join f_blanked c using (id)""",
)
def a05(spark, d):
    flagged = A.anomaly_flags(fx.blanked_company(spark, d), fx.taxonomy(spark, d), **_RULES)
    out = None
    for flag in A.FLAGS[:4]:
        part = A.anomaly_list(flagged, flag, "name", "sectors", "subsectors").withColumn(
            "flag", F.lit(flag)
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "a06_horizontal_conflicts",
    f"""select id, name, array_to_string(list_sort(list_filter(subsectors,
        lambda s: list_contains({_AUDITED}, s))), '|') as horizontal_tags from f_company
        where list_has_any(subsectors, {_AUDITED}) and {_vertical('subsectors')}""",
)
def a06(spark, d):
    return A.horizontal_conflicts(fx.company(spark, d), **_RULES).select("id", "name", "horizontal_tags")


@query(
    "j15_taxonomy_drift",
    """select id, name, array_to_string(list_filter(subsectors,
       lambda s: s <> 'Uncategorized' and s in ('Brand#24', 'Brand#25')), '|') as unknown_subsectors
       from f_company where list_has_any(subsectors, ['Brand#24', 'Brand#25'])""",
)
def j15(spark, d):
    return A.taxonomy_drift(fx.company(spark, d), fx.taxonomy(spark, d))


@query("u01_anomalous_ids", f"select id from ({_FLAGS}) where {_ANY}")
def u01(spark, d):
    return A.anomalous_ids(
        A.anomaly_flags(fx.blanked_company(spark, d), fx.taxonomy(spark, d), **_RULES)
    )


@query(
    "u03_ordered_dedupe",
    """select id, array_to_string(list_filter(l, lambda s, i: list_position(l, s) = i), '|') as tags
       from (select id, list_concat(list_concat(subsectors, sectors), list_reverse(subsectors)) as l from f_company)""",
)
def u03(spark, d):
    doubled = F.concat("subsectors", "sectors", F.reverse("subsectors"))
    return fx.company(spark, d).select("id", unique_tags(doubled).alias("tags"))


@query(
    "a20_quantified",
    f"""select id, bool_and(confidence < 0.9) as all_low, bool_or(
        not list_contains({_HORIZONTAL}, label) and label <> 'Uncategorized') as any_vertical
        from f_prediction where level = 'subsector' group by id""",
)
def a20(spark, d):
    subs = fx.prediction(spark, d).filter("level = 'subsector'")
    return subs.groupBy("id").agg(
        F.bool_and(F.col("confidence") < 0.9).alias("all_low"),
        F.bool_or(has_vertical(F.array("label"), fx.RULES.horizontal)).alias("any_vertical"),
    )


@query(
    "s07_audit_report",
    f"""select section, count(*) as n from (
        select 'summary' as section
        union all select 'sector_distribution' from (select distinct unnest(sectors) from f_blanked)
        union all select 'subsector_distribution' from (select distinct unnest(subsectors) from f_blanked)
        union all select 'singletons' from (select tag from (select unnest(subsectors) as tag from f_blanked)
            group by tag having count(*) = 1)
        union all select 'empty_subsectors_with_sectors' from ({_FLAGS}) where empty_subsectors
        union all select 'empty_sectors' from ({_FLAGS}) where empty_sectors
        union all select 'uncategorized' from ({_FLAGS}) where uncategorized
        union all select 'over_tagged' from ({_FLAGS}) where over_tagged
        union all select 'horizontal_conflicts' from ({_FLAGS}) where conflict
        union all select 'taxonomy_drift' from ({_FLAGS}) where drift) group by section""",
)
def s07(spark, d):
    from tagweave.sources.readers import read_report
    from tagweave.sources.writers import write_report

    path = fresh_path(spark, "audit")
    rows = A.report_document(fx.blanked_company(spark, d), fx.taxonomy(spark, d), **_RULES)
    write_report(rows, path)
    return read_report(spark, path, rows.schema).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


# ---- tag rules ----------------------------------------------------------------


@query(
    "c04_drop_horizontal",
    f"select id, array_to_string({c04_sql('subsectors')}, '|') as subsectors from f_company",
)
def c04(spark, d):
    kept = drop_horizontal("subsectors", "sectors", fx.RULES.horizontal, fx.RULES.exempt_sectors)
    return fx.company(spark, d).select("id", kept.alias("subsectors"))


@query(
    "c05_demote_generic",
    f"select id, array_to_string({c05_sql('subsectors')}, '|') as subsectors from f_company",
)
def c05(spark, d):
    kept = demote_generic("subsectors", fx.RULES.generic, fx.RULES.redirects)
    return fx.company(spark, d).select("id", kept.alias("subsectors"))


@query(
    "c06_drop_redundant",
    f"select id, array_to_string({c06_sql('subsectors')}, '|') as subsectors from f_company",
)
def c06(spark, d):
    return fx.company(spark, d).select(
        "id", drop_redundant_uncategorized("subsectors").alias("subsectors")
    )


@query(
    "c10_default_uncategorized",
    """select id, case when len(subsectors) = 0 then 'Uncategorized'
       else array_to_string(subsectors, '|') end as subsectors from f_company""",
)
def c10(spark, d):
    return fx.company(spark, d).select("id", default_uncategorized("subsectors").alias("subsectors"))


# ---- classification -----------------------------------------------------------

_C01 = """select i.id, coalesce(conf, 0) as confidence,
    case when labels is null or coalesce(conf, 0) < 0.7 then ['Uncategorized'] else labels end as sectors
    from (select distinct id from f_prediction) i
    left join (select id, max(confidence) as conf from f_prediction where level = 'sector' group by id) using (id)
    left join (select id, list(label order by pos) as labels from f_prediction
        where level = 'sector' and label in (select sector from f_taxonomy) group by id) using (id)"""


@query("c01_sector_gate", f"select id, confidence, array_to_string(sectors, '|') as sectors from ({_C01})")
def c01(spark, d):
    return X.sector_gate(fx.prediction(spark, d), fx.taxonomy(spark, d))


_C02 = f"""select s.id, s.sector, s.sp as sector_pos, coalesce(v.label, 'Uncategorized') as label,
    coalesce(v.pos, 1) as pos, coalesce(v.confidence, 1.0) as confidence
    from (select id, unnest(sectors) as sector, generate_subscripts(sectors, 1) - 1 as sp from ({_C01})) s
    left join (select id, sector, label, min(pos) as pos, arg_max(confidence, pos) as confidence
        from f_prediction p where level = 'subsector'
        and exists (select 1 from f_taxonomy t where t.sector = p.sector and t.subsector = p.label)
        group by all) v on v.id = s.id and v.sector = s.sector"""


@query("c02_subsector_gate", _C02)
def c02(spark, d):
    p, t = fx.prediction(spark, d), fx.taxonomy(spark, d)
    return X.subsector_gate(X.sector_gate(p, t), p, t)


_C03 = """select id, sector, subsector, label, pos, confidence from f_prediction p
    where level = 'sub_subsector' and exists (select 1 from f_taxonomy t where t.sector = p.sector
        and t.subsector = p.subsector and t.sub_subsector = p.label)"""


@query("c03_sub_subsector_gate", _C03)
def c03(spark, d):
    return X.sub_subsector_gate(fx.prediction(spark, d), fx.taxonomy(spark, d)).drop("level")


@query(
    "a18_best_sector",
    """select id, arg_max(sector, (confidence, -pos)) as best from (
       select id, sector, max(confidence) as confidence, min(p) as pos from (
           select *, row_number() over (partition by id order by sector) as p
           from f_prediction where level = 'subsector') group by all) group by id""",
)
def a18(spark, d):
    subs = fx.prediction(spark, d).filter("level = 'subsector'")
    # one confidence per sector: that of its best subsector
    per = subs.groupBy("id", "sector").agg(F.max("confidence").alias("c"))
    gathered = per.groupBy("id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("sector", "c")))).alias("m")
    )
    return gathered.select("id", X.best_sector(F.map_keys("m"), F.col("m")).alias("best"))


@query(
    "a19_top_labels",
    """select id, array_to_string(list(label order by c desc, first), '|') as labels from (
       select *, row_number() over (partition by id order by c desc, first) as rn from (
           select id, label, max(confidence) as c, min(p) as first from (
               select *, row_number() over (partition by id order by sector, subsector, pos) as p
               from f_prediction where level = 'sub_subsector') group by id, label)) where rn <= 4 group by id""",
)
def a19(spark, d):
    deep = fx.prediction(spark, d).filter("level = 'sub_subsector'")
    found = deep.groupBy("id").agg(
        F.array_sort(
            F.collect_list(F.struct("sector", "subsector", "pos", "label", "confidence"))
        ).alias("found")
    )
    return found.select("id", X.top_labels(F.col("found"), 4).alias("labels"))


# proposals with the rules applied, one row per (company, sector, label)
_CLEAN = f"""
    c02 as ({_C02}),
    firsts as (select id, label, min((sector_pos, pos)) as seen from c02 group by id, label),
    prop as (select f.id, list(label order by seen) as subs, any_value(s.sectors) as sectors
        from firsts f join ({_C01}) s using (id) group by f.id),
    r4 as (select id, sectors, subs, {c04_sql('subs')} as s4 from prop),
    r5 as (select id, sectors, subs, {c05_sql('s4')} as s5 from r4),
    cleaned as (select id, sectors, subs, {c06_sql('s5')} as tags from r5)"""
_PRUNE = f"""{_CLEAN},
    judged as (select c.id, c.sector, c.sector_pos,
        count(*) filter (list_contains(k.tags, c.label)) as n_kept,
        count(*) filter (list_contains(k.tags, c.label) and label <> 'Uncategorized') as n_scored,
        count(*) filter (list_contains(k.tags, c.label) and label <> 'Uncategorized' and confidence >= 0.9) as n_high,
        count(*) filter (label <> 'Uncategorized') as n_real,
        count(*) filter (label <> 'Uncategorized' and not list_contains({_HORIZONTAL}, label)) as n_plain
        from c02 c join cleaned k using (id) group by c.id, c.sector, c.sector_pos),
    weak as (select j.id, j.sector, j.sector_pos,
        len(k.sectors) >= 2 and case when n_kept = 0 then not (n_real > 0 and n_plain = 0)
            else n_scored > 0 and n_high = 0 end as weak from judged j join cleaned k using (id)),
    removed as (select w.id, w.sector, w.weak and not (a.all_weak and w.sector_pos = 0) as gone
        from weak w join (select id, bool_and(weak) as all_weak from weak group by id) a using (id)),
    pairs as (select c.id, c.sector, c.sector_pos, c.label, c.pos, c.confidence from c02 c
        join cleaned k on k.id = c.id and list_contains(k.tags, c.label)
        join removed r on r.id = c.id and r.sector = c.sector and not r.gone)"""


@query(
    "c07_synced_confidences",
    f"""with {_CLEAN.strip()} select c.id, c.sector, c.label, c.confidence from c02 c
        join cleaned k on k.id = c.id and list_contains(k.tags, c.label)""",
)
def c07(spark, d):
    rows = X.pruned(
        X.proposals(fx.prediction(spark, d), fx.taxonomy(spark, d), fx.RULES), fx.RULES
    )
    flat = rows.select("id", "cleaned", F.explode("proposals").alias("p")).select(
        "id", "cleaned", F.col("p.sector").alias("sector"), F.explode("p.subs").alias("s")
    )
    return flat.filter(F.array_contains("cleaned", F.col("s.label"))).select(
        "id", "sector", "s.label", "s.confidence"
    )


@query(
    "c08_weak_sectors",
    f"with {_PRUNE.strip()} select id, sector from weak where weak",
)
def c08(spark, d):
    rows = X.pruned(
        X.proposals(fx.prediction(spark, d), fx.taxonomy(spark, d), fx.RULES), fx.RULES
    )
    return rows.select("id", F.explode("weak").alias("sector"))


@query(
    "c09_kept_sectors",
    f"""with {_PRUNE.strip()} select r.id, array_to_string(list(r.sector order by w.sector_pos), '|') as sectors
        from removed r join weak w on w.id = r.id and w.sector = r.sector where not gone group by r.id""",
)
def c09(spark, d):
    rows = X.pruned(
        X.proposals(fx.prediction(spark, d), fx.taxonomy(spark, d), fx.RULES), fx.RULES
    )
    return rows.select("id", F.col("final_sectors").alias("sectors"))


_CLASSIFIED = f"""{_PRUNE},
    final_sectors as (select r.id, list(r.sector order by w.sector_pos) as sectors
        from removed r join weak w on w.id = r.id and w.sector = r.sector where not gone group by r.id),
    labels as (select id, list(distinct label) as remaining from pairs group by id),
    final_subs as (select k.id, case when len(k.sectors) >= 2
        then list_filter(k.tags, lambda t: list_contains(coalesce(l.remaining, []), t)) else k.tags end as subs
        from cleaned k left join labels l using (id)),
    deep as (select d.id, d.label, max(d.confidence) as c, min((p.sector_pos, p.pos, d.pos)) as seen
        from ({_C03}) d join pairs p on p.id = d.id and p.sector = d.sector and p.label = d.subsector
        group by d.id, d.label),
    final_deep as (select id, list(label order by c desc, seen) as deep from (
        select *, row_number() over (partition by id order by c desc, seen) as rn from deep) where rn <= 4 group by id),
    classified as (select s.id, s.sectors,
        case when len(b.subs) = 0 then ['Uncategorized'] else b.subs end as subsectors,
        coalesce(x.deep, []::varchar[]) as sub_subsectors
        from final_sectors s join final_subs b using (id) left join final_deep x using (id))"""


@query(
    "c11_classify",
    f"""with {_CLASSIFIED.strip()} select id, array_to_string(sectors, '|') as sectors,
        array_to_string(subsectors, '|') as subsectors, array_to_string(sub_subsectors, '|') as sub_subsectors
        from classified""",
)
def c11(spark, d):
    return X.without_transient(
        X.classify(fx.prediction(spark, d), fx.taxonomy(spark, d), fx.RULES)
    )


@query(
    "j16_moved_out",
    f"""with {_CLASSIFIED.strip()} select c.id, c.name, array_to_string(k.subsectors, '|') as subsectors
        from f_company c join classified k using (id)
        where list_contains(c.subsectors, 'Brand#13') and not list_contains(k.subsectors, 'Brand#13')""",
)
def j16(spark, d):
    after = X.classify(fx.prediction(spark, d), fx.taxonomy(spark, d), fx.RULES)
    return A.moved_out(fx.company(spark, d), after, "Brand#13")


@query(
    "a23_reprocess_status",
    f"""with {_CLASSIFIED.strip()},
        req as (select distinct website from f_company where website <> '' and list_contains(subsectors, 'Brand#13')),
        res as (select website, arg_min(name, id) as name, arg_min(id, id) as id from f_company
                where website <> '' group by website),
        st as (select req.website, case when res.id % 9 = 0 then 'error'
            when not list_contains(k.subsectors, 'Brand#13') then 'moved_out' else 'ok' end as status
            from req join res using (website) join classified k on k.id = res.id)
        select status, count(*) as n from st group by status""",
)
def a23(spark, d):
    from tagweave.plans.match import reprocess_status, status_counts

    companies = fx.company(spark, d).filter("website <> ''")
    requested = companies.filter(F.array_contains("subsectors", "Brand#13")).select("website").distinct()
    after = X.classify(fx.prediction(spark, d), fx.taxonomy(spark, d), fx.RULES)
    firsts = companies.groupBy("website").agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name"))
    failed = F.col("id") % 9 == 0
    results = firsts.join(after.select("id", "subsectors"), "id").select(
        "website", "name", "subsectors", F.when(failed, F.lit("timed out")).alias("error")
    )
    return status_counts(reprocess_status(requested, results, "Brand#13"))


# ---- clean-up jobs ------------------------------------------------------------


@query(
    "c12_redundant_cleanup",
    f"""select 'redundant_uncategorized_cleanup' as review_type, name as subject, 'fixed' as verdict,
        to_json({{'subsectors': subsectors}})::varchar as source_snapshot, to_json(after)::varchar as resolution
        from (select name, subsectors, {c06_sql('subsectors')} as after from f_company
              where list_contains(subsectors, 'Uncategorized') and len(subsectors) > 1)""",
)
def c12(spark, d):
    fixes = A.redundant_uncategorized_fixes(fx.company(spark, d))
    return A.fix_reviews(fixes, "redundant_uncategorized_cleanup", "redundant tag removed").drop("notes")


@query(
    "c12_cleaned_companies",
    f"select id, array_to_string({c06_sql('subsectors')}, '|') as subsectors from f_company",
)
def c12_companies(spark, d):
    companies = fx.company(spark, d)
    return A.apply_fixes(companies, A.redundant_uncategorized_fixes(companies)).select("id", "subsectors")


@query(
    "c13_empty_cleanup",
    """select 'empty_subsectors_backfill' as review_type, name as subject, 'fixed' as verdict,
       '{"subsectors":[]}' as source_snapshot, '["Uncategorized"]' as resolution
       from f_company where len(subsectors) = 0""",
)
def c13(spark, d):
    fixes = A.empty_subsector_fixes(fx.company(spark, d))
    return A.fix_reviews(fixes, "empty_subsectors_backfill", "empty tags made visible").drop("notes")


@query(
    "a21_cleanup_counts",
    """select 'redundant' as job, count(*) as fixed, 0 as skipped from f_company
       where list_contains(subsectors, 'Uncategorized') and len(subsectors) > 1
       union all select 'empty', count(*), 0 from f_company where len(subsectors) = 0""",
)
def a21(spark, d):
    companies = fx.company(spark, d)
    jobs = {
        "redundant": A.redundant_uncategorized_fixes(companies),
        "empty": A.empty_subsector_fixes(companies),
    }
    parts = [A.fix_counts(f).withColumn("job", F.lit(n)) for n, f in jobs.items()]
    return parts[0].unionByName(parts[1])
