"""Candidate pairs by tag overlap.

``arrays_overlap`` as a join condition would plan as a nested loop, so both sides
are exploded to an equi-join. The key is the subsector together with the sector:
only pairs that share both ever meet, and a pair that shares several such tags is
kept at the first of them only, which needs no de-duplicating shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.dataflow import (
    BLOCK_ROWS,
    durable,
    global_rank,
    pair_join,
    partitions,
    rank_within,
)
from tagweave.functions.tags import is_empty, lenient_match, overlap, tags

TAG_COLUMNS = ("sectors", "subsectors", "sub_subsectors")
CODE_COLUMNS = ("sec", "sub", "deep")
# companies with equal tags that meet others as one row
LIST_ROWS = 256
# names, in their order, that one list of candidates spans
LIST_RANGE = 100_000
# companies that one copy of a list of candidates is dealt to
LIST_READERS = 512


def coded_tags(companies: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Companies with their tags as sorted arrays of integers (sec, sub, deep), which
    compare much faster than text in the many pair tests.

    Codes follow one order of all tags: those used as subsectors first, and have
    negative codes; within that, rare before frequent. The result is written.
    """

    def marked(kind: str, column: str) -> Column:
        return F.transform(
            F.array_distinct(tags(column)),
            lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("tag")),
        )

    parts = [marked(k, c) for k, c in zip(CODE_COLUMNS, TAG_COLUMNS)]
    long = companies.select("id", F.explode(F.concat(*parts)).alias("x")).select(
        "id", "x.kind", "x.tag"
    )
    uses = long.groupBy("tag").agg(
        F.max((F.col("kind") == "sub").cast("int")).alias("as_sub"),
        F.count(F.lit(1)).alias("uses"),
    )
    ranked = global_rank(uses, [F.col("as_sub").desc(), F.col("uses"), F.col("tag")], "code")
    book = ranked.select(
        "tag",
        F.when(F.col("as_sub") == 1, F.col("code") - F.lit(1 << 30))
        .otherwise(F.col("code"))
        .cast("int")
        .alias("code"),
    )
    codes = (
        long.join(book, ["tag"])
        .groupBy("id")
        .agg(
            *[
                F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("code")))).alias(k)
                for k in CODE_COLUMNS
            ]
        )
    )
    return durable(companies.select("id", "name", *keep).join(codes, "id"), "coded")


def _side(coded: DataFrame, suffix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One side of a pair, names suffixed with ``_a`` or ``_b``, a row per tag pair."""
    side = coded.select(
        F.col("id").alias(f"id{suffix}"),
        F.col("name").alias(f"company{suffix}"),
        *[F.col(c).alias(f"{c}{suffix}") for c in (*CODE_COLUMNS, *keep)],
    )
    return side.withColumn("sector_key", F.explode(f"sec{suffix}")).withColumn(
        "subsector_key", F.explode(f"sub{suffix}")
    )


def _at_first_shared_tag() -> Column:
    return (F.col("sector_key") == _first_shared("sec_a", "sec_b")) & (
        F.col("subsector_key") == _first_shared("sub_a", "sub_b")
    )


def codes_meet(a: str, b: str) -> Column:
    """Whether two short code arrays, never null, share a code. Searching them is
    faster than the hash set that arrays_overlap builds."""
    return F.exists(a, lambda c: F.array_contains(b, c))


def codes_lenient(a: str, b: str) -> Column:
    """Sub-subsector test on code arrays."""
    return (F.size(a) == 0) | (F.size(b) == 0) | codes_meet(a, b)


def _first_shared(a: str, b: str) -> Column:
    """Lowest code that two sorted code arrays share."""
    return F.get(F.filter(a, lambda c: F.array_contains(b, c)), F.lit(0))


_PAIR_KEYS = ["sector_key", "subsector_key"]
_CODES = [f"{c}{s}" for c in CODE_COLUMNS for s in ("_a", "_b")]


def signature() -> Column:
    """A key that companies with the same codes share."""
    return F.concat_ws("|", *[F.array_join(F.col(c).cast("array<string>"), ",") for c in CODE_COLUMNS])


def bitmap(codes: str) -> Column:
    """64 bits, one set for each code."""
    return F.aggregate(
        codes,
        F.lit(0).cast("long"),
        lambda acc, c: acc.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)))
        ),
    )


def _alike(coded: DataFrame, member: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows (sig, part, codes, members, n) that stand for the companies with equal tags (and
    equal ``within``), about LIST_ROWS of them at most. ``coded`` has their ``sig``."""
    sizes = coded.groupBy("sig").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(LIST_ROWS)).cast("int").alias("_parts")
    )
    dealt = coded.join(sizes, "sig").withColumn("part", F.pmod(F.xxhash64("id", "name"), "_parts"))
    return (
        dealt.groupBy("sig", "part", *within)
        .agg(*[F.first(c).alias(c) for c in CODE_COLUMNS], F.collect_list(member).alias("members"))
        .withColumn("n", F.size("members"))
    )


def _meeting_alike(
    first: DataFrame, second: DataFrame, block_rows: int, lenient: bool
) -> DataFrame:
    """Pairs of rows of :func:`_alike` whose companies are candidates of each other, each
    once, columns suffixed with ``_a`` and ``_b``. Tags are tested once for all companies
    that a row stands for, by bitmaps and, only where those meet, by the codes."""

    def side(rows: DataFrame, suffix: str) -> DataFrame:
        rows = rows.select("*", F.posexplode("sec").alias("_i", "sector_key"))
        rows = rows.select("*", F.posexplode("sub").alias("_j", "subsector_key")).withColumns(
            {"before_sec": F.slice("sec", F.lit(1), "_i"), "before_sub": F.slice("sub", F.lit(1), "_j")}
        )
        rows = rows.withColumns({f"bits_{c}": bitmap(c) for c in ("before_sec", "before_sub", "deep")})
        rows = rows.drop("sec", "sub", "_i", "_j")
        return rows.select(
            *_PAIR_KEYS, *[F.col(c).alias(f"{c}{suffix}") for c in rows.columns if c not in _PAIR_KEYS]
        )

    def apart(c: str) -> Column:
        return F.col(f"bits_{c}_a").bitwiseAND(F.col(f"bits_{c}_b")) == 0

    def share(c: str) -> Column:
        return ~apart(c) & F.arrays_overlap(f"{c}_a", f"{c}_b")

    # a pair is kept at the first sector and subsector that it shares
    test = ~share("before_sec") & ~share("before_sub")
    if lenient:
        test = test & ((F.col("bits_deep_a") == 0) | (F.col("bits_deep_b") == 0) | share("deep"))
    lhs, rhs = side(first, "_a"), side(second, "_b")
    ids = [[c for c in rows.columns if c.removesuffix(s) in ("sig", "part", "range")]
           for rows, s in ((lhs, "_a"), (rhs, "_b"))]
    return pair_join(lhs, rhs, _PAIR_KEYS, *ids, block_rows, weights=("n_a", "n_b")).filter(test)


def overlap_candidates(
    companies: DataFrame,
    probe: DataFrame | None = None,
    keep_tags: bool = False,
    ordered: bool = False,
    block_rows: int = BLOCK_ROWS,
    lenient: bool = True,
    listed: bool = False,
) -> DataFrame:
    """Pairs (company a, company b) with a shared sector and subsector; ``probe`` (id)
    limits which companies stand first.

    Sub-subsectors are tested leniently: they must meet only if both have some. Without
    ``lenient`` they are not tested.
    ``ordered`` keeps each unordered pair once, as company_a < company_b.
    ``keep_tags`` keeps the tags of both ends.
    ``listed`` gives all pairs as lists in name order instead: (company_a, before, others),
    ``before`` being the number of company_a's candidates in its earlier lists.
    """
    keep = TAG_COLUMNS if keep_tags else ()
    coded = coded_tags(companies, keep).withColumn("sig", signature())
    first = _probed(coded, probe)
    if listed:
        if keep_tags or ordered:
            raise ValueError("lists hold the names of all candidates")
        return _candidate_lists(first, coded, block_rows, lenient)
    return _company_pairs(first, coded, keep, ordered, block_rows, lenient)


def _company_pairs(
    first: DataFrame,
    coded: DataFrame,
    keep: tuple[str, ...],
    ordered: bool,
    block_rows: int,
    lenient: bool,
) -> DataFrame:
    member = F.struct("id", F.col("name").alias("company"), *keep)
    met = _meeting_alike(_alike(first, member), _alike(coded, member), block_rows, lenient)
    for s in ("_a", "_b"):
        met = met.withColumn(f"one{s}", F.explode(f"members{s}")).drop(f"members{s}")
    a, b = F.col("one_a.company"), F.col("one_b.company")
    return met.filter(a < b if ordered else a != b).select(
        *[F.col(f"one{s}.{c}").alias(f"{c}{s}") for s in ("_a", "_b") for c in ("id", "company", *keep)]
    )


def _candidate_lists(
    first: DataFrame, coded: DataFrame, block_rows: int, lenient: bool
) -> DataFrame:
    """The candidates as lists of names. Companies with equal tags share their lists, so
    no pair is shuffled: a list is gathered and sorted once for each set of tags and each
    range of names, and dealt to the companies that have these tags."""
    n = partitions(coded.sparkSession)
    named = coded.filter("name is not null")
    ranked = global_rank(named.select("id", "name", "sig", *CODE_COLUMNS), [F.col("name"), F.col("id")], "_at")
    ranked = durable(
        ranked.withColumn("range", F.floor((F.col("_at") - 1) / LIST_RANGE).cast("int")).drop("_at"),
        "list-members",
    )
    # rows of one name share their numbering, so they are numbered as pairs
    again = durable(
        named.groupBy("name").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("name"),
        "list-again",
    )
    heads = ranked.join(again, "name", "left_anti").join(first.select("id"), "id", "left_semi")
    tagged = heads.groupBy("sig").agg(
        *[F.first(c).alias(c) for c in CODE_COLUMNS], F.count(F.lit(1)).alias("readers")
    )
    tagged = tagged.withColumn("n", F.lit(1))
    lists = durable(
        _meeting_alike(
            tagged.drop("readers"), _alike(ranked, F.col("name"), ("range",)), block_rows, lenient
        )
        .select(F.col("sig_a").alias("sig"), F.col("range_b").alias("range"), "members_b")
        # a fixed partition count, as sorting costs far more than the size of the rows tells
        .repartition(n, "sig", "range")
        .groupBy("sig", "range")
        .agg(F.sort_array(F.flatten(F.collect_list("members_b"))).alias("others")),
        "lists",
    )
    earlier = W.partitionBy("sig").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = lists.select("sig", "range", F.size("others").alias("n")).select(
        "sig", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("offset")
    )
    parts = F.ceil(F.col("readers") / LIST_READERS).cast("int")
    copies = tagged.select("sig", parts.alias("parts"))
    on = ["sig", "range", "part"]
    reading = (
        heads.select("id", "name", "sig", F.col("range").alias("own"))
        .join(copies, "sig")
        .withColumn("part", F.pmod(F.xxhash64("id", "name"), "parts"))
        .join(offsets, "sig")
        # a company is among those with its tags, and not its own candidate
        .withColumn("before", F.col("offset") - (F.col("range") > F.col("own")).cast("long"))
        .select(*on, F.col("name").alias("company_a"), "before")
    )
    read = lists.join(copies, "sig").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
    )
    out = reading.repartition(n, *on).join(read.repartition(n, *on).select(*on, "others"), on).select(
        "company_a", "before", F.array_remove("others", F.col("company_a")).alias("others")
    )
    if again.isEmpty():
        return out
    pairs = _company_pairs(first.join(again, "name", "left_semi"), coded, (), False, block_rows, lenient)
    pairs = pairs.select("company_a", "company_b")
    numbered = rank_within(pairs, ["company_a"], [F.col("company_b")])
    return out.unionByName(
        numbered.select("company_a", (F.col("pos") - 1).alias("before"), F.array("company_b").alias("others"))
    )


def _probed(coded: DataFrame, probe: DataFrame | None) -> DataFrame:
    return coded if probe is None else coded.join(probe.select("id"), "id", "left_semi")


def _meeting(
    first: DataFrame,
    coded: DataFrame,
    keep: tuple[str, ...],
    ordered: bool,
    block_rows: int,
    lenient: bool = True,
    linked: DataFrame | None = None,
) -> DataFrame:
    order = F.col("company_a") < F.col("company_b") if ordered else (
        F.col("company_a") != F.col("company_b")
    )
    # one condition, so that its cheap parts stay in front
    test = order & _at_first_shared_tag()
    if lenient:
        test = test & codes_lenient("deep_a", "deep_b")
    if linked is not None:
        test = test & ~F.coalesce(F.array_contains("_notes", F.col("company_b")), F.lit(False))
    return (
        pair_join(
            _side(first, "_a", keep), _side(coded, "_b", keep), _PAIR_KEYS,
            ["id_a", "company_a"], ["id_b", "company_b"], block_rows, linked, "company_b",
        )
        .filter(test)
        .drop(*_PAIR_KEYS, *_CODES, "_notes")
    )


def _linked_pairs(edges: DataFrame, first: DataFrame, coded: DataFrame) -> DataFrame:
    """The candidates company_a < company_b that an edge links in either direction, each once
    for the rows with these names, with the codes of both ends."""

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(
            F.col("id").alias(f"id{suffix}"),
            F.col("name").alias(f"company{suffix}"),
            *[F.col(c).alias(f"{c}{suffix}") for c in CODE_COLUMNS],
        )

    return (
        symmetric(edges)
        .select(F.col("company").alias("company_a"), F.col("other").alias("company_b"))
        .filter("company_a < company_b")
        .distinct()
        .join(side(first, "_a"), "company_a")
        .join(side(coded, "_b"), "company_b")
        .filter(
            codes_meet("sec_a", "sec_b")
            & codes_meet("sub_a", "sub_b")
            & codes_lenient("deep_a", "deep_b")
        )
    )


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge row, as (company, other); repeats stay."""
    return edges.select(
        F.col("company_a").alias("company"), F.col("company_b").alias("other")
    ).unionAll(
        edges.select(F.col("company_b").alias("company"), F.col("company_a").alias("other"))
    )


def without_linked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Drop pairs that an edge links in either direction, whatever its state."""
    linked = symmetric(edges).select(
        F.col("company").alias("company_a"), F.col("other").alias("company_b")
    )
    return pairs.join(linked, ["company_a", "company_b"], "left_anti")


def without_exact(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Drop pairs stored as an edge in this very direction."""
    return pairs.join(
        edges.select("company_a", "company_b"), ["company_a", "company_b"], "left_anti"
    )


def sweep_candidates(
    companies: DataFrame,
    edges: DataFrame,
    probe: DataFrame | None = None,
    keep_tags: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each unordered candidate pair once, without pairs known in any direction. Known ones
    are left out where pairs are formed, so no candidate is shuffled."""
    keep = TAG_COLUMNS if keep_tags else ()
    coded = coded_tags(companies, keep)
    first = _probed(coded, probe)
    linked = _linked_pairs(edges, first, coded).select(
        _first_shared("sec_a", "sec_b").alias("sector_key"),
        _first_shared("sub_a", "sub_b").alias("subsector_key"),
        "id_a", "company_a", "id_b", "company_b",
    )
    pairs = _meeting(first, coded, keep, True, block_rows, linked=durable(linked, "linked"))
    names = ("company_a", "company_b")
    return pairs.select(*names, *[c for c in pairs.columns if c not in names])


def candidate_counts(
    companies: DataFrame,
    edges: DataFrame,
    probe: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """How many rows of :func:`sweep_candidates` each company starts: (company_a, n).

    Pairs are counted where they are formed and never shuffled; those that an edge links
    are counted from the edges and taken off.
    """
    coded = coded_tags(companies)
    first = _probed(coded, probe)

    def per(pairs: DataFrame, out: str) -> DataFrame:
        return pairs.groupBy("company_a").agg(F.count(F.lit(1)).alias(out))

    linked = _linked_pairs(edges, first, coded)
    formed = per(_meeting(first, coded, (), True, block_rows), "formed")
    left = F.col("formed") - F.coalesce("linked", F.lit(0).cast("long"))
    counts = formed.join(per(linked, "linked"), "company_a", "left")
    return counts.select("company_a", left.alias("n")).filter("n > 0")


def targeted_candidates(
    companies: DataFrame, websites: DataFrame, keep_tags: bool = False
) -> DataFrame:
    """Candidates of the companies whose website is listed, against all companies.
    Known pairs stay in: they are dropped after scoring."""
    listed = companies.join(websites.select("website"), "website", "left_semi")
    return overlap_candidates(companies, listed, keep_tags)


def two_hop_candidates(
    companies: DataFrame,
    edges: DataFrame,
    direct: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    keep_tags: bool = False,
    among: DataFrame | None = None,
) -> DataFrame:
    """Pairs (A, X) where X is linked to a direct link U of A, not linked to A, and
    shares a sector and a subsector with A. If A has sub-subsectors, X must share one.

    ``direct`` (company, other) limits which links count as A's direct ones; by
    default all do. Paths are joined on (U, sector, subsector), so a hub emits only
    pairs that share tags, and a hot hub is split into blocks.

    ``among`` (id_a, id_b) names the only pairs that are wanted. Then paths are looked up for
    those of them that are not linked, and no others are formed.
    """
    coded = coded_tags(companies)
    ids = coded.select("id", F.col("name").alias("company"))
    links = durable(symmetric(edges).distinct(), "links")
    known = links if direct is None else links.unionAll(direct.select("company", "other"))
    first = links if direct is None else direct.select("company", "other").distinct()

    def named(df: DataFrame, suffix: str, keep: tuple[str, ...] = ()) -> DataFrame:
        side = companies.select(
            F.col("id").alias(f"id{suffix}"), F.col("name").alias(f"company{suffix}"),
            *[tags(c).alias(f"{c}{suffix}") for c in keep],
        )
        return df.join(side, [f"id{suffix}"])

    def unlinked(met: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        linked = known.select(
            F.col("company").alias("company_a"), F.col("other").alias("company_b")
        )
        pairs = named(named(met, "_a", keep), "_b", keep)
        return pairs.join(linked, ["company_a", "company_b"], "left_anti")

    keep = TAG_COLUMNS if keep_tags else ()
    strict = (F.size("deep_a") == 0) | codes_meet("deep_a", "deep_b")
    if among is not None:
        wanted = durable(
            unlinked(among.filter("id_a <> id_b").distinct()).select("id_a", "id_b").distinct(),
            "two-hop-wanted",
        )

        def end(df: DataFrame, suffix: str) -> DataFrame:
            side = coded.select(
                F.col("id").alias(f"id{suffix}"), F.col("name").alias(f"company{suffix}"),
                *[F.col(c).alias(f"{c}{suffix}") for c in CODE_COLUMNS],
            )
            return df.join(side, f"id{suffix}")

        paths = (
            end(end(wanted, "_a"), "_b")
            .filter(codes_meet("sec_a", "sec_b") & codes_meet("sub_a", "sub_b") & strict)
            .select("id_a", "company_a", "id_b", "company_b")
            .join(first.select(F.col("company").alias("company_a"), F.col("other").alias("hub")), "company_a")
            .join(
                links.select(F.col("company").alias("hub"), F.col("other").alias("company_b")),
                ["hub", "company_b"],
                "left_semi",
            )
        )
        return unlinked(durable(paths.select("id_a", "id_b").distinct(), "two-hop"), keep)

    def tagged(pairs: DataFrame, suffix: str) -> DataFrame:
        """The end ``company`` of each (company, hub), with its tags."""
        numbered = pairs.join(ids, ["company"]).select("id", "hub")
        facts = _side(coded, suffix).withColumnRenamed(f"id{suffix}", "id")
        # a company has few tags, so it repeats few times on either side of this join
        return (
            numbered.join(facts.drop(f"company{suffix}"), "id").withColumnRenamed("id", f"id{suffix}")
        )

    lhs = tagged(first.withColumnRenamed("other", "hub"), "_a")
    rhs = tagged(links.select(F.col("company").alias("hub"), F.col("other").alias("company")), "_b")
    met = durable(
        pair_join(lhs, rhs, ["hub", *_PAIR_KEYS], ["id_a"], ["id_b"], block_rows)
        .filter((F.col("id_a") != F.col("id_b")) & _at_first_shared_tag() & strict)
        # a pair meets once at each hub
        .select("id_a", "id_b")
        .distinct(),
        "two-hop",
    )
    return unlinked(met, keep)


def overlap_filter(companies: DataFrame, company: dict) -> DataFrame:
    """Companies overlapping one given company, itself excluded (single lookup)."""
    if not company.get("sectors") or not company.get("subsectors"):
        return companies.limit(0)
    given = {
        c: F.array(*[F.lit(t) for t in company.get(c) or []]).cast("array<string>")
        for c in TAG_COLUMNS
    }
    return companies.filter(
        overlap("sectors", given["sectors"])
        & overlap("subsectors", given["subsectors"])
        & (is_empty(given["sub_subsectors"]) | lenient_match("sub_subsectors", given["sub_subsectors"]))
        & (F.col("name") != company["name"])
    )
