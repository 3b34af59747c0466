"""Exact set-similarity join over company tags, for a minimum Jaccard score.

All pairs of a popular tag are never compared. Companies with the same tags
collapse to one signature, and two signatures meet only on a tag among the first few
of each, rare subsectors first: with n tags and threshold t, sets that reach t must
share one of the first n - ceil(t*n) + 1. Only pairs that reach t become companies: the
lists of companies travel with their signatures, so pairs come out where these meet, and
neither matches nor pairs of companies are shuffled or written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.dataflow import BLOCK_ROWS, durable, pair_join
from tagweave.functions.tags import tags
from tagweave.operators.overlap import CODE_COLUMNS, bitmap, coded_tags


# code of a null tag in the score: after all others, which are ranks
_NULL_CODE = 2**31 - 1
# companies of a signature that meet others as one row
LIST_ROWS = 256


def signed_members(coded: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """Each company with the key of its tag sets, and whether the probe names it."""
    parts = [F.array_join(F.col(c).cast("array<string>"), ",") for c in CODE_COLUMNS]
    key = F.concat_ws("|", *parts, F.col("null_tag").cast("string"))
    members = coded.withColumn("sig", key)
    if probe is None:
        return members.withColumn("probed", F.lit(True))
    named = probe.select("id", F.lit(True).alias("probed")).distinct()
    return members.join(named, "id", "left").withColumn("probed", F.coalesce("probed", F.lit(False)))


def _listed(signed: DataFrame, list_rows: int) -> DataFrame:
    """Rows (number, sig, members, ...) that stand for the companies of a signature, about
    ``list_rows`` of them at most, with their tags and whether one of them is probed."""
    sizes = signed.groupBy("sig").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(max(list_rows, 1))).cast("int").alias("_parts")
    )
    # signatures meet in many rows, so they go by number
    numbers = durable(sizes.withColumn("_number", F.monotonically_increasing_id()), "signature-numbers")
    member = F.struct("id", F.col("name").alias("company"), F.xxhash64("name").alias("mark"), "probed")
    rows = (
        signed.join(numbers, "sig")
        .drop("sig")
        .withColumnRenamed("_number", "sig")
        .withColumn("_part", F.pmod(F.xxhash64("id", "name"), "_parts"))
        .groupBy("sig", "_part")
        .agg(
            *[F.first(c).alias(c) for c in (*CODE_COLUMNS, "null_tag")],
            F.max("probed").alias("probed"),
            F.collect_list(member).alias("members"),
        )
    )
    return rows.drop("_part").withColumns(
        {"number": F.monotonically_increasing_id(), "rows": F.size("members")}
    )


def _similar_lists(
    listed: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, lenient: bool = True
) -> DataFrame:
    """Unordered pairs of rows of :func:`_listed`, columns suffixed with ``_a`` and ``_b``,
    whose tags overlap in sectors and subsectors and reach the score; a row pairs with itself
    too. At least one of the two has a probed member."""
    null_code = F.when(F.col("null_tag"), F.array(F.lit(_NULL_CODE))).otherwise(F.array().cast("array<int>"))
    every = F.array_sort(F.concat(F.array_union("sec", "sub"), null_code))
    n = F.size("every")
    length = n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    # A pair shares a subsector, and tags used as subsectors come first: the first tag
    # it shares is one of those, and lies in the prefix of both.
    sets = durable(
        listed.withColumn("every", every)
        .withColumn("n", n)
        .withColumn("prefix", F.filter(F.slice("every", F.lit(1), length), lambda c: c < 0))
        .withColumn("bits", bitmap("every"))
        .withColumn("slack", F.col("n") - F.bit_count("bits")),
        "signatures",
    )

    def side(suffix: str) -> DataFrame:
        """A row per (sector, prefix tag), with the sectors and tags that precede it."""
        cols = ("number", "sig", "members", "rows", "sub", "deep", "every", "n", "probed", "bits", "slack")
        rows = sets.select(*cols, "sec", "prefix", F.posexplode("sec").alias("_i", "sector_key"))
        rows = rows.select("*", F.posexplode("prefix").alias("_j", "tag")).withColumns(
            {
                "before_sec": F.slice("sec", F.lit(1), F.col("_i")),
                "before_tag": F.slice("prefix", F.lit(1), F.col("_j")),
            }
        )
        keep = (*cols, "before_sec", "before_tag")
        return rows.select(
            "sector_key", "tag",
            *[F.col(c).alias(f"{c}{suffix}") for c in keep],
            bitmap("before_sec").alias(f"sec_bits{suffix}"),
            bitmap("before_tag").alias(f"tag_bits{suffix}"),
        )

    def none_before(kind: str) -> Column:
        """No shared sector or tag before this one; settled by bits where they differ."""
        apart = F.col(f"{kind}_bits_a").bitwiseAND(F.col(f"{kind}_bits_b")) == 0
        return apart | ~F.arrays_overlap(f"before_{kind}_a", f"before_{kind}_b")

    # at most as many shared tags as shared bits, plus those that share a bit in one set
    most = F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b"))) + F.col("slack_a")
    need = F.lit((threshold - 1e-9) / (1 + threshold))
    shared = F.size(F.array_intersect("every_a", "every_b"))
    score = shared.cast("double") / (F.col("n_a") + F.col("n_b") - shared)
    # One condition, cheapest part first: filters given one by one would be pushed into
    # the join with the last and dearest in front. Plain arithmetic on bitmaps rules
    # most pairs out: shared / (n_a + n_b - shared) >= threshold. None is a function of a
    # lambda, as one of these would take the whole join out of generated code.
    test = (
        (most >= (F.col("n_a") + F.col("n_b")) * need)
        & ((F.col("number_a") <= F.col("number_b")) | ~F.col("probed_b"))
        # each pair at its first shared tag and first shared sector only
        & none_before("tag")
        & none_before("sec")
        & (score >= threshold)
        & F.arrays_overlap("sub_a", "sub_b")
    )
    if lenient:
        test = test & (
            (F.size("deep_a") == 0) | (F.size("deep_b") == 0) | F.arrays_overlap("deep_a", "deep_b")
        )
    return (
        pair_join(
            side("_a").filter("probed_a"), side("_b"),
            ["sector_key", "tag"], ["number_a"], ["number_b"], block_rows, None, None, ("rows_a", "rows_b"),
        )
        .filter(test)
        .select(*[f"{c}{s}" for s in ("_a", "_b") for c in ("number", "sig", "members")], score.alias("score"))
    )


def similar_members(
    companies: DataFrame,
    threshold: float,
    lenient: bool = True,
    probe: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    count_nulls: bool = False,
    list_rows: int = LIST_ROWS,
    namesakes: bool = True,
) -> DataFrame:
    """The pairs of :func:`similar_pairs`, each with its two ends in any order. Without
    ``namesakes`` only those of companies that have names, and other ones."""
    if not threshold > 0:
        raise ValueError("threshold must be positive")
    null_tag = F.lit(False)
    if count_nulls:
        null_tag = F.exists(F.concat(tags("sectors"), tags("subsectors")), F.isnull)
    if not namesakes:
        companies = companies.filter("name is not null")
    coded = coded_tags(companies.withColumn("null_tag", null_tag), ("null_tag",))
    pairs = _similar_lists(_listed(signed_members(coded, probe), list_rows), threshold, block_rows, lenient)
    for s in ("_a", "_b"):
        pairs = pairs.withColumn(f"one{s}", F.explode(f"members{s}")).drop(f"members{s}")
    a, b = F.col("one_a"), F.col("one_b")
    # numbers are compared in most pairs, names only if they are equal
    other = (a["mark"] != b["mark"]) | (a["company"] != b["company"])
    named = a["company"].isNotNull() & b["company"].isNotNull()
    # pairs inside one row come out twice, those across two once
    once = F.when(F.col("number_a") == F.col("number_b"), a["company"] < b["company"])
    if namesakes:
        once = once.when(F.col("sig_a") == F.col("sig_b"), named & other).otherwise(F.lit(True))
    else:
        once = once.otherwise(other)
    if probe is not None:
        once = once & (a["probed"] | b["probed"])
    return pairs.filter(once).select(
        a["id"].alias("id_a"), a["company"].alias("company_a"),
        b["id"].alias("id_b"), b["company"].alias("company_b"), "score",
    )


def similar_pairs(
    companies: DataFrame,
    threshold: float,
    lenient: bool = True,
    probe: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    count_nulls: bool = False,
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """Every pair company_a < company_b that overlaps in sectors and subsectors and
    whose tag Jaccard reaches ``threshold`` (> 0): (id_a, company_a, id_b, company_b, score).

    Equals the scored and filtered overlap candidates. ``lenient`` adds their
    sub-subsector test; ``probe`` (id) keeps pairs with at least one end in it. Companies do
    not meet on null tags; with ``count_nulls`` these count in the score, as one tag.
    """
    pairs = similar_members(companies, threshold, lenient, probe, block_rows, count_nulls, list_rows)
    a_first = F.col("company_a") < F.col("company_b")
    return pairs.select(
        F.when(a_first, F.col("id_a")).otherwise(F.col("id_b")).alias("id_a"),
        F.least("company_a", "company_b").alias("company_a"),
        F.when(a_first, F.col("id_b")).otherwise(F.col("id_a")).alias("id_b"),
        F.greatest("company_a", "company_b").alias("company_b"),
        "score",
    )
