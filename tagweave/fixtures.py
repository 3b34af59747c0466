"""Companies, edges, reviews, predictions and pages derived from the given tables.

Derived tables are written once per session and input folder to the shared folder,
then read back as plain Parquet. Edges are far more than companies, so of these only the
lists that they come from are written, and each use forms the rows it reads.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.dataflow import durable
from tagweave.functions.tags import literals
from tagweave.operators.similarity import similar_members
from tagweave.operators.taxonomy import TagRules

RULES = TagRules(
    horizontal=("Brand#1", "Brand#2", "Brand#3", "Brand#4"),
    exempt_sectors=("MEDIUM", "LARGE"),
    generic="Brand#5",
    redirects=("Brand#6", "Brand#7", "Brand#8"),
)
AUDITED = ("Brand#1", "Brand#2", "Brand#9")
QUEUE = tuple(f"Brand#{i}" for i in range(1, 12))
DEEP_BRANDS = ("Brand#10", "Brand#11", "Brand#12")
DRIFT_BRANDS = ("Brand#24", "Brand#25")
MIN_GRAPH_EDGE = 0.6
ANY_EDGE = 1e-12  # below every score of a pair with a shared tag

_written: dict[tuple[str, str, str], DataFrame] = {}


def derived(fn: Callable[[SparkSession, str], DataFrame]):
    """Write the result once per session and folder."""

    @wraps(fn)
    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, fn.__name__)
        if key not in _written:
            _written[key] = durable(fn(spark, sf_dir), f"fixture-{fn.__name__}")
        return _written[key]

    return load


def formed(fn: Callable[[SparkSession, str], DataFrame]):
    """Keep the plan of the result for the session and folder, not its rows."""

    @wraps(fn)
    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, fn.__name__)
        if key not in _written:
            _written[key] = fn(spark, sf_dir)
        return _written[key]

    return load


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as (id, p_type, p_brand, size, q), the rows of a customer in one partition,
    so that what groups by customer and anything else needs no further shuffle."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        "p_type",
        "p_brand",
        F.concat(F.lit("S"), (F.col("p_size") % 5).cast("string")).alias("size"),
    )
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("id", "p_type", "p_brand", "size", F.col("l_quantity").alias("q"))
        .repartition("id")
    )


def _ranked_tags(rows: DataFrame) -> DataFrame:
    """Tags of each customer by quantity, arrays of names, best first: types, brands, sizes.
    Few per customer."""
    kinds = {"types": "p_type", "brands": "p_brand", "sizes": "size"}
    each = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("tag")) for k, c in kinds.items()]
    )
    sums = (
        rows.select("id", F.explode(each).alias("x"), "q")
        .groupBy("id", "x.kind", "x.tag")
        .agg(F.sum("q").alias("q"))
    )
    entry = F.struct((-F.col("q")).alias("n"), "tag")
    gathered = sums.groupBy("id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry))).alias(k) for k in kinds]
    )
    return gathered.select("id", *[F.transform(k, lambda x: x["tag"]).alias(k) for k in kinds])


@derived
def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey"
    )
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country")
    )
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("description")
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("site"))
    n_pages = pages.agg(F.count(F.lit(1)).alias("n_pages"))
    empty = literals([])
    # long texts come last, so that they are shuffled once
    df = (
        customers.join(nations, "c_nationkey", "left")
        .crossJoin(F.broadcast(n_pages))
        .withColumn("page_id", F.col("id") % F.col("n_pages"))
        .join(pages, "page_id", "left")
        .join(_ranked_tags(sold(spark, sf_dir)), "id", "left")
        .join(documents, "id", "left")
    )

    def top(col: str, n) -> object:
        return F.slice(F.coalesce(col, empty), F.lit(1), n)

    subs = F.when(F.col("id") % 17 == 0, empty).otherwise(
        top("brands", (F.col("id") % 4 + 1).cast("int"))
    )
    return df.select(
        "id",
        "name",
        "country",
        "description",
        F.when(F.col("id") % 5 != 0, F.col("site")).alias("website"),
        top("types", (F.col("id") % 2 + 1).cast("int")).alias("sectors"),
        F.when(F.col("id") % 11 == 0, F.concat(subs, literals(["Uncategorized"])))
        .otherwise(subs)
        .alias("subsectors"),
        F.when(F.col("id") % 3 == 0, empty).otherwise(top("sizes", F.lit(2))).alias("sub_subsectors"),
        F.lit(None).cast("string").alias("linkedin_url"),
        F.lit(None).cast("string").alias("flaticon_url"),
        F.lit(None).cast("string").alias("logo_url"),
        F.lit("v2").alias("taxonomy_version"),
    )


def blanked_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies, some of them without sectors."""
    return company(spark, sf_dir).withColumn(
        "sectors", F.when(F.col("id") % 101 == 0, literals([])).otherwise(F.col("sectors"))
    )


@derived
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    real = parts.filter(~F.col("p_brand").isin(*DRIFT_BRANDS)).select(
        F.col("p_type").alias("sector"), F.col("p_brand").alias("subsector")
    )
    none = parts.select(
        F.col("p_type").alias("sector"), F.lit("Uncategorized").alias("subsector")
    )
    sizes = literals([f"S{i}" for i in range(5)])
    deep = F.col("subsector").isin(*DEEP_BRANDS)
    return (
        real.union(none)
        .distinct()
        .withColumn(
            "sub_subsector", F.explode_outer(F.when(deep, sizes))
        )
        .withColumn("definition", F.concat(F.col("subsector"), F.lit(" of "), F.col("sector")))
    )


@formed
def edge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs a.id < b.id with a shared sector and subsector, whatever their score."""
    return _scored_pairs(spark, sf_dir, ANY_EDGE)


def _scored_pairs(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """Scored pairs with the lower id first."""
    # a name is no pair with itself
    ends = similar_members(
        company(spark, sf_dir), least, lenient=False, count_nulls=True, namesakes=False
    )
    # rows of one id go by name
    low_first = (F.col("id_a") < F.col("id_b")) | (
        (F.col("id_a") == F.col("id_b")) & (F.col("company_a") > F.col("company_b"))
    )
    return ends.select(
        F.least("id_a", "id_b").alias("a_id"),
        F.greatest("id_a", "id_b").alias("b_id"),
        F.when(low_first, F.col("company_a")).otherwise(F.col("company_b")).alias("company_a"),
        F.when(low_first, F.col("company_b")).otherwise(F.col("company_a")).alias("company_b"),
        "score",
    )


@formed
def graph_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of :func:`edge_base` that reach the least score of a graph edge, by a
    similarity join that forms no weaker ones."""
    return _scored_pairs(spark, sf_dir, MIN_GRAPH_EDGE)


def _as_edges(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a_id"), F.col("b_id")
    return pairs.select(
        (a * 1000000 + b).alias("id"),
        "company_a",
        "company_b",
        "score",
        ((a + b) % 10 != 0).alias("active"),
        ((a + b) % 3 == 0).alias("checked"),
        F.lit(None).cast("boolean").alias("validated"),
    )


def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_edges(edge_base(spark, sf_dir))


def messy_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph edges with some ends swapped, some pairs stored twice (in the other
    direction, with a higher id and a lower score) and some dangling ends."""
    b_id, again = F.col("b_id"), F.col("again")
    # one pass: the pairs are far more than what they come from
    times = F.when(b_id % 13 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    stored = graph_base(spark, sf_dir).withColumn("again", F.explode(times))
    swapped = (b_id % 7 == 0) != again
    first = F.when(swapped, F.col("company_b")).otherwise(F.col("company_a"))
    second = F.when(swapped, F.col("company_a")).otherwise(F.col("company_b"))
    ghost = F.concat(F.lit("Ghost#"), b_id.cast("string"))
    return _as_edges(
        stored.select(
            (F.col("a_id") + F.when(again, F.lit(1000000000)).otherwise(F.lit(0))).alias("a_id"),
            "b_id",
            first.alias("company_a"),
            F.when(b_id % 97 == 0, ghost).otherwise(second).alias("company_b"),
            F.when(again, F.col("score") / 2).otherwise(F.col("score")).alias("score"),
        )
    )


def known_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored edges a sweep must not propose again."""
    base = graph_base(spark, sf_dir).filter(
        (F.col("a_id") * 31 + F.col("b_id") * 17) % 5 == 0
    )
    return _as_edges(base)


@derived
def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = pages.agg(F.count(F.lit(1)).alias("n_pages"))
    kind = F.col("event_type")
    slot = F.floor("value").cast("long") % 5
    split = literals(
        ["isolated mis-tag", "structural gap", "scraping artifact", "ambiguous", " "]
    )
    scraping = literals(
        ["ok", "blocking_page", "incomplete_content", "content_drowned_in_noise", "scrape_exception"]
    )
    who = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    joined = events.crossJoin(F.broadcast(n_pages)).withColumn(
        "page_id", F.col("user_id") % F.col("n_pages")
    ).join(pages, "page_id", "left")
    return joined.select(
        F.col("event_id").alias("id"),
        F.when(kind == "signup", "taxonomy_split")
        .when(kind == "error", "scraping_diagnostic")
        .when(kind == "click", "redundant_uncategorized_cleanup")
        .when(kind == "view", "empty_subsectors_backfill")
        .otherwise("not_a_real_type")
        .alias("review_type"),
        F.when(
            kind == "signup",
            F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")),
        )
        .when(kind == "error", F.col("url"))
        .otherwise(who)
        .alias("subject"),
        F.when(kind == "signup", F.get(split, slot.cast("int")))
        .when(kind == "error", F.get(scraping, slot.cast("int")))
        .otherwise("fixed")
        .alias("verdict"),
        F.col("ts").alias("date_diagnosed"),
        F.col("props").alias("source_snapshot"),
    )


@derived
def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best labels of a customer at each level, below those of the level above."""
    rows = (
        sold(spark, sf_dir)
        .groupBy("id", F.col("p_type").alias("sector"), F.col("p_brand").alias("brand"), "size")
        .agg(F.sum("q").alias("q"))
    )
    # quantities and places at each level; every window is within a customer
    of_sector, of_brand = W.partitionBy("id", "sector"), W.partitionBy("id", "sector", "brand")
    ranked = (
        rows.withColumn("brand_q", F.sum("q").over(of_brand))
        .withColumn("sector_q", F.sum("q").over(of_sector))
        .withColumn("pos", F.row_number().over(of_brand.orderBy(F.col("q").desc(), F.col("size"))))
        .withColumn(
            "brand_pos",
            F.dense_rank().over(of_sector.orderBy(F.col("brand_q").desc(), F.col("brand"))),
        )
        .withColumn(
            "sector_pos",
            F.dense_rank().over(
                W.partitionBy("id").orderBy(F.col("sector_q").desc(), F.col("sector"))
            ),
        )
    )
    none = F.lit(None).cast("string")
    sector, brand = F.col("sector"), F.col("brand")

    def confidence(pos):
        return ((F.col("id") * 13 + pos * 17 + F.length("sector")) % 30 + 70).cast("double") / 100

    def row(level: str, sector, subsector, label, pos, confidence):
        return F.struct(
            F.lit(level).alias("level"), sector.alias("sector"), subsector.alias("subsector"),
            label.alias("label"), pos.alias("pos"), confidence.alias("confidence"),
        )

    first = F.col("pos") == 1
    below = F.col("id").isNotNull() & sector.isNotNull() & (F.col("brand_pos") <= 3)
    invented = (F.col("id") % 19 == 0) & (F.col("brand_pos") == 3)
    found = F.array(
        F.when(
            first & (F.col("brand_pos") == 1),
            row(
                "sector", none, none, sector, F.col("sector_pos"),
                ((F.col("id") * 7 % 50 + 50).cast("double") / 100),
            ),
        ),
        F.when(
            first & below,
            row(
                "subsector", sector, none, F.when(invented, "Invented").otherwise(brand),
                F.col("brand_pos"), confidence(F.col("brand_pos")),
            ),
        ),
        F.when(
            (F.col("pos") <= 3) & below & brand.isin(*DEEP_BRANDS),
            row("sub_subsector", sector, brand, F.col("size"), F.col("pos"), confidence(F.col("pos"))),
        ),
    )
    return (
        ranked.filter("sector_pos <= 3")
        .select("id", F.explode(F.array_compact(found)).alias("x"))
        .select("id", "x.*")
    )


def raw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer replies as text, some of them unusable."""
    b = F.col("b_id")
    return edge_base(spark, sf_dir).select(
        "company_a",
        F.when(b % 41 == 0, F.concat(F.lit("Nobody#"), b.cast("string")))
        .otherwise(F.col("company_b"))
        .alias("name"),
        F.when(b % 29 == 0, "n/a")
        .when(b % 31 == 0, F.lit(None))
        .when(b % 37 == 0, "1.7")
        .otherwise(F.col("score").cast("string"))
        .alias("score"),
    )


@derived
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id").cast("string")

    def part(every: int, *pieces) -> object:
        return F.when(F.col("page_id") % every == 0, F.concat(*pieces)).otherwise("")

    markup = F.concat(
        part(3, F.lit('<link rel="icon" href="/f'), n, F.lit('.ico">')),
        part(6, F.lit('<link rel="apple-touch-icon" href="https://cdn.example.com/t'), n, F.lit('.png">')),
        part(4, F.lit('<img alt="Acme logo" data-src="lazy.png" src="img/logo'), n, F.lit('.svg">')),
        part(5, F.lit('<meta property="og:image" content="//img.example.com/og'), n, F.lit('.jpg">')),
        part(7, F.lit('<a class="x" href="https://www.LinkedIn.com/company/c'), n, F.lit('/">follow</a>')),
        part(13, F.lit("<p>Please enable JavaScript</p>")),
        part(17, F.lit("<p>{{ company.name }}</p>")),
    )
    return pages.select("page_id", "url", F.concat(markup, "html").alias("html"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )


def tag_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simple grouping of companies, (name, label), where any will do."""
    return company(spark, sf_dir).filter(
        (F.size("sectors") > 0) & (F.size("subsectors") > 0)
    ).select(
        "name",
        F.concat_ws("/", F.get("sectors", F.lit(0)), F.get("subsectors", F.lit(0))).alias("label"),
    )
