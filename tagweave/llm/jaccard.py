"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Documents with equal shingle sets are one class. Two classes with at least the wanted
similarity share many tokens (shingle hashes), and therefore, in any fixed token order,
at least l tokens among the first n - ceil(t * n) + l of each, for any l. That makes
the join in two steps, both exact:

1. Screen: in hash order, with l a fixed share of the set, a set that has fewer than l
   prefix tokens in common with all others together has no partner and is finished.
2. Join: the remaining classes order their tokens by rising frequency. Each lengthens
   its prefix as long as that lowers its estimated cost, and needs as many more common
   prefix tokens before a pair is verified.

Connected groups need no pair twice: before all pairs of a token's classes are looked
at, each class is compared with one class of the token, for a few choices of that one,
and classes that are connected by then are not paired again. So a group of thousands of
near copies costs rows in proportion to its size, and no link between different groups
is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.llm.components import components
from tagweave.llm.shingles import mix64, shingle_sets
from tagweave.llm.store import durable

PERCENT = 80  # 100 * intersection >= PERCENT * union
SCREEN_SHARE = 12  # the screen asks for n / SCREEN_SHARE common prefix tokens
FLUSH_TOKENS = 250_000  # tokens that a scanning task holds
BUCKET_TOKENS = 250_000  # expected tokens of a bucket of the screen
TEXT_BYTES_PER_TOKEN = 20  # at least, for a prefix token of the screen
STARS = 3  # rounds of comparisons with one class of each token
MAX_EXTRA = 8  # tokens by which a prefix may be lengthened
COUNT_COST, VERIFY_COST = 1.0, 20.0  # of counting a pair once, of verifying it
BITMAP_BITS = 1024  # of the bitmaps that rule pairs out before they are formed
BROADCAST_KEYS = 2_000_000  # screened sets whose keys are sent to all tasks


def _least_overlap(n, percent: int = PERCENT):
    """Common tokens that a set of n shares with any partner, at least."""
    return -(-n * percent // 100)


def _signatures(bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set; 0 for an empty one."""
    out = []
    sizes = np.diff(bounds)
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix64(hashes ^ np.uint64(salt)), out=sums[1:])
        total = sums[bounds[1:]] - sums[bounds[:-1]]
        out.append(np.where(sizes > 0, mix64(total + np.uint64(salt)), 0).view(np.int64))
    return out[0], out[1]


def _screen(docs: DataFrame, percent: int) -> DataFrame:
    """Keys (first signatures) of the sets that may have a partner of another key or
    another row, with every set that has one among them."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 256
    while buckets * BUCKET_TOKENS < size // TEXT_BYTES_PER_TOKEN:
        buckets *= 2
    mask = np.uint64(buckets - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefix tokens by bucket; tokens met twice here are marked as common, and only
        their first row asks the other tasks."""
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            token, key, need = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(token, kind="stable")
            token, key, need = token[order], key[order], need[order]
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            run = np.flatnonzero(first)
            many = np.diff(np.append(run, len(token))) > 1
            local = np.repeat(many, np.diff(np.append(run, len(token))))
            # common already here: a number for each set, no question
            owners, at, counts = np.unique(key[local], return_index=True, return_counts=True)
            known = {
                "bucket": [-1],
                "tokens": [counts.astype("<i8").tobytes()],
                "keys": [owners.astype("<i8").tobytes()],
                "needs": [need[local][at].astype("<i4").tobytes()],
                "seen": [b""],
            }
            # prefix tokens are small hashes, so their low bits spread them
            bucket = (token[run] & mask).astype(np.int64)
            spread = np.argsort(bucket, kind="stable")
            bucket, many, run = bucket[spread], many[spread], run[spread]
            token, key, need = token[run], key[run], need[run]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
            parts = list(zip(cuts[:-1], cuts[1:], strict=True))
            asked = {
                "bucket": bucket[cuts[:-1]].tolist(),
                "tokens": [token[a:b].tobytes() for a, b in parts],
                "keys": [key[a:b].astype("<i8").tobytes() for a, b in parts],
                "needs": [need[a:b].astype("<i4").tobytes() for a, b in parts],
                "seen": [many[a:b].tobytes() for a, b in parts],
            }
            return pa.RecordBatch.from_pydict({k: known[k] + asked[k] for k in known}, _DEALT)

        tokens = 0
        for batch in batches:
            for _, bounds, hashes in shingle_sets(batch.column(0)):
                key, _ = _signatures(bounds, hashes)
                n = np.diff(bounds)
                least = _least_overlap(n, percent)
                need = np.minimum(np.maximum(1, n // SCREEN_SHARE), least)
                length = np.where(n > 0, n - least + need, 0)
                place = np.arange(len(hashes)) - np.repeat(bounds[:-1], n)
                chosen = place < np.repeat(length, n)
                held.append(
                    (hashes[chosen], np.repeat(key, length), np.repeat(need, length))
                )
                tokens += int(chosen.sum())
                if tokens >= FLUSH_TOKENS:
                    yield flush()
                    tokens = 0
        if tokens:
            yield flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many common tokens the sets of a bucket have in it."""
        held: list[tuple[pa.Buffer, ...]] = []
        at = None

        def common() -> pa.RecordBatch:
            joined = [b"".join(column) for column in zip(*held, strict=True)]
            held.clear()
            token = np.frombuffer(joined[0], "<u8")
            key = np.frombuffer(joined[1], "<i8")
            need = np.frombuffer(joined[2], "<i4")
            if at < 0:
                counts = token.astype(np.int64)
            else:
                seen = np.frombuffer(joined[3], bool)
                _, inverse, times = np.unique(token, return_inverse=True, return_counts=True)
                # a token seen twice by its sender is counted there already
                new = (times[inverse] > 1) & ~seen
                key, first, counts = np.unique(key[new], return_index=True, return_counts=True)
                need = need[new][first]
            return pa.RecordBatch.from_pydict({"key": key, "need": need, "n": counts}, _COMMON)

        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if held and (bucket != at or at < 0):
                    yield common()
                at = bucket
                held.append(tuple(batch.column(c)[i].as_buffer() for c in range(1, 5)))
        if held:
            yield common()

    dealt = docs.select("text").mapInArrow(deal, _ddl(_DEALT))
    # a bucket's rows together; the senders' own counts go anywhere
    placed = dealt.withColumn(
        "_salt", F.when(F.col("bucket") < 0, F.xxhash64("keys")).otherwise(0)
    )
    return (
        placed.repartition("bucket", "_salt")
        .sortWithinPartitions("bucket")
        .drop("_salt")
        .mapInArrow(answer, _ddl(_COMMON))
        .groupBy("key")
        .agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        .filter("n >= need")
        .select("key")
    )


_DEALT = pa.schema(
    [("bucket", pa.int64())] + [(c, pa.binary()) for c in ("tokens", "keys", "needs", "seen")]
)
_COMMON = pa.schema([("key", pa.int64()), ("need", pa.int32()), ("n", pa.int64())])
_BITMAPS = pa.schema([("cls", pa.int64()), ("bits", pa.list_(pa.int64()))])
def _ddl(schema: pa.Schema) -> str:
    kinds = {
        pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string",
        pa.list_(pa.int64()): "array<long>",
    }
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key and key2 (signatures) and tokens of each row of ``docs``."""
    kind = pa.string() if dict(docs.dtypes)["doc_id"] == "string" else pa.int64()
    schema = pa.schema(
        [("doc_id", kind), ("n_shingles", pa.int64()), ("key", pa.int64()),
         ("key2", pa.int64()), ("tokens", pa.list_(pa.int64()))]
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, bounds, hashes in shingle_sets(batch.column(1)):
                key, key2 = _signatures(bounds, hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(key)).cast(kind),
                        pa.array(np.diff(bounds)),
                        pa.array(key),
                        pa.array(key2),
                        pa.ListArray.from_arrays(
                            pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64))
                        ),
                    ],
                    schema=schema,
                )

    return docs.mapInArrow(each, _ddl(schema))


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """(cls, n, lone, need, token, place): the adaptive prefix of each class in its token
    order, tokens of one class only left out; ``lone`` is how many of those it has."""
    rows = classes.select("cls", "n", F.explode("tokens").alias("token"))
    times = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    common = rows.join(times, "token")
    per = W.partitionBy("cls")
    spot = W.partitionBy("cls").orderBy("df", "token")
    least = F.expr(f"(n * {percent} + 99) div 100")
    # tokens of one class only come first in the order and have no candidates
    ranked = common.select(
        "*",
        (F.col("n") - F.count(F.lit(1)).over(per)).alias("lone"),
        (F.col("n") - F.count(F.lit(1)).over(per) + F.row_number().over(spot)).alias("place"),
        (F.col("n") - least).alias("base"),
        least.alias("least"),
        F.sum(F.col("df") - 1).over(spot.rowsBetween(W.unboundedPreceding, 0)).alias("met"),
    ).filter(F.col("place") <= F.col("base") + F.least(F.lit(MAX_EXTRA), "least"))
    # at most met / l pairs have l of these tokens in common
    extra = F.col("place") - F.col("base")
    cost = F.col("met") * (COUNT_COST + VERIFY_COST / extra)
    best = (
        ranked.groupBy("cls")
        .agg(
            F.min(F.when(extra > 0, F.struct(cost.alias("cost"), extra.alias("need")))).alias("b"),
            F.min(extra).alias("first"),
        )
        # no common token among the first base + 1 means no partner
        .filter("first <= 1")
        .select("cls", "b.need")
    )
    return (
        ranked.join(best, "cls")
        .filter(F.col("place") <= F.col("base") + F.col("need"))
        .select("cls", "n", "lone", "need", "token", "place")
    )


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough, by their whole sets."""
    one = classes.select(F.col("cls").alias("a"), F.col("tokens").alias("tokens_a"))
    two = classes.select(F.col("cls").alias("b"), F.col("tokens").alias("tokens_b"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - common
    return (
        pairs.join(one, "a").join(two, "b").filter(100 * common >= percent * union).select("a", "b")
    )


def _sizes_fit(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _labelled(prefixes: DataFrame, links: DataFrame | None) -> DataFrame:
    """Prefix rows with the component that each class is in by the links so far."""
    if links is None:
        return prefixes.withColumn("comp", F.col("cls"))
    return prefixes.join(components(links), "cls", "left").withColumn(
        "comp", F.coalesce("comp", "cls")
    )


def _star(rows: DataFrame, star: int, percent: int) -> DataFrame:
    """Pairs of each class with one class of near size for each of its tokens.

    First the one with the smallest share of tokens of its own, which is the likeliest
    hub of a group of near copies; later ones by a hash, with other limits of sizes.
    """
    step = math.log(100 / percent)
    band = F.floor(F.ln("n") / step + star / STARS).cast("int")
    order = F.col("lone") / F.col("n") if star == 0 else F.lit(0.0)
    heads = rows.groupBy("token", band.alias("band")).agg(
        F.min(
            F.struct(order.alias("o"), F.xxhash64(F.lit(star), "cls").alias("h"), "cls", "comp", "n")
        ).alias("head"),
        F.min("comp").alias("low"), F.max("comp").alias("high"),
    ).filter("low < high")
    return (
        rows.withColumn("band", band)
        .join(heads, ["token", "band"])
        .filter(F.col("comp") != F.col("head.comp"))
        .filter(_sizes_fit("n", "head.n", percent))
        .select(F.least("cls", "head.cls").alias("a"), F.greatest("cls", "head.cls").alias("b"))
        .distinct()
    )


def _bitmaps(classes: DataFrame) -> DataFrame:
    """(cls, bits): for each of BITMAP_BITS token values whether the class has an odd
    number of such tokens. Two bitmaps differ in at most as many bits as the sets differ
    in tokens."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for tokens in batch.column(1):
                values = np.asarray(tokens.values).view(np.uint64) % np.uint64(BITMAP_BITS)
                odd = np.bincount(values.astype(np.int64), minlength=BITMAP_BITS) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
            yield pa.RecordBatch.from_pydict({"cls": batch.column(0), "bits": bits}, _BITMAPS)

    return classes.select("cls", "tokens").mapInArrow(fold, _ddl(_BITMAPS))


def _open_pairs(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Every pair of classes of different components that the prefixes allow.

    The first l common tokens of a similar pair leave room for the wanted overlap behind
    them in both sets, so a common token counts only where that room is, and where the
    bitmaps do not differ in more bits than the sets may in tokens.
    """
    apart = (
        rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        .filter("low < high").select("token")
    )
    rows = rows.join(apart, "token", "left_semi").withColumn("room", F.expr("n - place"))
    rows = durable(rows, "open-rows")
    asked = classes.join(rows.select("cls").distinct(), "cls", "left_semi")
    words = [F.get("bits", F.lit(i)).alias(f"w{i}") for i in range(BITMAP_BITS // 64)]
    rows = rows.join(durable(_bitmaps(asked), "bitmaps").select("cls", *words), "cls")
    columns = ("cls", "comp", "n", "need", "room", *[f"w{i}" for i in range(len(words))])
    one = rows.select("token", *[F.col(c).alias(f"{c}_a") for c in columns])
    two = rows.select("token", *[F.col(c).alias(f"{c}_b") for c in columns])
    need = F.least("need_a", "need_b")
    wanted = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    differing = reduce(
        add, [F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(len(words))]
    )
    return (
        one.join(two, "token")
        .filter("cls_a < cls_b and comp_a <> comp_b")
        .filter(F.least("room_a", "room_b") + need >= wanted)
        .filter(differing <= F.col("n_a") + F.col("n_b") - 2 * wanted)
        .filter(_sizes_fit("n_a", "n_b", percent))
        .groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
        .agg(F.count(F.lit(1)).alias("m"), F.first(need).alias("need"))
        .filter("m >= need")
        .select("a", "b")
    )


def similar_classes(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect the classes (cls, n, tokens) as all pairs with at least
    ``percent`` similarity do. Pairs inside a component may be left out where others
    connect it."""
    prefixes = durable(_prefixes(classes, percent), "prefixes")
    links = None
    for star in range(STARS):
        met = _star(_labelled(prefixes, links), star, percent)
        found = durable(_verified(met, classes, percent), "star-links")
        links = found if links is None else links.unionByName(found)
    # what is not connected yet: every pair with enough common prefix tokens
    rows = durable(_labelled(prefixes, links), "labelled")
    return links.unionByName(
        durable(_verified(_open_pairs(rows, classes, percent), classes, percent), "links")
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text), whose
    doc_ids are whole numbers or strings.

    ``component_id`` is the smallest doc_id that links reach, the row's own included.
    Null and wordless texts have no shingles and link with nothing, so their
    component_id is their own doc_id. Rows with a null doc_id take part in links; their
    component_id is null if no reachable row has a doc_id. Repeated rows are kept.
    """
    named = dict(docs.dtypes)["doc_id"] == "string"
    base = docs.select("doc_id" if named else F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = durable(_screen(base, percent), "screened")
    few = keys.count() <= BROADCAST_KEYS
    # tokens are kept of the screened sets only
    marked = keys.withColumn("_kept", F.lit(True))
    sets = _sets(base).join(
        F.broadcast(marked) if few else marked, "key", "left"
    )
    sets = durable(
        sets.select(
            "doc_id", "n_shingles", "key", "key2", F.monotonically_increasing_id().alias("row"),
            F.when(F.col("_kept"), F.col("tokens")).alias("tokens"),
        ),
        "sets",
    )
    same = ["n_shingles", "key", "key2"]
    classes = durable(
        sets.filter("n_shingles > 0").groupBy(*same)
        .agg(
            F.min("row").alias("cls"), F.min("doc_id").alias("first_doc"),
            F.max(F.col("tokens").isNotNull()).alias("_kept"),
        ),
        "classes",
    )
    # the screen knows no classes, so copies of one set may be all that it found
    joined = durable(
        sets.filter(F.col("tokens").isNotNull())
        .join(classes.filter("_kept").select(F.col("cls").alias("row")), "row", "left_semi")
        .select(F.col("row").alias("cls"), F.col("n_shingles").alias("n"), "tokens"),
        "class-sets",
    )
    links = similar_classes(joined, percent)
    groups = components(links)
    firsts = (
        classes.join(groups, "cls", "left")
        .withColumn("comp", F.coalesce("comp", "cls"))
        .select(*same, "comp", "first_doc")
    )
    smallest = firsts.groupBy("comp").agg(F.min("first_doc").alias("component_id"))
    found = firsts.join(smallest, "comp").select(*same, "component_id")
    return sets.select("doc_id", *same).join(found, same, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id"))
        .otherwise(F.col("doc_id")).alias("component_id"),
    )
