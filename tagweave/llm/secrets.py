"""Secret scanning: candidate strings judged by a random forest.

Candidates are runs of key-like characters, runs that begin with a known key format, and
whatever is assigned to a secret word. A forest trained on labelled findings tells
secrets from false positives by the candidate's length, its character transitions, the
share of it that dictionary words cover, the path it was found under, and the words
beside it. The dictionary is the frequent words of the whole corpus.

Everything is DataFrame and SQL work; candidates of a text and the text between them
come from one pass of one pattern each.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.llm.store import durable, unused

# fixed values: public formats of access keys, and words beside keys and beside digests
KNOWN_FORMATS = (
    "^(AKIA|ASIA)[A-Z0-9]{16}$",
    "^gh[pousr]_[A-Za-z0-9]{36,}$",
    "^xox[abprs]-[A-Za-z0-9-]{10,}$",
    "^[sr]k_(live|test)_[A-Za-z0-9]{16,}$",
    "^AIza[A-Za-z0-9_-]{35}$",
)
SECRET_WORDS = "secret|token|passw|pwd|passphrase|api.?key|access.?key|auth|credential|private"

_KEY = "A-Za-z0-9+/_\\-"
# what a secret word is followed by before its value
_ASSIGNED = "[^\\s:=]{0,12}[ \\t]{0,3}[:=]{1,3}>?[ \\t]{0,3}[\"'`]?"
# a value up to a blank, a quote, a further URL parameter or punctuation that ends a clause
_VALUE = (
    "(?![:=>])(?:(?:[,;.:)\\]}]++|&(?!\\w{1,40}=))*+[^\\s\"'`<>&,;.:)\\]}]++)++"
)
_PREFIXES = "|".join(p.removeprefix("^").removesuffix("$") for p in KNOWN_FORMATS)
# a run that begins with a known format; whatever is assigned to a secret word; at least 16
# key characters with a digit or letters of both cases among them, or capitals alone
CANDIDATE = (
    f"(?<![\\p{{L}}{_KEY}])(?:"
    f"(?:{_PREFIXES})[{_KEY}]*+(?!\\p{{L}})"
    f"|(?<=[:=>\"'`\\t ])(?<=[:=]>?[ \\t]{{0,3}}[\"'`]?)(?<=(?i:{SECRET_WORDS}){_ASSIGNED}){_VALUE}"
    f"|(?:(?=[A-Za-z+/_\\-]*+[0-9]|[A-Z0-9+/_\\-]*+[a-z][a-z0-9+/_\\-]*+[A-Z]"
    f"|[a-z0-9+/_\\-]*+[A-Z][A-Z0-9+/_\\-]*+[a-z])[{_KEY}]{{16,}}+|[A-Z]{{16,}}+)"
    f"(?![\\p{{L}}{_KEY}]))"
)
CONTEXT_CHARS = 40  # characters kept on either side of a candidate
DICTIONARY_SHARE = 1e-5  # of all words, for a word to be in it; bounds it to 100,000
WORD_TIMES = 3
TRAIN_FINDINGS = 20_000  # expected labelled findings used: the bound of the sample
SEED_FINDINGS = 200  # generated findings of each kind that join them
TREES, DEPTH, SEED = 24, 6, 11
THRESHOLD = 0.5
REDACTED = "[secret]"

BENIGN_WORDS = (
    "example|sample|dummy|placeholder|checksum|digest|sha1|sha256|md5|commit|revision|uuid|"
    "guid|isbn|build|version|phone|card"
)
BENIGN_PATHS = "test|spec|example|sample|fixture|mock|doc|vendor|node_modules|lock"

FEATURES = (
    "length", "transitions", "digits", "uppers", "lowers", "vowels", "marks", "variety", "hex",
    "coverage", "inside_path", "benign_path", "assigned", "quoted", "secret_word", "benign_word", "known",
)


def _parts(text: Column) -> tuple[Column, Column]:
    """(candidates of a text, the text before, between and after them)"""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)


def _key(path: Column) -> Column:
    """Names a text under a path: equal rows have equal findings."""
    return F.md5(F.concat_ws("\0", F.coalesce(path, F.lit("")), F.col("text")))


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Distinct (key, finding, start, value, before, after, path) of the texts of ``docs``.

    ``finding`` counts a text's candidates from 0 and ``start`` is the code point where
    it begins, from 0.
    """
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    found, between = _parts(F.col("text"))
    rows = (
        docs.filter(F.col("text").rlike(CANDIDATE))
        .select(_key(where).alias("key"), where.alias("path"), found.alias("f"), between.alias("b"))
        .select(
            "key", "path",
            F.posexplode(
                F.zip_with(
                    F.col("f"),
                    F.transform(
                        F.col("b"),
                        lambda x: F.struct(
                            F.length(x).alias("n"),
                            F.substring(x, -CONTEXT_CHARS, CONTEXT_CHARS).alias("end"),
                            F.substring(x, 1, CONTEXT_CHARS).alias("begin"),
                        ),
                    ),
                    lambda f, b: F.struct(f.alias("value"), b.alias("side")),
                )
            ).alias("finding", "x"),
        )
        .select("key", "path", "finding", "x.value", "x.side")
        .distinct()
    )
    per = W.partitionBy("key").orderBy("finding")
    before = per.rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("after", F.lead("side.begin").over(per))
        .withColumn(
            "start",
            F.sum(F.col("side.n") + F.coalesce(F.length("value"), F.lit(0))).over(before)
            - F.coalesce(F.length("value"), F.lit(0)),
        )
        .filter(F.col("value").isNotNull())
        .select(
            "key", "path", "finding", "start", "value",
            F.col("side.end").alias("before"), F.coalesce("after", F.lit("")).alias("after"),
        )
    )


def dictionary(docs: DataFrame) -> DataFrame:
    """The words of three to twelve letters, next to no digit, with at least DICTIONARY_SHARE
    of all such words of ``docs`` and WORD_TIMES occurrences: pieces of keys are no words."""
    words = docs.select(
        F.explode(
            F.filter(
                F.split(F.lower("text"), "[^a-z0-9]+"),
                lambda w: F.length(w).between(3, 12) & ~w.rlike("[0-9]"),
            )
        ).alias("word")
    )
    counts = durable(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return durable(
        counts.filter(F.col("n") >= max(WORD_TIMES, total * DICTIONARY_SHARE)).select("word"),
        "dictionary",
    )


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the columns FEATURES added."""
    keys = ["key", "finding"]
    covered = (
        found.select(
            *keys, F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0)))
        )
        .join(words.withColumnRenamed("word", "col"), "col")
        .groupBy(*keys)
        .agg(F.sum(F.length("col")).alias("covered"))
    )
    value, n = F.col("value"), F.length("value")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / n

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    near = F.lower(F.concat_ws(" ", "before", "after"))
    return found.join(covered, keys, "left").select(
        *found.columns,
        n.cast("double").alias("length"),
        share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])").alias("transitions"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        share("[a-z]").alias("lowers"),
        share("[aeiouAEIOU]").alias("vowels"),
        share("[^A-Za-z0-9]").alias("marks"),
        (F.size(F.array_distinct(F.split(value, ""))) / n).alias("variety"),
        flag(value.rlike("^[0-9a-f]+$")).alias("hex"),
        (F.coalesce("covered", F.lit(0)) / n).alias("coverage"),
        flag(value.contains("/") | F.col("before").rlike("[/.@]$")).alias("inside_path"),
        flag(F.lower("path").rlike(BENIGN_PATHS)).alias("benign_path"),
        flag(F.col("before").rlike("[:=]>?\\s*[\"'`]?$")).alias("assigned"),
        flag(F.col("after").rlike("^[\"'`]")).alias("quoted"),
        flag(F.lower("before").rlike(f"({SECRET_WORDS})[^\\s]{{0,12}}\\s*[:=]?>?\\s*[\"'`]?$")).alias(
            "secret_word"
        ),
        flag(near.rlike(f"\\b({BENIGN_WORDS})\\b")).alias("benign_word"),
        flag(value.rlike("|".join(KNOWN_FORMATS))).alias("known"),
    )


def labels(found: DataFrame) -> Column:
    """What is known of a finding by itself: 1 a secret, 0 not one, null undecided."""
    # a value given to a secret word needs no digit, if it is no word either
    given = (F.col("secret_word") == 1) & (F.col("assigned") == 1) & (F.col("coverage") <= 0.5)
    odd = F.col("value").rlike("[^A-Za-z0-9._-]") | (
        F.col("value").rlike("[a-z]") & (F.col("uppers") > 0) & (F.col("transitions") >= 0.3)
    )
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1)
    return (
        F.when(F.col("known") == 1, 1.0)
        .when(given & (F.col("benign_word") == 0) & (F.col("digits") == 0) & odd, 1.0)
        .when(given & F.col("digits").isin(0.0, 1.0), None)
        .when(F.col("digits").isin(0.0, 1.0) | (F.col("coverage") > 0.5), 0.0)
        .when((F.col("benign_word") == 1) & (F.col("secret_word") == 0), 0.0)
        .when((F.col("secret_word") == 1) & mixed, 1.0)
        .when((F.col("inside_path") == 1) & (F.col("assigned") == 0), 0.0)
    )


def seed_findings(spark: SparkSession) -> DataFrame:
    """Generated findings of both kinds, so that a corpus with few has a forest too."""
    i = F.col("id").cast("string")
    digest = F.sha2(i, 256)
    capitals = F.upper(F.translate(F.sha2(F.concat(i, F.lit("k")), 256), "0123", "GHQZ"))
    letters = F.translate(digest, "0123456789abcdef", "GkQzRxTmWbPvXcJn")
    odd = F.translate(digest, "0123456789abcdef", "aR7$kQ!x9mZ#t2@W")
    kinds = [
        # value, text before, text after, label
        (F.substring(digest, 1, 40), F.lit('token = "'), F.lit('"'), 1.0),
        (F.substring(digest, 3, 18), F.lit("password="), F.lit(" "), 1.0),
        (F.substring(letters, 1, 16), F.lit('secret: "'), F.lit('"'), 1.0),
        (F.substring(letters, 9, 20), F.lit("api_key="), F.lit(" "), 1.0),
        (F.substring(letters, 17, 16), F.lit("of "), F.lit(" "), 1.0),
        (F.substring(odd, 1, 8), F.lit("password="), F.lit(" "), 1.0),
        (F.substring(odd, 11, 11), F.lit("pwd: '"), F.lit("'"), 1.0),
        (F.concat(F.lit("sk_live_"), F.substring(letters, 3, 16)), F.lit("of "), F.lit(" "), 1.0),
        (F.concat(F.lit("xoxb-"), F.substring(letters, 5, 10)), F.lit("of "), F.lit(" "), 1.0),
        (F.concat(F.lit("AKIA"), F.substring(capitals, 5, 16)), F.lit("of "), F.lit(" "), 1.0),
        (F.substring(digest, 1, 40), F.lit("commit "), F.lit(" "), 0.0),
        (F.substring(F.translate(digest, "abcdef", "123456"), 1, 16), F.lit("card "), F.lit(" "), 0.0),
        (F.concat(F.lit("chapter-of-the-story-"), i), F.lit("example.com/"), F.lit("/"), 0.0),
    ]
    # shouted words of a few syllables
    syllables = F.array(*[F.lit(x) for x in "THE AND BER ION QUE LER ATE OUS".split()])
    digits = F.transform(F.split(F.substring(digest, 1, 6), ""), lambda c: F.ascii(c) % 8)
    words = F.array_join(F.transform(digits, lambda d: F.get(syllables, d)), "")
    kinds.append((words, F.lit("! "), F.lit("! "), 0.0))
    # words with a capital, compounds and names of several, also after a secret word
    pairs = F.array_join(F.transform(digits, lambda d: F.initcap(F.get(syllables, d))), "")
    kinds.append((F.initcap(words), F.lit("of "), F.lit(" "), 0.0))
    kinds.append((pairs, F.lit("of "), F.lit(" "), 0.0))
    short = F.substring(F.lower(words), 1, 7)
    kinds.append((short, F.lit("the secret: "), F.lit(" "), 0.0))
    kinds.append((F.initcap(short), F.lit("Author: "), F.lit(" "), 0.0))
    each = spark.range(SEED_FINDINGS)
    out = None
    for number, (value, before, after, label) in enumerate(kinds):
        rows = each.select(
            F.concat(F.lit(f"seed-{number}-"), i).alias("key"),
            F.lit(None).cast("string").alias("path"),
            F.lit(0).alias("finding"), F.lit(0).cast("long").alias("start"),
            value.alias("value"), before.alias("before"), after.alias("after"),
            F.lit(label).alias("label"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """A forest for rows with the columns FEATURES and label, of which at most about
    TRAIN_FINDINGS are used, drawn by a hash of the finding."""
    total = labelled.count()
    draw = F.pmod(F.xxhash64("key", "finding"), F.lit(1 << 20))
    rows = labelled.filter(draw < int((1 << 20) * min(1.0, TRAIN_FINDINGS / max(1, total))) + 1)
    # the sample is bounded; one sorted partition makes the forest repeatable
    rows = rows.repartition(1).sortWithinPartitions("key", "finding")
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED
    )
    return forest.fit(_vectors(rows).select("label", "features"))


def scan(
    docs: DataFrame, path: str | None = None, labelled: DataFrame | None = None
) -> DataFrame:
    """Judged candidates of the texts of ``docs``: key, finding, start, value, score and
    is_secret.

    ``labelled`` may hold findings with a label column (1 secret, 0 not) in the columns of
    ``candidates``; without it, findings that public key formats and the words beside them
    decide are the labelled ones. Generated findings join either. Null, empty and
    candidate-free texts have no rows; equal texts under one path have one set of rows.
    """
    spark = docs.sparkSession
    words = dictionary(docs)
    found = durable(features(durable(candidates(docs, path), "candidates"), words), "findings")
    seeds = features(seed_findings(spark), words)
    columns = ["key", "finding", *FEATURES, "label"]
    if labelled is None:
        known = found.withColumn("label", labels(found)).filter(F.col("label").isNotNull())
    else:
        known = features(labelled, words)
    model = train(durable(known.select(*columns).unionByName(seeds.select(*columns)), "labelled"))
    judged = model.transform(_vectors(found))
    score = vector_to_array("probability")[1]
    return durable(
        judged.select(
            "key", "finding", "start", "value", score.alias("score"),
            (score >= THRESHOLD).alias("is_secret"),
        ),
        "judged",
    )


def findings(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every candidate of every row of ``docs``: doc_id, finding, start, length,
    value_sha256, score and is_secret. Copies of a text are listed for each doc_id."""
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    rows = docs.filter(F.col("text").rlike(CANDIDATE)).select("doc_id", _key(where).alias("key"))
    return rows.join(scan(docs, path), "key").select(
        "doc_id", "finding", "start", F.length("value").alias("length"),
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "is_secret",
    )


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with each secret in text replaced by REDACTED; all rows and columns are
    kept, and n_chars, if there is one, follows the new text."""
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    key, hits = unused(docs, "_key", "_hits")
    secrets = (
        scan(docs, path).filter("is_secret").groupBy(F.col("key").alias(key))
        .agg(F.collect_set("finding").alias(hits))
    )
    # the many texts without a candidate stay where they are
    suspect = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    marked = docs.filter(suspect).withColumn(key, _key(where)).join(secrets, key, "left")
    found, between = _parts(F.col("text"))
    shown = F.transform(
        found,
        lambda c, i: F.when(F.array_contains(hits, i), F.lit(REDACTED)).otherwise(c),
    )
    whole = F.array_join(
        F.zip_with(between, shown, lambda b, c: F.concat(b, F.coalesce(c, F.lit("")))), ""
    )
    out = marked.withColumn("text", F.when(F.col(hits).isNotNull(), whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast("long")
        out = out.withColumn(
            "n_chars", F.when(F.col(hits).isNotNull(), length).otherwise(F.col("n_chars"))
        )
    return docs.filter(~suspect).unionByName(out.select(*docs.columns))
