"""Fingerprints, the Jaccard join, components and top-k search against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagweave.llm import fingerprints, jaccard, metric_tree
from tagweave.llm.components import components
from tagweave.llm.shingles import hash_shingles, shingle_sets

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def shingles(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(f"[^{BLANKS}]+", folded)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def corpus(seed=1, groups=12, lone=60):
    """Texts with near copies of several strengths, chains, copies and shared passages."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(6))
    passage = [word() for _ in range(40)]
    texts = [None, "", " \n", "one", "One", "two  words", "two words", "a b c d", "a b c d e"]
    for _ in range(lone):
        body = [word() for _ in range(rnd.randint(1, 90))]
        texts.append(" ".join(body + passage if rnd.random() < 0.4 else body))
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(30, 120))]
        for _ in range(rnd.randint(1, 8)):
            near = list(base)
            for _ in range(rnd.randint(0, 3)):
                near[rnd.randrange(len(near))] = word()
            texts.append(" ".join(near + passage if rnd.random() < 0.3 else near))
            if rnd.random() < 0.5:
                base = near  # a chain
    texts += rnd.sample(texts[9:], 5)
    rnd.shuffle(texts)
    return [(3 * i + 7, t) for i, t in enumerate(texts)]


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for (doc_id, _), g in zip(docs, group, strict=True):
        if doc_id is not None:
            first[g] = min(first.get(g, doc_id), doc_id)
    return [(d, len(s), first.get(g)) for (d, _), s, g in zip(docs, sets, group, strict=True)]


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v or 0) for v in r))


def test_shingle_hashes_stand_for_shingles():
    texts = [t for _, t in corpus()] + ["x " * 50, "a\x0bb\x0cc d\re f", "Ä ä A a é"]
    array = pa.array(texts)
    seen = {}
    for low, bounds, hashes in shingle_sets(array):
        for i in range(len(bounds) - 1):
            own = hashes[bounds[i] : bounds[i + 1]]
            assert len(own) == len(shingles(texts[low + i]))
            seen[low + i] = set(own.tolist())
    for i in range(0, len(texts), 3):
        for j in range(i):
            common = len(shingles(texts[i]) & shingles(texts[j]))
            assert len(seen[i] & seen[j]) == common
    assert len(hash_shingles(np.zeros(0, np.uint8), np.zeros(3, int))[0]) == 0


def test_join_equals_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        table = spark.createDataFrame(
            [(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, token string"
        ).repartition(5)
        got = jaccard.near_duplicates(table).collect()
        assert _sorted(map(tuple, got)) == _sorted(brute(docs))


def test_join_of_repeated_and_null_ids(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = [
        (4, near), (4, near), (None, near + " 1"), (None, "none like this one in here"),
        (4, "another text under the same number"), (9, None), (None, None), (2, near + " 2"),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert _sorted(map(tuple, jaccard.near_duplicates(table).collect())) == _sorted(brute(docs))
    assert jaccard.near_duplicates(table.limit(0)).count() == 0


def test_join_of_a_large_group(spark):
    rnd = random.Random(5)
    base = [str(rnd.random()) for _ in range(200)]
    docs = []
    for i in range(400):
        near = list(base)
        near[rnd.randrange(200)] = f"w{i}"
        docs.append((i, " ".join(near)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in jaccard.near_duplicates(table).collect()} == {0}


def test_components_of_a_chain_a_star_and_a_loop(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    links = spark.createDataFrame([*chain, *star, (300, 301), (301, 300), (7, 7)], "a long, b long")
    got = {r.cls: r.comp for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300}
    assert components(links.limit(0)).count() == 0


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_DOCS", 7)
    docs = [*corpus(3), (1, "tail"), (2**60, "top")]
    table = spark.createDataFrame(
        [(d, t, 0, 0) for d, t in docs], "doc_id long, text string, part int, copy int"
    ).repartition(4)
    rows = {r.doc_id: r for r in fingerprints.edited_likeness(table).collect()}
    plain = {r.doc_id: r for r in fingerprints.fingerprints(table).collect()}
    order = sorted(docs, reverse=True)
    assert len(rows) == len(order)
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, r = text or "", after or "", rows[doc_id]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (
            len(text), hashlib.sha256(edited.encode()).hexdigest()
        )
        assert r.fingerprint == plain[doc_id].fingerprint
        sketches = fingerprints.sketches(pa.array([text, edited, after]))
        assert r.near_edited == fingerprints.likeness(sketches[0], sketches[1])
        assert r.near_next == fingerprints.likeness(sketches[0], sketches[2])
        assert 0 <= r.near_edited <= 1
        assert fingerprints.from_text(r.fingerprint).tolist() == sketches[0].tolist()
    assert fingerprints.edited_likeness(table.limit(0)).count() == 0


def test_fingerprints_of_repeated_rows_and_nulls(spark):
    table = spark.createDataFrame([(None, "a"), (None, None), (5, "b"), (5, "b")], "doc_id long, text string")
    rows = fingerprints.edited_likeness(table).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in rows) == [
        (False, 1), (False, 1), (True, 0), (True, 1),
    ]
    single = fingerprints.edited_likeness(table.limit(1)).collect()
    assert single[0].near_next == 1.0


def test_sketches_estimate_and_merge():
    rnd = random.Random(4)
    words = [str(rnd.random()) for _ in range(12_000)]
    whole, part = " ".join(words), " ".join(words[:3000])
    one, two = fingerprints.sketches(pa.array([whole, part]))
    assert abs(len(one) * fingerprints.SCALE / 12_000 - 1) < 0.1
    assert fingerprints.containment(two, one) == 1.0
    assert abs(fingerprints.likeness(one, two) - 0.25) < 0.05
    halves = fingerprints.sketches(pa.array([" ".join(words[:6000]), " ".join(words[5996:])]))
    assert fingerprints.merge(*halves).tolist() == one.tolist()
    tiny = fingerprints.sketches(pa.array(["one two", "three", "one two", None]))
    assert [len(x) for x in tiny] == [1, 1, 1, 0]


def _exact(one, two):
    sets = []
    for text in (one, two):
        words = text.split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    common = len(sets[0] & sets[1])
    return common / len(sets[0] | sets[1]), common / len(sets[0])


def test_sketches_of_short_texts_are_near_the_exact_values():
    rnd = random.Random(12)
    like, inside, unknown = [], [], 0
    for _ in range(300):
        words = [str(rnd.random()) for _ in range(rnd.randint(10, 100))]
        cut = len(words) // rnd.randint(2, 6)
        edited = words[: len(words) - cut] + [str(rnd.random()) for _ in range(cut)]
        # a long text that holds all of the short one, or the first part of it
        held = words if rnd.random() < 0.5 else words[: len(words) - cut]
        rest = [str(rnd.random()) for _ in range(1500)]
        texts = [" ".join(x) for x in (words, edited, rest[:700] + held + rest[700:])]
        one, two, long = fingerprints.sketches(pa.array(texts))
        like.append(abs(fingerprints.likeness(one, two) - _exact(texts[0], texts[1])[0]))
        found = fingerprints.containment(one, long)
        if found is None:
            unknown += 1
            continue
        exact = _exact(texts[0], texts[2])[1]
        assert exact < 1 or found == 1.0
        inside.append(abs(found - exact))
    assert np.mean(np.array(like) > 0.2) < 0.01 and np.mean(like) < 0.02
    assert np.mean(np.array(inside) > 0.3) < 0.03 and np.mean(inside) < 0.06
    assert unknown < 6


def test_containment_is_unknown_where_nothing_is_kept():
    long = fingerprints.sketches(pa.array([" ".join(map(str, range(3000)))]))[0]
    above = np.array([2**64 - 2**20], np.uint64)
    assert fingerprints.containment(above, long) is None
    assert fingerprints.likeness(above, long) == 0.0


def test_search_equals_brute_force(spark):
    rnd = np.random.default_rng(6)
    centres = rnd.normal(0, 3, (5, 8))
    vectors = [
        (i, (centres[i % 5] + rnd.normal(0, 0.5, 8)).astype(float).tolist()) for i in range(700)
    ]
    vectors += [(700 + i, [1.0] * 8) for i in range(200)]  # ties
    odd = [(901, None), (902, [None] + [1.0] * 7), (903, [float("nan")] * 8),
           (904, [float("inf")] * 8), (None, [2.0] * 8), (905, [])]
    table = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    table = table.repartition(4).select(
        "vec_id", metric_tree.quantised(F.col("embedding")).alias("v"), F.lit(1).alias("shard")
    )
    pages = metric_tree.index(table, shard_vectors=200)
    got = metric_tree.top_k(pages, table.filter("vec_id % 50 = 0"), 10).collect()
    ids = np.array([i for i, _ in vectors])
    whole = np.floor(1024 * np.array([v for _, v in vectors])).astype(np.int64)
    expected = []
    for q in range(0, 900, 50):
        score = whole @ whole[q]
        best = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if i != q)[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == expected
    few = table.filter("vec_id < 3")
    assert metric_tree.top_k(metric_tree.index(few), few).count() == 6
    none = table.limit(0)
    assert metric_tree.top_k(metric_tree.index(none), none).count() == 0


def test_search_passes_over_pages():
    rnd = np.random.default_rng(7)
    vectors = np.concatenate([rnd.normal(c, 1, (500, 4)) for c in (-60, 0, 60)]).round() * 8
    pages = metric_tree.build(np.arange(1500), vectors)
    looked = []

    class Counted(dict):
        def __getitem__(self, key):
            if key == "leaf" and super().__getitem__("leaf"):
                looked.append(1)
            return super().__getitem__(key)

    found = metric_tree.search([Counted(p) for p in pages], None, vectors[3], 10)
    best = sorted((-s, i) for i, s in enumerate((vectors @ vectors[3]).astype(int).tolist()))[:10]
    assert found == [(-s, i) for s, i in best]
    assert len(looked) < sum(p["leaf"] for p in pages) / 2
