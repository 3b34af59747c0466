"""The mix of sources against a plain computation and the properties of the method."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagweave.llm import mixing
from tagweave.llm.queries import op12_source_mix

SCHEMA = "doc_id long, source string, text string, row int, size string"


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, held down and shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        spread = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / spread for s in names}
        above = {s for s in names if target[s] > most * sizes[s] + 1e-9 * total}
        if not above:
            return target
        full |= above


def check(rows, got, block_slack=1):
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = plain_targets(sizes)
    want = sorted(
        (str(d), len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), sizes[s], round(target[s], 6))
        for d, s, t in rows
    )
    have = sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6)) for r in got)
    assert have == want
    assert all(r.taken <= 3 * r.size for r in got)
    return sizes, target


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


ROWS = [
    (1, "a", words(40, "x")), (2, "a", words(7000, "y")), (3, "b", words(900, "z")),
    (4, "b", None), (5, "b", ""), (6, None, words(3000, "n")), (None, "c", words(12, "q")),
    (None, "c", words(12, "q")), (7, "c", " \t\n"), (3, "b", words(900, "z")),
    (8, "B", words(30, "big")), (9, "", words(5, "e")), (10, "d", ""),
]


def placed(spark, rows, **options):
    full = [(*r, 7, "clash") for r in rows]
    return mixing.place(spark.createDataFrame(full, SCHEMA), **options)


def test_targets_and_words_taken(spark):
    table = placed(spark, ROWS)
    got = mixing.taken(spark.createDataFrame([(*r, 7, "clash") for r in ROWS], SCHEMA)).collect()
    sizes, target = check(ROWS, got)
    sources = {r.row: r.source for r in table.collect()}
    assert len(sources) == len(ROWS)
    by_target = defaultdict(int)
    for r in got:
        by_target[round(r.target, 6), r.source_size] += r.taken
    wanted = defaultdict(int)
    for s, t in target.items():
        wanted[round(t, 6), sizes[s]] += round(t)
    assert by_target == wanted


@pytest.mark.parametrize("block", [1, 7, 64, 1024])
def test_passes_take_every_word_once(spark, block):
    """A word is taken as often as there are whole passes, or once more."""
    table = placed(spark, ROWS)
    sources = mixing.targets(table)
    mixed = mixing.mix(table, sources, block=block).collect()
    at = {r.row: r for r in table.collect()}
    times = defaultdict(Counter)
    for m in mixed:
        for w in range(m.word, m.word + m.length):
            times[at[m.row].sid][at[m.row].start + w] += 1
    slots = Counter()
    for m in mixed:
        slots[m.sid, m.slot, m.shard] += m.length
    assert all(n <= block for n in slots.values())
    for s in sources.collect():
        passes, rest = divmod(round(s.target), s.source_size or 1)
        counts = times[s.sid]
        assert sum(counts.values()) == round(s.target)
        extra = [w for w in range(s.source_size) if counts[w] == passes + 1]
        assert len(extra) == rest
        assert sum(counts[w] == passes for w in range(s.source_size)) == s.source_size - rest


def test_shards_follow_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    rows = [(i, "abc"[i % 3], words(300, f"w{i}_")) for i in range(300)]
    table = placed(spark, rows)
    sources = mixing.targets(table)
    found = mixing.slots(sources, block=16).collect()
    share = {s.sid: s.target for s in sources.collect()}
    total = sum(share.values())
    shards = defaultdict(Counter)
    for r in found:
        shards[r.shard][r.sid] += 1
    assert len(shards) == -(-int(total) // (16 * 64))
    for counts in shards.values():
        n = sum(counts.values())
        assert abs(n - 64) < 6 * 8
        for sid, t in share.items():
            p = t / total
            assert abs(counts[sid] - n * p) < 6 * (n * p * (1 - p)) ** 0.5 + 1


def test_reruns_and_layout_agree(spark):
    rows = [(i, "ab"[i % 2], words(50 + i, f"w{i}_")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one = sorted(map(tuple, mixing.taken(docs).collect()))
    two = sorted(map(tuple, mixing.taken(docs.repartition(7, "text")).collect()))
    other = sorted(map(tuple, mixing.taken(docs, seed=2).collect()))
    assert one == two
    assert one != other


def test_texts_of_the_mix(spark):
    table = placed(spark, ROWS, keep_text=True)
    mixed = mixing.mix(table, mixing.targets(table), block=16)
    texts = {r.row: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in table.collect()}
    found = mixing.mixed_texts(table, mixed, block=16).collect()
    assert len(found) == mixed.count()
    for r in found:
        assert r.text.split() == texts[r.row][r.word : r.word + r.length]


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 7, "clash") for r in ROWS], SCHEMA)
    out = spark.read.parquet(mixing.write_mix(docs, str(tmp_path / "mix")))
    taken = mixing.taken(docs)
    assert out.selectExpr("sum(length)").first()[0] == taken.selectExpr("sum(taken)").first()[0]


def test_nothing_to_mix(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.taken(none).collect() == []
    empty = spark.createDataFrame([(1, None, None), (2, "a", "")], none.schema)
    assert sorted(tuple(r)[1:] for r in mixing.taken(empty).collect()) == [(0, 0, 0.0, 0)] * 2


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000, 4097])
def test_permutations(n):
    whole = np.arange(n)
    images = mixing.permuted(whole, n, 12345)
    assert sorted(images.tolist()) == whole.tolist()
    assert (mixing.permuted(images, n, 12345, inverse=True) == whole).all()
    if n > 60:
        assert (images != mixing.permuted(whole, n, 12346)).any()


def test_query_on_its_table(spark, sf_dir):
    rows = [
        (r.doc_id, r.source, r.text)
        for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ]
    got = op12_source_mix(spark, sf_dir).collect()
    sizes, target = check(rows, got)
    source = {d: s for d, s, _ in rows}
    taken = Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
    assert {s: round(t) for s, t in target.items()} == {s: taken[s] for s in target}
