"""Token files, the token codec, sentence pieces and packing against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tagweave.llm import codec, packing, pieces, queries, token_files
from tagweave.llm.bpe import Encoder
from tagweave.llm.store import fresh_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "One two, three.\nFour  five", None, "", " ", "x <|endoftext|> y", "long text " * 4000,
    "One two, three.\nFour  five", "é 字 \t\n\n a", "▁ a▁▁b ",
]
SCHEMA = "doc_id long, text string, DOC string, piece int, start string"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def _table(spark, texts=TEXTS, ids=None):
    ids = ids or [5, 3, None, 3, 9, 1, 1, 2**60 + 1, 4]
    rows = [(i, t, None, None, None) for i, t in zip(ids, texts, strict=False)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _ids(tokenizer, text, end=None):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids if end is None else [*ids, end]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t\r\x1c\x85a1'.,é字s 　<|>")), max_size=14))
def test_chunked_ids_are_the_tokenizers(text):
    global ENCODER, PLAIN
    if "ENCODER" not in globals():
        ENCODER, PLAIN = Encoder(BPE), Tokenizer.from_file(BPE)
        PLAIN.encode_special_tokens = True
    assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == _ids(PLAIN, text)


MARKED = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y", "<|endoftext|><|endoftext|>\n c",
          "<|endoftext|", "One two, three."]


def test_added_tokens_have_their_own_ids():
    plain, ours = Tokenizer.from_file(BPE), Encoder(BPE, added_tokens=True)
    for text in [*MARKED, *[t for t in TEXTS if t]]:
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == _ids(plain, text)
    assert np.frombuffer(ours.ids(MARKED[0]), "<u4").tolist() == [64, 50256, 65]


def test_queries_use_the_added_tokens(spark, tmp_path):
    plain = Tokenizer.from_file(BPE)
    folder = str(tmp_path / "in")
    table = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    table.write.parquet(f"{folder}/documents.parquet")
    expected = [_ids(plain, t, 2) for t in MARKED]
    packed = queries.op4_best_fit_packing(spark, folder).collect()
    stage = corpus_pipeline.STAGES[-1][1](spark, table, folder).collect()
    for rows in (packed, stage):
        got = {r.doc_id: (r.length, r.ids_crc32) for r in rows}
        assert got == {i: (len(x), _crc(x)) for i, x in enumerate(expected)}
    tokens = queries.op5_token_output(spark, folder).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens} == {
        i: (len(x), _crc(x)) for i, x in enumerate(expected)
    }


def test_flat_files_count_tokens(spark, tokenizer):
    path = fresh_path(spark, "flat")
    token_files.write_flat(_table(spark), path, BPE)
    expected = sorted(len(_ids(tokenizer, t)) for t in TEXTS)
    # blocks far smaller than documents, larger ones, and one for each file
    for block_ids in (7, 1000, 1 << 20):
        rows = token_files.scan_flat(spark, path, block_ids=block_ids).collect()
        assert sorted(r.n_tokens for r in rows) == expected
        assert all(r.closed for r in rows)
        by_file = {}
        for r in sorted(rows, key=lambda r: (r.file, r.doc_no)):
            number, at = by_file.get(r.file, (0, 0))
            assert (r.doc_no, r.start) == (number, at)
            by_file[r.file] = (number + 1, at + r.n_tokens + 1)


def test_flat_file_without_last_separator(spark, tmp_path):
    np.array([1, 2, 50256, 50256, 7], "<u2").tofile(tmp_path / "part-0")
    np.array([], "<u2").tofile(tmp_path / "part-1")
    rows = token_files.scan_flat(spark, str(tmp_path), block_ids=2).orderBy("doc_no").collect()
    assert [(r.start, r.n_tokens, r.closed) for r in rows] == [
        (0, 2, True), (3, 0, True), (4, 1, False),
    ]


def test_flat_files_of_an_empty_table(spark):
    path = fresh_path(spark, "flat")
    token_files.write_flat(_table(spark).limit(0), path, BPE)
    assert token_files.scan_flat(spark, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_codec_round_trip(values):
    control, data = codec.encode(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert codec.decode(control, data, len(values)).tolist() == values


def test_corpus_round_trip(spark, tokenizer):
    path = fresh_path(spark, "corpus")
    codec.write_tokens(_table(spark), path, BPE)
    got = sorted(codec.read_tokens(spark, path).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids) // 4)
        start += r.n_tokens
    held = sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got)
    assert held == sorted(_ids(tokenizer, t, 2) for t in TEXTS)
    digests = codec.read_tokens(spark, path, digest=True).collect()
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(r.ids) for r in got)
    ranks = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    every = [i for ids in held for i in ids]
    assert ranks == sorted(set(every), key=lambda i: (-every.count(i), i))


def test_corpus_of_an_empty_table(spark):
    path = fresh_path(spark, "corpus")
    codec.write_tokens(_table(spark).limit(0), path, BPE)
    assert codec.read_tokens(spark, path).collect() == []


def test_pieces_are_the_librarys(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = pieces.Pieces(MODEL)
    rnd = random.Random(3)
    texts = [
        "".join(rnd.choice("  \n\tab▁é字🙂\0<s>1") for _ in range(rnd.randint(0, 14)))
        for _ in range(1500)
    ]
    for text in texts:
        ids = model.encode(text)
        assert own.encode(text) == (len(ids), ",".join(map(str, ids)), model.decode(ids))
    rows = pieces.round_trip(_table(spark), MODEL, digest=True).collect()
    expected = []
    for text in TEXTS:
        ids = model.encode(text or "")
        numbers = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = hashlib.sha256(model.decode(ids).encode()).hexdigest() if ids else None
        expected.append((len(ids), numbers, back or hashlib.sha256(b"").hexdigest()))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(expected)
    assert pieces.round_trip(_table(spark).limit(0), MODEL).count() == 0


def test_piece_table_may_be_cleared(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_BYTES", 600)
    own, whole = pieces.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("a b c d e f", "f e d", "g h", "a b c d e f"):
        assert own.encode(text)[1] == ",".join(map(str, whole.encode(text)))


def test_packing_places_every_piece(spark, tokenizer):
    rows = packing.pack_documents(_table(spark), BPE, capacity=64).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    expected = []
    for doc_id, text in zip([5, 3, None, 3, 9, 1, 1, 2**60 + 1, 4], TEXTS, strict=True):
        ids = _ids(tokenizer, text, 2)
        low, high, piece = 0, len(ids) % 64 or 64, 0
        while low < len(ids):
            expected.append((doc_id, piece, low, high - low, _crc(ids[low:high])))
            low, high, piece = high, high + 64, piece + 1
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == (
        sorted(expected, key=key)
    )
    assert packing.pack_documents(_table(spark).limit(0), BPE).count() == 0


def test_sum_of_squares_takes_the_smallest_sum():
    rnd = np.random.default_rng(1)
    lengths, capacity = rnd.integers(1, 21, 200), 20
    sequence, offset = packing.sum_of_squares(lengths, capacity)
    fill = {}
    for item, number in zip(lengths.tolist(), sequence.tolist(), strict=True):
        def total(place, item=item):
            trial = dict(fill)
            trial[place] = trial.get(place, 0) + item
            gaps = [capacity - x for x in trial.values() if x < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        options = [p for p in fill if fill[p] + item <= capacity] + [max(fill, default=-1) + 1]
        assert total(number) == min(map(total, options))
        fill[number] = fill.get(number, 0) + item


def test_packing_over_shards_stays_close_to_the_bound(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, int(n), "x") for i, n in enumerate(rnd.integers(1, 1025, 9000))]
    items = spark.createDataFrame(rows, "doc_id long, length long, _row string")
    packed = packing.pack(items, shard_items=1000)
    assert packed.columns == ["doc_id", "length", "_row", "sequence_id", "offset"]
    got = packed.collect()
    assert sorted(r.doc_id for r in got) == list(range(9000))
    used = len({r.sequence_id for r in got})
    # the method leaves about 3 % over a thousand items of even sizes, less over more
    assert used <= 1.04 * sum(r[1] for r in rows) / 1024


def test_long_chunks_are_not_remembered():
    """Texts without spaces are one chunk each and would fill the table."""
    texts = [chr(0x4E00 + i) * 1500 for i in range(50)] + ["plain words here"] * 2
    marked = pieces.Pieces(MODEL)
    for text in texts:
        ids = marked.model.encode(text)
        assert marked.encode(text) == (len(ids), ",".join(map(str, ids)), text)
    assert marked.held < 10_000
    assert all(len(chunk) <= 64 for chunk in marked.table)


def test_ids_of_every_character(tokenizer):
    """Both programs split a text alike around any character."""
    own = Encoder(BPE)
    assert own._plain
    for low in range(0, 0x20000, 0x2000):
        found = [chr(c) for c in range(low, low + 0x2000) if not 0xD800 <= c <= 0xDFFF]
        text = "".join(f"a{c}b 1{c}2 .{c}. {c}{c}  {c}\n" for c in found)
        assert own.ids(text) == np.array(_ids(tokenizer, text), "<u4").tobytes()


def test_ids_of_long_runs(tokenizer):
    own, pick = Encoder(BPE), random.Random(4)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", " ", "0123456789", "-=", "é"):
        text = "x" + "".join(pick.choice(letters) for _ in range(60_000))
        assert own.ids(text) == np.array(_ids(tokenizer, text), "<u4").tobytes()


def test_other_tokenizer_files_go_to_the_library(tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for text in ("Some  Words", "", "a<|endoftext|>b"):
        want = library.encode(text, add_special_tokens=False).ids
        assert Encoder(path, added_tokens=True).ids(text) == np.array(want, "<u4").tobytes()
