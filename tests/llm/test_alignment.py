"""Token alignment against the tokenizer libraries and plain byte offsets."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tagweave.llm import alignment
from tagweave.llm.queries import BPE, PIECES, op13_token_alignment

ODD = [
    "", None, " ", "   ", "a", " a", "a ", "a  b   c", "\n\n", " \n x\t\ty ", "▁", "a▁b", "<0x41>",
    "<s> x </s>", "a<|endoftext|>b", "Ａ ﬁ é é", "日本語のテキスト と 英語 mixed 🎉🎉 text",
    "\x00\x01 \x7f", "don't we'll 12345 3.14 !!!", " nbsp em", "x" * 3000,
    "漢字" * 1200, "the the the the", "​ zero﻿", "tab\tand  two", "ends with mark ▁",
]


def printable():
    """The byte that each printable character of a byte-level entry stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def expected(texts):
    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = printable()
    pairs, out = Counter(), []
    for text in texts:
        row = (0, 0, 0, 0, "", [])
        if text:
            raw = b" " + text.encode()
            one = a.encode(" " + text, add_special_tokens=False)
            bytes_a = [bytes(byte_of[c] for c in t) for t in one.tokens]
            ids_b = b.encode(text)
            bytes_b = [
                bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                else b.id_to_piece(i).replace("▁", " ").encode()
                for i in ids_b
            ]
            if b"".join(bytes_a) == raw == b"".join(bytes_b):
                ends_a, ends_b, at = {}, {}, 0
                for i, x in enumerate(bytes_a):
                    at += len(x)
                    ends_a[at] = i
                at = 0
                for i, x in enumerate(bytes_b):
                    at += len(x)
                    ends_b[at] = i
                links = [(one.ids[ends_a[e]], ids_b[ends_b[e]]) for e in ends_a if e in ends_b]
                groups, p, q = [], 0, 0
                for e in ends_a:
                    if e in ends_b:
                        left = ",".join(map(str, one.ids[p : ends_a[e] + 1]))
                        right = ",".join(map(str, ids_b[q : ends_b[e] + 1]))
                        groups.append(f"{left}|{right}")
                        p, q = ends_a[e] + 1, ends_b[e] + 1
                pairs.update(links)
                row = (len(one.ids), len(ids_b), len(groups), len(links), ";".join(groups), links)
        out.append(row)
    most = {}
    for (_, y), n in pairs.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (n_a, n_b, groups, n, sum(pairs[x] == most[x[1]] for x in links),
         sum(pairs[x] for x in links), text)
        for n_a, n_b, groups, n, text, links in out
    ]


def values(df, last):
    return [
        (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r[last])
        for r in df.orderBy("doc_id").collect()
    ]


@pytest.mark.parametrize("table_bytes", [alignment.TABLE_BYTES, 3000])
def test_odd_texts(spark, monkeypatch, table_bytes):
    monkeypatch.setattr(alignment, "TABLE_BYTES", table_bytes)
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD + ODD[8:12])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, n_a int")
    got = values(alignment.align(docs, BPE, PIECES), "groups")
    assert got == expected([r[1] for r in rows])


def test_emptied_tables_lose_no_count():
    """The worker's counts do not depend on when its table is emptied."""
    texts = [f"some words and {i % 7} more words {i}" for i in range(300)]
    found = []
    for limit in (alignment.TABLE_BYTES, 2000):
        own = alignment.Aligner(BPE, PIECES)
        before, alignment.TABLE_BYTES = alignment.TABLE_BYTES, limit
        try:
            for low in range(0, 300, 20):
                own.align(texts[low : low + 20])
        finally:
            alignment.TABLE_BYTES = before
        found.append(dict(zip(*(x.tolist() for x in own.counts()), strict=True)))
    assert found[0] == found[1]
    assert sum(found[0].values()) > 2000


def test_null_ids_and_empty_tables(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], schema)
    got = sorted((str(r.doc_id), r.n_links) for r in alignment.align(docs, BPE, PIECES).collect())
    assert [x[0] for x in got] == ["3", "None", "None"]
    assert got[0][1] == 0 and got[1][1] == got[2][1] > 0
    assert alignment.align(spark.createDataFrame([], schema), BPE, PIECES).collect() == []


def test_query_on_its_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = [
        (*r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[6] else "")
        for r in expected([d.text for d in docs])
    ]
    assert values(op13_token_alignment(spark, sf_dir), "groups_sha256") == want
