"""Alignment of the tokens of two tokenizers over the same text.

Tokenizer A is a byte-level BPE file, B a SentencePiece model that puts a space before
the text; A is given the space as well. Both tokenise the whole text first. Tokens that
begin with a space are the anchors: where the ends of the tokens before one of A and
before one of B are the same byte, checked on the offsets, the text is cut. What lies
between two cuts is a window, a pair of id tuples, and windows repeat as words do: each
distinct window is aligned once and remembered by its ids. The windows of a text joined
in order are its alignment, since every cut is an end that both tokenizers share.

Two tokens that end together are linked. The bytes of the shorter one are then the end
of the bytes of the longer one, so the number of distinct linked id pairs is at most the
number of endings of all entries: bounded by the two vocabularies, whatever the corpus.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagweave.llm.bpe import encoder, entries
from tagweave.llm.shingles import mix64, slices
from tagweave.llm.store import durable

TABLE_BYTES = 60_000_000  # of remembered windows in a worker, about
ENTRY_BYTES = 400  # that a remembered window takes besides its ids, about
WINDOW_IDS = 64  # windows with more ids are aligned anew each time
BATCH_LINKS = 1_000_000  # links looked up in one vectorised step

_DOC = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("groups", pa.string()), ("links", pa.binary()), ("pairs", pa.binary()),
     ("uses", pa.binary())]
)
_DOC_DDL = (
    "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary, "
    "pairs binary, uses binary"
)


class Aligner:
    """The aligned windows of a pair of tokenizers, kept in the worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a = encoder(path_a)
        found = entries(Tokenizer.from_file(path_a))
        self.bytes_a = [b""] * (max(found.values()) + 1)
        for entry, i in found.items():
            self.bytes_a[i] = entry
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b = model
        self.bytes_b = [
            bytes([int(piece[3:-1], 16)]) if model.is_byte(i)
            else piece.replace("▁", " ").encode()
            for i, piece in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
        ]
        self.length_a, self.spaced_a = _shape(self.bytes_a)
        self.length_b, self.spaced_b = _shape(self.bytes_b)
        # the decimal digits of each id, filled up with zero bytes
        ids = max(len(self.bytes_a), len(self.bytes_b))
        written = np.array([str(i) for i in range(ids)], "S")
        self.digits = written.view(np.uint8).reshape(ids, -1)
        # (ids of A, ids of B) -> [groups as text, links, uses]
        self.table: dict[tuple[bytes, bytes], list] = {}
        self.held = 0
        self.counted: dict[int, int] = {}

    def _aligned(self, keys: list[tuple[bytes, bytes]]) -> list[list]:
        """Windows, aligned in one step: the groups as text and the links of each."""
        a = np.frombuffer(b"".join([k[0] for k in keys]), "<u4")
        b = np.frombuffer(b"".join([k[1] for k in keys]), "<u4")
        last_a = np.cumsum([len(k[0]) // 4 for k in keys]) - 1
        last_b = np.cumsum([len(k[1]) // 4 for k in keys]) - 1
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        here_a, here_b = (np.zeros(int(ends_a[-1]) + 1, bool) for _ in "ab")
        here_a[ends_a] = here_b[ends_b] = True
        shared_a, shared_b = here_b[ends_a], here_a[ends_b]
        # a group's tokens of A stand before its tokens of B
        group_a = np.cumsum(shared_a) - shared_a
        group_b = np.cumsum(shared_b) - shared_b
        at_a = np.arange(len(a)) + np.append(0, np.flatnonzero(shared_b) + 1)[group_a]
        at_b = np.arange(len(b)) + (np.flatnonzero(shared_a) + 1)[group_b]
        ids = np.empty(len(a) + len(b), np.int64)
        mark = np.empty(len(ids), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a] = np.where(shared_a, ord("|"), ord(","))
        mark[at_b] = np.where(shared_b, ord(";"), ord(","))
        digits = self.digits[ids]
        length = (digits > 0).sum(1)
        ends = np.cumsum(length + 1) - 1
        out = np.empty(int(ends[-1]) + 1, np.uint8)
        out[ends] = mark
        for k in range(digits.shape[1]):
            own = np.flatnonzero(length > k)
            out[ends[own] - length[own] + k] = digits[own, k]
        text = out.tobytes().decode()
        links = np.column_stack((a[shared_a], b[shared_b])).tobytes()
        text_ends = ends[at_b[last_b]].tolist()
        link_ends = (8 * np.cumsum(shared_a)[last_a]).tolist()
        made, low, linked = [], 0, 0
        for high, till in zip(text_ends, link_ends, strict=True):
            made.append([text[low:high], links[linked:till], 0])
            low, linked = high + 1, till
        return made

    def _settle(self) -> None:
        """Move the uses of all remembered windows to the counts of pairs."""
        used = [window for window in self.table.values() if window[2]]
        if not used:
            return
        links = np.frombuffer(b"".join([window[1] for window in used]), "<u8")
        uses = np.repeat([window[2] for window in used], [len(w[1]) // 8 for w in used])
        for window in used:
            window[2] = 0
        pairs, at = np.unique(links, return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, at, uses)
        counted = self.counted
        for pair, n in zip(pairs.tolist(), times.tolist(), strict=True):
            counted[pair] = counted.get(pair, 0) + n

    def _forget(self) -> None:
        self._settle()
        self.table.clear()
        self.held = 0

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, how often each was linked) since the last call."""
        self._settle()
        pairs = np.fromiter(self.counted.keys(), "<u8", len(self.counted))
        uses = np.fromiter(self.counted.values(), "<i8", len(self.counted))
        self.counted.clear()
        return pairs, uses

    def start(self) -> None:
        """Forget uses that a failed task may have left."""
        self.counted.clear()
        for window in self.table.values():
            window[2] = 0

    def align(self, texts: list[str]) -> list[tuple[int, int, str, bytes]]:
        """(tokens of A, tokens of B, groups as text, links) of each text; nothing where
        the text is empty or the bytes of either side are not those of a space and it."""
        tokens = [self._tokens(text) for text in texts]
        told = [i for i, x in enumerate(tokens) if x]
        out = [(0, 0, "", b"")] * len(texts)
        if not told:
            return out
        joined_a = b"".join([tokens[i][0] for i in told])
        joined_b = b"".join([tokens[i][1] for i in told])
        firsts_a = np.cumsum([0] + [len(tokens[i][0]) // 4 for i in told])
        firsts_b = np.cumsum([0] + [len(tokens[i][1]) // 4 for i in told])
        ids_a, ids_b = np.frombuffer(joined_a, "<u4"), np.frombuffer(joined_b, "<u4")
        # both sides tell the same bytes, so their offsets are those of one byte string
        starts_a = np.cumsum(self.length_a[ids_a]) - self.length_a[ids_a]
        starts_b = np.cumsum(self.length_b[ids_b]) - self.length_b[ids_b]
        anchors_a, anchors_b = self.spaced_a[ids_a], self.spaced_b[ids_b]
        anchors_a[firsts_a[:-1]] = anchors_b[firsts_b[:-1]] = True
        here_a, here_b = (np.zeros(int(starts_a[-1]) + 1 + len(joined_a), bool) for _ in "ab")
        here_a[starts_a[anchors_a]] = True
        here_b[starts_b[anchors_b]] = True
        # the tokens before both anchors end where the anchors begin
        low_a = np.flatnonzero(anchors_a & here_b[starts_a])
        low_b = np.flatnonzero(anchors_b & here_a[starts_b])
        first, which = _alike(ids_a, low_a, ids_b, low_b)
        high_a, high_b = np.append(low_a[1:], len(ids_a)), np.append(low_b[1:], len(ids_b))
        cuts = (4 * x[first] for x in (low_a, high_a, low_b, high_b))
        keys = [
            (joined_a[p:q], joined_b[r:t])
            for p, q, r, t in zip(*(x.tolist() for x in cuts), strict=True)
        ]
        windows = self._windows(keys, np.bincount(which).tolist())
        groups, links = [w[0] for w in windows], [w[1] for w in windows]
        order = which.tolist()
        groups, links = [groups[i] for i in order], [links[i] for i in order]
        bounds = np.searchsorted(low_a, firsts_a).tolist()
        for i, p, q in zip(told, bounds[:-1], bounds[1:], strict=True):
            a, b = tokens[i]
            out[i] = len(a) // 4, len(b) // 4, ";".join(groups[p:q]), b"".join(links[p:q])
        return out

    def _tokens(self, text: str) -> tuple[bytes, bytes] | None:
        """The ids of A and of B, if both tell the text exactly."""
        if not text:
            return None
        a, ids_b = self.a.ids(" " + text), self.b.encode(text)
        raw, bytes_a, bytes_b = b" " + text.encode(), self.bytes_a, self.bytes_b
        if (
            b"".join([bytes_a[i] for i in memoryview(a).cast("I").tolist()]) != raw
            or b"".join([bytes_b[i] for i in ids_b]) != raw
        ):
            return None
        return a, array("I", ids_b).tobytes()

    def _windows(self, keys: list[tuple[bytes, bytes]], uses: list[int]) -> list[list]:
        """The windows of pairs of id tuples, each used so many times more; those that
        are not remembered are aligned, and remembered unless they are long."""
        found = list(map(self.table.get, keys))
        new = [i for i, window in enumerate(found) if window is None]
        for i, window in zip(new, self._aligned([keys[i] for i in new]) if new else (), strict=True):
            found[i] = window
        for window, n in zip(found, uses, strict=True):
            window[2] += n
        for i in new:
            size = len(keys[i][0]) + len(keys[i][1])
            if size <= 4 * WINDOW_IDS:
                self.table[keys[i]] = found[i]
                self.held += 2 * size + ENTRY_BYTES
            else:
                for pair in np.frombuffer(found[i][1], "<u8").tolist():
                    self.counted[pair] = self.counted.get(pair, 0) + found[i][2]
        if self.held > TABLE_BYTES:
            self._forget()
        return found


def _alike(
    ids_a: np.ndarray, low_a: np.ndarray, ids_b: np.ndarray, low_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(a window of each kind, the kind of each window): windows with the same ids are of
    one kind. Found by hashes, and checked id by id."""
    total = np.zeros(len(low_a), np.uint64)
    shifts = []
    for ids, low, salt in ((ids_a, low_a, 0x9E3779B9), (ids_b, low_b, 0x85EBCA77)):
        n = np.diff(np.append(low, len(ids)))
        place = (np.arange(len(ids)) - np.repeat(low, n)).astype(np.uint64)
        sums = np.cumsum(mix64(ids.astype(np.uint64) + (place + np.uint64(salt) << np.uint64(32))))
        ends = sums[low + n - 1]
        total += mix64(np.diff(ends, prepend=np.uint64(0)) + np.uint64(salt))
        shifts.append((ids, low, n))
    _, first, which = np.unique(total, return_index=True, return_inverse=True)
    for ids, low, n in shifts:
        like = first[which]
        if (n != n[like]).any() or (
            ids != ids[np.arange(len(ids)) - np.repeat(low - low[like], n)]
        ).any():
            # two kinds share a hash: take each window for itself
            return np.arange(len(low)), np.arange(len(low))
    return first, which


def _shape(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths in bytes, whether an entry begins with a space)"""
    return (
        np.array([len(x) for x in entries], np.int64),
        np.array([x.startswith(b" ") for x in entries]),
    )


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of a pair of tokenizer files."""
    key = path_a, path_b
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool) -> DataFrame:
    """A row for each document, and at the end of each task one row without links whose
    ``pairs`` and ``uses`` count the links of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        own.start()
        for batch in batches:
            for low, _, bounds in slices(batch.column(1)):
                n = len(bounds) - 1
                texts = [t or "" for t in batch.column(1).slice(low, n).to_pylist()]
                doc_ids = batch.column(0).slice(low, n).to_pylist()
                rows = []
                for doc_id, found in zip(doc_ids, own.align(texts), strict=True):
                    n_a, n_b, groups, links = found
                    if digest and groups:
                        groups = hashlib.sha256(groups.encode()).hexdigest()
                    rows.append((doc_id, n_a, n_b, len(links) // 8, groups, links, None, None))
                yield _batch(rows)
        pairs, uses = own.counts()
        yield _batch([(None, None, None, None, None, None, pairs.tobytes(), uses.tobytes())])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _DOC_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        dict(zip(_DOC.names, zip(*rows, strict=True), strict=True)), _DOC
    )


def _pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each id pair, and whether no pair of its B id
    has more. A pair is its two ids as one little-endian number."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, uses in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pydict(
                    {"pair": np.frombuffer(pairs.as_buffer(), "<i8"),
                     "n": np.frombuffer(uses.as_buffer(), "<i8")}
                )

    counts = (
        aligned.filter("pairs is not null").select("pairs", "uses")
        .mapInArrow(read, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    )
    counts = durable(counts.withColumn("b", F.shiftrightunsigned("pair", 32)), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """Align the tokens of every text of ``docs`` (doc_id, text).

    Returns doc_id, n_a, n_b (tokens), n_groups (stretches between ends that both
    tokenizers share), n_links (pairs of tokens that end together), n_best (links whose id
    pair is the most frequent in the corpus for its B id, ties included), count_sum (over
    the links, how many links of the corpus hold their id pair) and the groups as text,
    ``a1,a2|b1;a3|b2,b3``, or with ``digest`` their lowercase hex SHA-256 as
    groups_sha256. Special tokens in a text are ordinary text.

    Texts that are null, empty, or not told exactly by the tokens of both sides have no
    tokens: zeros and an empty string. Repeated and null doc_ids are kept row by row.
    """
    aligned = durable(_aligned(docs, path_a, path_b, digest), "aligned")
    # bounded by the endings of the entries of both vocabularies
    rows = _pair_counts(aligned).collect()
    pairs = np.array([r.pair for r in rows], np.int64)
    order = np.argsort(pairs)
    pairs = pairs[order]
    counts = np.array([r.n for r in rows], np.int64)[order]
    best = np.array([r.best for r in rows], np.int64)[order]
    del rows
    name = "groups_sha256" if digest else "groups"
    schema = pa.schema(
        [(c, pa.int64()) for c in
         ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        + [(name, pa.string())]
    )

    def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
        links = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(5)]
        n = np.array([len(x) for x in links])
        at = np.searchsorted(pairs, np.concatenate(links))
        till = np.cumsum(n)

        def sums(values: np.ndarray) -> np.ndarray:
            ends = np.append(0, np.cumsum(values[at]))[till]
            return np.diff(ends, prepend=0)

        top, total = sums(best), sums(counts)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(n, pa.int64()), pa.array(top), pa.array(total),
             batch.column(4)],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, held = 0, 0
            for i, links in enumerate(batch.column(5)):
                held += len(links.as_buffer()) // 8
                if held >= BATCH_LINKS or i + 1 == batch.num_rows:
                    yield summed(batch.slice(low, i + 1 - low))
                    low, held = i + 1, 0

    return (
        aligned.filter("pairs is null")
        .select("doc_id", "n_a", "n_b", "n_groups", "groups", "links")
        .mapInArrow(
            run,
            "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
            f"count_sum long, {name} string",
        )
    )
