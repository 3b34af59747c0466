"""SentencePiece encoding and decoding through a table of distinct marked words.

The library writes a space as the marker U+2581 and puts one before the text. If no
piece of the model has a marker after another character, no merge crosses from the end
of a word into the next marker: a text falls into chunks of markers followed by other
characters. Each distinct chunk is segmented once by the library, and the ids and
decoded strings are joined back by position. The table lives as long as the Python
worker; clearing it costs time and changes nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from sys import getsizeof

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

TABLE_BYTES = 150_000_000  # of chunks remembered by a worker
ENTRY_BYTES = 110  # that an entry takes besides its chunk and ids, about
KEPT_CHARACTERS = 64  # longer chunks, as texts without spaces are, are not remembered
MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """A model file's encoder. A model whose pieces may cross a marker, that changes
    characters, or that puts no marker first has no chunks: whole texts are then passed
    to the library."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = " Ａ  ﬁ\n é "
        self.chunked = (
            not any(MARK in p.lstrip(MARK) for p in pieces)
            and self.model.decode(self.model.encode(probe)) == probe
            and self.model.encode("a", out_type=str)[0].startswith(MARK)
            and MARK in pieces
        )
        self.lead = self.model.encode("a")
        self.mark = self.model.piece_to_id(MARK)
        # a chunk without its first marker -> decimal ids joined by commas
        self.table: dict[str, str] = {}
        # the chunks that the library does not decode to themselves
        self.changed: dict[str, str] = {}
        self.held = 0

    def _segment(self, chunks: list[str]) -> None:
        """Put chunks into the table."""
        # the library itself puts the first marker before a text, unless that is empty
        ids = [
            x if chunk else [self.mark]
            for chunk, x in zip(chunks, self.model.encode(chunks, num_threads=1), strict=True)
        ]
        # a decoded text loses its first marker, so each chunk follows a known one
        decoded = self.model.decode([self.lead + x for x in ids], num_threads=1)
        for chunk, own, text in zip(chunks, ids, decoded, strict=True):
            self.table[chunk] = found = ",".join(map(str, own))
            self.held += getsizeof(chunk) + getsizeof(found) + ENTRY_BYTES
            if text[2:] != chunk:
                self.changed[chunk] = text[1:]
                self.held += getsizeof(text[1:]) + ENTRY_BYTES

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by commas, decoded text)"""
        if not text:
            return 0, "", ""
        if not self.chunked:
            ids = self.model.encode(text)
            return len(ids), ",".join(map(str, ids)), self.model.decode(ids)
        if "  " in text or MARK in text or text[0] == " ":
            marked = MARK + text.replace(" ", MARK)
            chunks = [x[1:] for x in _CHUNK.findall(marked)]
        else:
            chunks = text.split(" ")
        try:
            found = ",".join(map(self.table.__getitem__, chunks))
            new = []
        except KeyError:
            if self.held >= TABLE_BYTES:
                self.table.clear()
                self.changed.clear()
                self.held = 0
            new = [x for x in dict.fromkeys(chunks) if x not in self.table]
            self._segment(new)
            found = ",".join(map(self.table.__getitem__, chunks))
        back = text
        if MARK in text or (self.changed and not self.changed.keys().isdisjoint(chunks)):
            spaced = (self.changed.get(x) or " " + x.replace(MARK, " ") for x in chunks)
            back = "".join(spaced)[1:]
        for long in new:
            if len(long) > KEPT_CHARACTERS:
                self._drop(long)
        return found.count(",") + 1, found, back

    def _drop(self, chunk: str) -> None:
        self.held -= getsizeof(chunk) + getsizeof(self.table.pop(chunk)) + ENTRY_BYTES
        text = self.changed.pop(chunk, None)
        if text is not None:
            self.held -= getsizeof(text) + ENTRY_BYTES


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's encoder of a model file."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def round_trip(docs: DataFrame, model: str, digest: bool = False) -> DataFrame:
    """Every text of ``docs`` (doc_id, text) encoded and decoded again.

    Returns doc_id, n_tokens, ids (decimal, joined by commas) and decoded, or with
    ``digest`` their lowercase hex SHA-256 as ids_sha256 and decoded_sha256. A null
    text counts as empty and has no ids; repeated and null doc_ids are kept.
    """
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64())] + [(n, pa.string()) for n in names]
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces(model).encode
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1):
                n, numbers, back = encode(text.as_py() or "")
                counts.append(n)
                ids.append(_sha(numbers) if digest else numbers)
                decoded.append(_sha(back) if digest else back)
            yield pa.RecordBatch.from_pydict(
                dict(zip(schema.names, (batch.column(0), counts, ids, decoded), strict=True)),
                schema,
            )

    return docs.select("doc_id", "text").mapInArrow(
        each, f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string"
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
