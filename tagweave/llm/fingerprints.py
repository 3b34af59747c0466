"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the range.

A sketch is the ascending set of the five-word shingle hashes below 2**64 / SCALE, and
of the LEAST smallest hashes if fewer are below: a text of up to LEAST shingles is kept
whole. This stays mergeable, since the sketch of a union follows from the sketches of
its parts. Two sketches are compared on the hashes up to which both are complete. Texts
with equal shingle sets have equal sketches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.shingles import SLICE_BYTES, shingle_sets

SCALE = 2
LEAST = 64  # hashes kept of a text, if it has as many
PART_DOCS = 1000  # documents of a range, compared with their neighbours by one task
TASK_PARTS = 4  # expected ranges of a task


def sketches(texts: pa.Array, scale: int = SCALE) -> list[np.ndarray]:
    """The sketch of each text. A null or wordless text has an empty one."""
    limit = np.uint64((1 << 64) // scale - 1)
    out = []
    for _, bounds, hashes in shingle_sets(texts):
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            mine = hashes[low:high]
            below = int(np.searchsorted(mine, limit, side="right"))
            out.append(mine[: max(below, LEAST)].copy())
    return out


def merge(one: np.ndarray, two: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of the union of two shingle sets, from their sketches."""
    both = np.union1d(one, two)
    below = int(np.searchsorted(both, np.uint64((1 << 64) // scale - 1), side="right"))
    return both[: max(below, LEAST)]


def _shared(one: np.ndarray, two: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Both sketches up to the largest hash at which neither leaves one out."""
    reach = [
        max(np.uint64((1 << 64) // scale - 1), x[-1]) for x in (one, two) if len(x) >= LEAST
    ]
    if not reach:
        return one, two
    return tuple(x[: int(np.searchsorted(x, min(reach), side="right"))] for x in (one, two))


def likeness(one: np.ndarray, two: np.ndarray, scale: int = SCALE) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 for one."""
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    one, two = _shared(one, two, scale)
    common = len(np.intersect1d(one, two, assume_unique=True))
    return common / (len(one) + len(two) - common)


def containment(one: np.ndarray, two: np.ndarray, scale: int = SCALE) -> float | None:
    """Estimated share of the first set's shingles that the second has; 1 if it has none,
    null if all of them lie where the second sketch says nothing."""
    if not len(one):
        return 1.0
    one, two = _shared(one, two, scale)
    if not len(one):
        return None
    return len(np.intersect1d(one, two, assume_unique=True)) / len(one)


def to_text(sketch: np.ndarray) -> str:
    """Sixteen lowercase hex digits for each hash, ascending."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every document; a null text is an empty one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_chars": [len(t.as_py() or "") for t in texts],
                    "fingerprint": [to_text(s) for s in sketches(texts, scale)],
                },
                _PLAIN,
            )

    return docs.select("doc_id", "text").mapInArrow(
        each, "doc_id long, n_chars long, fingerprint string"
    )


_PLAIN = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())]
)


def edited_likeness(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each document and of an edited text, compared.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as
    many (or all) of the next document in descending doc_id order; the first follows the
    last. Rows with equal doc_ids come in text order, null doc_ids last, and null texts
    count as empty. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next and in_next, the containment in the next,
    which is null if the sketches cannot tell it.

    Documents are dealt into ranges of doc_id; the first document of the next range is
    copied to the end of each, so that a range is all that a task needs.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    keys = base.select("doc_id")
    total, top = keys.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    parts = max(1, -(-total // PART_DOCS))
    # ascending doc_ids, all in the table, at which ranges begin
    shares = [i / parts for i in range(1, parts)]
    cuts = []
    if shares and top is not None:
        found = keys.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * parts))).first()[0]
        cuts = sorted({c for c in found if c < top})
    last = len(cuts)
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("array<struct<part:int,copy:int>>")
    def places(doc_id: pd.Series) -> pd.Series:
        # range 0 has the largest doc_ids, and a cut is the first document of a later
        # range; its copy goes to the end of the range before, the very first document's
        # to the end of the last
        none = doc_id.isna().to_numpy()
        ids = doc_id.fillna(0).astype("int64").to_numpy()
        part = np.where(none, last, last - np.searchsorted(edges, ids, side="left"))
        cut = np.isin(ids, edges) & ~none
        first = none if top is None else (ids == top) & ~none
        return pd.Series(
            [
                [(p, 0)] + ([(p - 1, 1)] if c else []) + ([(last, 2)] if f else [])
                for p, c, f in zip(part.tolist(), cut, first, strict=True)
            ]
        )

    spread = base.withColumn("_at", F.explode(places("doc_id"))).select(
        "_at.part", "_at.copy", "doc_id", "text"
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next document
        for batch in batches:
            rows = [
                tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)
            ]
            rows = ([held] if held else []) + rows
            held = rows.pop() if rows else None
            for some in _runs(rows + [held]):
                yield _compared(some, scale)

    # part and copy first: a range's own rows in descending doc_id order, then the copies
    # of its next document in text order, of which only the first is used
    return (
        spread.repartition(-(-parts // TASK_PARTS), "part")
        .sortWithinPartitions("part", "copy", F.col("doc_id").desc_nulls_last(), "text")
        .mapInArrow(each, _COMPARED_DDL)
    )


def _runs(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Overlapping runs of consecutive rows, bounded by their characters."""
    low, chars = 0, 0
    for i, row in enumerate(rows):
        chars += len(row[3])
        if i > low and (chars > SLICE_BYTES or i == len(rows) - 1):
            yield rows[low : i + 1]
            low, chars = i, len(row[3])


def _compared(rows: list[tuple], scale: int) -> pa.RecordBatch:
    """Output for all rows but the last, each with the row after it as its next."""
    own = sketches(pa.array([r[3] for r in rows], pa.large_string()), scale)
    kept, edited, near, inside = [], [], [], []
    for i, ((part, copy, _, text), after) in enumerate(zip(rows[:-1], rows[1:], strict=True)):
        if copy or part != after[0]:
            continue
        cut = len(text) // 3
        kept.append(i)
        edited.append(text[: len(text) - cut] + after[3][:cut])
        near.append(likeness(own[i], own[i + 1], scale))
        inside.append(containment(own[i], own[i + 1], scale))
    changed = sketches(pa.array(edited, pa.large_string()), scale)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": [rows[i][2] for i in kept],
            "n_chars": [len(rows[i][3]) for i in kept],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": [to_text(own[i]) for i in kept],
            "edited_fingerprint": [to_text(s) for s in changed],
            "near_edited": [likeness(own[i], s, scale) for i, s in zip(kept, changed, strict=True)],
            "near_next": near,
            "in_next": inside,
        },
        _COMPARED,
    )


_COMPARED = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [(c, pa.float64()) for c in ("near_edited", "near_next", "in_next")]
)
_COMPARED_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, in_next double"
)
