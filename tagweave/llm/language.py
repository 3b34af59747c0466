"""Language identification by nearest centroid.

A text is its byte two- and three-grams after lower-casing, letters only, hashed into
buckets: sublinear term frequency times inverse document frequency, normalised. Each
language has several centroids, found by clustering its training vectors; a text gets
the language of the centroid with the highest cosine, and is rejected when that cosine
is far below what the language's own training texts reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.shingles import slices
from tagweave.llm.store import durable

UNKNOWN = "und"
BUCKETS = 1 << 12  # for each of the two gram lengths
TRAIN_TEXTS = 400  # expected training texts per language: the bound of the sample
CENTROIDS = 4
TEXTS_AT_ONCE = 128
# a text is rejected below this share of the least cosine in its language's training, or
# below this cosine if that is less
REJECT_SHARE = 0.5
REJECT_COSINE = 0.1
_LETTER = regex.compile(r"\p{L}")

# letters stay, everything else is one blank; bytes above 127 belong to letters here
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_DEAL = np.uint32(2_654_435_761)


@dataclass(frozen=True)
class Model:
    languages: np.ndarray  # language of each centroid
    centroids: np.ndarray  # normalised, one in a row
    idf: np.ndarray
    least: np.ndarray  # cosine below which a text of the centroid is rejected


def _counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each bucket's grams occur in each text, one text in a row."""
    texts = len(bounds) - 1
    x = _FOLD[data].astype(np.uint32)
    doc = np.repeat(np.arange(texts), np.diff(bounds))
    out = []
    for n in (2, 3):
        if len(x) < n:
            out.append(np.zeros((texts, BUCKETS), np.float32))
            continue
        m = len(x) - n + 1
        gram = x[:m].copy()
        for k in range(1, n):
            gram = gram << np.uint32(8) | x[k : k + m]
        # inside one text, and not only blanks
        inside = (doc[n - 1 :] == doc[:m]) & ((gram & np.uint32(0xFFFF)) != np.uint32(0x2020))
        bucket = (gram * _DEAL) >> np.uint32(32 - 12)
        cell = doc[:m][inside] * BUCKETS + bucket[inside]
        counts = np.bincount(cell, minlength=texts * BUCKETS).astype(np.float32)
        out.append(counts.reshape(texts, BUCKETS))
    return np.hstack(out)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    norm = np.linalg.norm(weights, axis=1, keepdims=True)
    return (weights / np.maximum(norm, 1e-12)).astype(np.float32)


def _lowered(texts: pa.Array) -> pa.Array:
    return pa.array([(t.as_py() or "").lower() for t in texts], pa.large_string())


def _count_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for first, data, bounds in slices(_lowered(texts)):
        for low in range(0, len(bounds) - 1, TEXTS_AT_ONCE):
            some = bounds[low : low + TEXTS_AT_ONCE + 1]
            yield first + low, _counts(data[some[0] : some[-1]], some - some[0])


def _cluster(vectors: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """Normalised centroids by spherical k-means from a fixed start."""
    chosen = [int((vectors @ vectors.mean(0)).argmax())]
    best = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(turns):
        own = (vectors @ centroids.T).argmax(1)
        sums = np.stack([vectors[own == i].sum(0) for i in range(len(centroids))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids)
    return centroids.astype(np.float32)


def fit(docs: DataFrame, chosen: Column, seed: int = 7, train_texts: int = TRAIN_TEXTS) -> Model:
    """Fit a model on a sample of the rows that ``chosen`` allows and that have a text
    with a letter and a lang.

    About ``train_texts`` rows of each language are drawn by a hash of the row, whatever
    the table's size; only centroids reach the driver. A table without such rows gives a
    model that knows no language.
    """
    letter = F.col("text").rlike(r"\p{L}")
    known = docs.select("doc_id", "text", "lang", chosen.alias("_ok")).filter(
        F.col("_ok") & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(np.array([], object), np.zeros((0, 1)), np.zeros(1), np.zeros(0))
    shares = F.create_map(
        *[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, train_texts / n))]
    )
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.md5("text")), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts in _count_slices(batch.column(1)):
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": batch.column(0).slice(first, len(counts)),
                        "counts": [np.minimum(c, 255).astype(np.uint8).tobytes() for c in counts],
                    },
                    pa.schema([("lang", pa.string()), ("counts", pa.binary())]),
                )

    sample = durable(
        known.filter((draw < F.element_at(shares, F.col("lang"))) & letter)
        .select("lang", "text")
        .mapInArrow(count, "lang string, counts binary"),
        "language-sample",
    )

    def spread(frame: pd.DataFrame) -> np.ndarray:
        flat = np.frombuffer(b"".join(frame["counts"]), np.uint8)
        return flat.reshape(len(frame), -1).astype(np.float32)

    def presence(frame: pd.DataFrame) -> pd.DataFrame:
        seen = (spread(frame) > 0).sum(0).astype("<f8")
        return pd.DataFrame({"n": [len(frame)], "seen": [seen.tobytes()]})

    parts = sample.groupBy("lang").applyInPandas(presence, "n long, seen binary").collect()
    # languages weigh alike, however many texts each has
    shares_seen = [np.frombuffer(p.seen, "<f8") / p.n for p in parts]
    idf = np.log(1 + 1 / (np.mean(shares_seen, axis=0) + 1e-3)).astype(np.float32)

    def centroids(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("counts")
        vectors = _vectors(spread(frame), idf)
        found = _cluster(vectors, CENTROIDS)
        least = float((vectors @ found.T).max(1).min())
        return pd.DataFrame(
            {
                "lang": frame["lang"].iloc[0],
                "centroid": [c.astype("<f4").tobytes() for c in found],
                "least": least,
            }
        )

    rows = sorted(
        sample.groupBy("lang")
        .applyInPandas(centroids, "lang string, centroid binary, least double")
        .collect()
    )
    return Model(
        np.array([r.lang for r in rows], object),
        np.stack([np.frombuffer(r.centroid, "<f4") for r in rows]),
        idf,
        np.array([min(r.least * REJECT_SHARE, REJECT_COSINE) for r in rows]),
    )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected added.

    ``lang_pred`` is a learned language, or ``und`` for a null text, a text without a
    letter, or a model without languages; ``score`` is the cosine to the nearest
    centroid, from 0 to 1, and 0 for ``und``. ``rejected`` is true for ``und`` and for
    texts much farther from their centroid than the language's training texts. Existing columns with
    these names are replaced; every row is kept.
    """
    added = ("lang_pred", "score", "rejected")
    base = docs.select(*[c for c in docs.columns if c not in added])
    schema = base.selectExpr("*", "'' lang_pred", "0.0D score", "true rejected").schema
    names_out = [*base.columns, *added]
    at = base.columns.index("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            n = len(texts)
            names = np.full(n, UNKNOWN, object)
            score, rejected = np.zeros(n), np.ones(n, bool)
            if len(model.languages):
                for first, counts in _count_slices(texts):
                    near = _vectors(counts, model.idf) @ model.centroids.T
                    own = near.argmax(1)
                    best = near[np.arange(len(own)), own]
                    rows = slice(first, first + len(own))
                    names[rows] = model.languages[own]
                    score[rows] = np.clip(best, 0, 1)
                    rejected[rows] = best < model.least[own]
            none = np.array([not _LETTER.search(t.as_py() or "") for t in texts], bool)
            names[none], score[none], rejected[none] = UNKNOWN, 0.0, True
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(names, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=names_out,
            )

    return base.mapInArrow(label, schema)
