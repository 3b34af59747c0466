"""Word-shingle hashes of whole texts, computed on the byte buffers of Arrow batches.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z. A shingle is
five consecutive words; a text with fewer words has the whole sequence as its only
shingle, and a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
SLICE_BYTES = 1_000_000  # bounds the memory of one vectorised step, whatever the batch


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULT = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
for _b in range(65, 91):  # A-Z count as a-z
    _BYTE_VALUE[_b] = _BYTE_VALUE[_b + 32]
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLACES = np.array([pow(_MULT, 2 * k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, kept in the worker."""
    if len(_TABLES.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
    return _TABLES["up"], _TABLES["down"]


def hash_shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 64-bit hash) of every shingle, in text order.

    ``data`` holds the UTF-8 bytes of all texts; text i is data[bounds[i]:bounds[i+1]].
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none
    # a word ends at a blank and at the end of a text
    word = ~_IS_BLANK[data]
    cuts = np.zeros(len(data) + 1, bool)
    cuts[bounds] = True
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | cuts[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | cuts[1:])) + 1
    if not len(starts):
        return none
    # polynomial prefix sums modulo 2**64 give the hash of any byte range
    up, down = _powers(len(data) + 1)
    prefix = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE_VALUE[data] * up[: len(data)])))
    words = mix64((prefix[ends] - prefix[starts]) * down[starts])
    doc = np.searchsorted(bounds, starts, side="right") - 1
    # five words where the document goes on so long
    n = len(words)
    full = np.zeros(n, np.uint64)
    ok = np.zeros(n, bool)
    if n >= WORDS:
        m = n - WORDS + 1
        ok[:m] = doc[WORDS - 1 :] == doc[:m]
        for k in range(WORDS):
            full[:m] += words[k : k + m] * _PLACES[k]
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    count = np.diff(np.append(np.flatnonzero(first), n))
    short = np.flatnonzero(first)[count < WORDS]
    full[short] = 0
    for k in range(WORDS - 1):
        at = short[count[count < WORDS] > k]
        full[at] += words[at + k] * _PLACES[k]
    ok[short] = True
    return doc[ok], mix64(full[ok])


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts of an Arrow string array as (first row, bytes, bounds), of at
    most SLICE_BYTES unless one text alone is longer. Nulls are empty texts."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        texts.offset : texts.offset + len(texts) + 1
    ].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(at, at[low] + SLICE_BYTES, side="right")) - 1
        high = min(max(high, low + 1), len(texts))
        yield low, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Distinct shingles by slice: (first row, bounds, hashes); the set of row
    first + i is hashes[bounds[i]:bounds[i + 1]], ascending."""
    for low, data, bounds in slices(texts):
        doc, hashes = hash_shingles(data, bounds)
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        doc, hashes = doc[keep], hashes[keep]
        yield low, np.searchsorted(doc, np.arange(len(bounds))), hashes
