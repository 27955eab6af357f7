"""Words, shingles and hashes of whole Arrow batches, as array arithmetic over their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.llm.common import flat_bytes, slices

#: Odd, so that it has an inverse modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32
#: Byte values are replaced by fixed random words, so that the polynomial has no small coefficients.
BYTE_WORD = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text (n + 1 values).

    A word is a maximal run of bytes other than those flagged in ``between`` (space and 0x09-0x0D), inside one text.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~between[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    first = np.flatnonzero(begins)
    last = np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets, side="left")


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal words wherever they stand."""
    powers = np.full(len(data) + 1, BASE, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_WORD[data] * powers[:-1], out=sums[1:])
    back = np.full(len(data) + 1, INVERSE, dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    value = (sums[last] - sums[first]) * back[first]
    return mix64(value + (last - first).astype(np.uint64))


def hashed_words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a string column, and where each text's words begin (n + 1 values)."""
    data, offsets = flat_bytes(column)
    if lower:
        data = LOWERED[data]
    first, last, at = word_bounds(data, offsets)
    return word_hashes(data, first, last), at


def count_words(text: Column) -> Column:
    """The number of words of a whole text; null has none."""

    @F.arrow_udf("bigint")
    def counted(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), dtype=np.int64)
        for start, end in slices(column):
            data, offsets = flat_bytes(column.slice(start, end - start))
            out[start:end] = np.diff(word_bounds(data, offsets)[2])
        return pa.array(out)

    return counted.asNondeterministic()(text)
