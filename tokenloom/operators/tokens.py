"""The tokens of T3 for whole Arrow batches, by table look-ups over their distinct stretches.

Blanks end every token, so a text falls into stretches that can be looked at one by one, and
most of them repeat. A batch normalises and cuts its *distinct* stretches only, all of them at
once. What becomes of a character, and whether it is part of a word, a token of its own or
white space, is asked of the column functions once per session: both ways agree on every
character, whichever Unicode version the JVM knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import TOKEN_PATTERN, folded

CODES = 0x110000
#: Private use, which is deleted, and planes without characters, which would be a word's: not worth asking for.
PRIVATE, EMPTY = ((0xE000, 0xF8FF), (0xF0000, 0x10FFFF)), ((0xD800, 0xDFFF), (0x40000, 0xDFFFF))
SPACE, WORD, SINGLE = 0, 1, 2
#: Bytes of text looked at at once inside a task; a longer text stands alone.
BYTES_AT_ONCE = 8 << 20


@dataclass
class Characters:
    """Characters that are not simply a word's own: their codes, what they become (one string after the other, with its ends), their kinds."""

    codes: np.ndarray
    becomes: np.ndarray
    ends: np.ndarray
    kinds: np.ndarray

    @cached_property
    def kind(self) -> np.ndarray:
        out = np.full(CODES, WORD, dtype=np.uint8)
        out[self.codes] = self.kinds
        return out

    @cached_property
    def size(self) -> np.ndarray:
        """How many characters each becomes."""
        out = np.ones(CODES, dtype=np.uint8)
        out[self.codes] = np.diff(self.ends, prepend=0)
        return out

    @cached_property
    def first(self) -> np.ndarray:
        """What each becomes, or where its string of several begins."""
        out = np.arange(CODES, dtype=np.int32)
        size, begin = np.diff(self.ends, prepend=0), np.concatenate([[0], self.ends[:-1]])
        out[self.codes[size == 1]] = self.becomes[begin[size == 1]]
        out[self.codes[size > 1]] = begin[size > 1]
        return out

    def fold(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the characters become, and which of them each result comes from."""
        size = self.size[codes]
        if (size == 1).all():
            return self.first[codes], np.arange(len(codes))
        source = np.repeat(np.arange(len(codes)), size)
        out = self.first[codes[source]]
        several = np.flatnonzero(size[source] > 1)
        place = np.arange(len(source)) - np.repeat(np.cumsum(size, dtype=np.int64) - size, size)
        out[several] = self.becomes[out[several] + place[several]]
        return out, source


_SHARED: dict[str, Broadcast] = {}


def shared_characters(spark: SparkSession) -> Broadcast:
    """What makes up the ``Characters`` on every executor, worked out and sent once per session."""
    key = spark.sparkContext.applicationId
    if key not in _SHARED:
        code = F.col("id")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        left_out = reduce(or_, [code.between(*r) for r in (*PRIVATE, *EMPTY)])
        every = spark.range(CODES).filter(~left_out).select(code, char.alias("char"))
        kind = F.size(F.regexp_extract_all(F.concat("char", "char"), F.lit(TOKEN_PATTERN), F.lit(0)))
        known = every.select("id", "char", folded(F.col("char")).alias("becomes"), kind.alias("kind")).toArrow()  # a row per character
        special = pc.or_(pc.not_equal(known.column("becomes"), known.column("char")), pc.not_equal(known.column("kind"), WORD))
        rows = known.filter(special)
        becomes = rows.column("becomes").to_pylist()
        flat = np.frombuffer("".join(becomes).encode("utf-32-le"), dtype=np.uint32).astype(np.int32)
        ends = np.cumsum([len(b) for b in becomes], dtype=np.int64)
        gone = np.concatenate([np.arange(low, high + 1) for low, high in PRIVATE])
        codes, kinds = (np.concatenate([rows.column(c).to_numpy(), more]) for c, more in (("id", gone), ("kind", np.full(len(gone), WORD))))
        ends = np.concatenate([ends, np.full(len(gone), len(flat))])
        _SHARED[key] = spark.sparkContext.broadcast((codes, flat, ends, kinds.astype(np.uint8)))
    return _SHARED[key]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after the other, and the n + 1 offsets; null is empty. Nothing is checked."""
    wide = column.cast(pa.large_binary()).fill_null(b"")
    if not len(wide):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, dtype=np.uint8)
    return raw, ends - ends[0]


def _strings(data: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 stretches, and the stretch of each."""
    raw = data.tobytes()
    try:
        text = raw.decode("utf-8")
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        sizes = np.diff(lead[bounds])
    except UnicodeDecodeError:  # broken bytes become U+FFFD, as in the JVM, and are deleted
        parts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        text, sizes = "".join(parts), np.array([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), np.repeat(np.arange(len(sizes)), sizes)


def stretch_tokens(stretches: pa.Array, characters: Characters) -> tuple[pa.Array, np.ndarray]:
    """The tokens of binary stretches, one after the other, and where each stretch's begin (n + 1 values)."""
    data, bounds = _flat(stretches)
    codes, owner = _codes(data, bounds)
    codes, source = characters.fold(codes)
    owner, kind = owner[source], characters.kind[codes]
    begins = kind != SPACE
    # A word goes on where the character before is a word's too, and of the same stretch.
    begins[1:] &= (kind[1:] != WORD) | (kind[:-1] != WORD) | (owner[1:] != owner[:-1])
    inside = kind != SPACE
    codes, owner, begins = codes[inside], owner[inside], np.flatnonzero(begins[inside])
    width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.cumsum(width)
    raw = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), dtype=np.uint8)
    tokens = _strings(raw, np.append(ends[begins[1:] - 1], ends[-1:]) if len(begins) else ends[:0], pa.string())
    return tokens, np.searchsorted(owner[begins], np.arange(len(stretches) + 1))


def text_slices(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Texts some BYTES_AT_ONCE at a time: dictionary-encoded stretches, and where each text's begin (n + 1 values)."""
    begin, sizes = 0, _flat(texts)[1]
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + BYTES_AT_ONCE, side="right")) - 1)
        data, offsets = _flat(texts.slice(begin, stop - begin))
        # A stretch ends with its blank or line feed, or with its text.
        last = (data == 0x20) | (data == 0x0A)
        last[offsets[1:][np.diff(offsets) > 0] - 1] = True
        ends = np.flatnonzero(last) + 1
        yield _strings(data, ends, pa.binary()).dictionary_encode(), np.searchsorted(ends, offsets, side="right")
        begin = stop


def slice_counts(texts: pa.Array, characters: Characters) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The distinct tokens of each slice of texts, and how often each occurs in it."""
    for stretches, _ in text_slices(texts):
        times = np.bincount(stretches.indices.to_numpy(), minlength=len(stretches.dictionary))
        tokens, at = stretch_tokens(stretches.dictionary, characters)
        words = tokens.dictionary_encode()
        # Weights are added up as doubles: whole numbers far below 2^53.
        found = np.bincount(words.indices.to_numpy(), weights=np.repeat(times, np.diff(at)), minlength=len(words.dictionary))
        yield words.dictionary, pa.array(found.astype(np.int64))
