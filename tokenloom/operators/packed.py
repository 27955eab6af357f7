"""A piece vocabulary as a few flat arrays, and greedy splitting of many words at once.

A hash table would take some 250 bytes a piece in every Python worker. Here a piece
takes its own bytes and about 22 more: its end, its id, and an open-addressed slot
of place and tag. All substrings of all words are hashed from one prefix sum, so a
step of the greedy rule is a handful of array operations for all words together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Slots per piece, and the bytes of a piece beside its own.
ROOM, PIECE_BYTES = 1.6, 22
FREE = -1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Substrings:
    """Hashes of any stretches of some bytes: equal for equal stretches, wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.data = data
        powers = np.full(len(data) + 1, BASE, dtype=np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.powers = powers
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self.sums[1:])
        back = np.full(len(data) + 1, pow(BASE, -1, 1 << 64), dtype=np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        self.back = back

    def hashes(self, begin: np.ndarray, size: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """Of the stretches of ``size`` bytes, or of those with the bytes ``prefix`` before them."""
        value = (self.sums[begin + size] - self.sums[begin]) * self.back[begin]
        if prefix is not None and len(prefix):
            head = sum((int(b) + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(prefix)) % (1 << 64)
            value = value * np.uint64(pow(BASE, len(prefix), 1 << 64)) + np.uint64(head)
        return mixed(value)


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after the other, and the n + 1 offsets; null is empty."""
    wide = column.cast(pa.large_string()).fill_null("")
    if not len(wide):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, dtype=np.uint8)
    return raw, ends - ends[0]


class PackedPieces:
    """Pieces, found by their bytes. Of pieces that occur twice the lowest id counts."""

    def __init__(self, blob: np.ndarray, ends: np.ndarray, ids: np.ndarray, slots: np.ndarray, tags: np.ndarray):
        self.blob, self.ends, self.ids, self.slots, self.tags = blob, ends, ids, slots, tags

    @classmethod
    def build(cls, pieces: pa.Array, ids: np.ndarray) -> PackedPieces:
        order = np.argsort(ids, kind="stable")
        blob, ends = flat_text(pieces.take(pa.array(order)))
        ids = np.asarray(ids)[order].astype(np.int32)
        starts, sizes = ends[:-1], np.diff(ends)
        ends = ends.astype(np.int32 if ends[-1] < 1 << 31 else np.int64)
        packed = cls(blob, ends, ids, np.full(int(len(ids) * ROOM) + 2, FREE, dtype=np.int32), np.zeros(0, dtype=np.uint16))
        packed.tags = np.zeros(len(packed.slots), dtype=np.uint16)
        h = Substrings(blob).hashes(starts, sizes)
        left, probe = np.arange(len(ids)), packed._slot(h)
        while len(left):
            free = np.flatnonzero(packed.slots[probe] == FREE)
            _, first = np.unique(probe[free], return_index=True)
            won = free[first]
            packed.slots[probe[won]] = left[won]
            packed.tags[probe[won]] = h[left[won]].astype(np.uint16)
            keep = np.ones(len(left), dtype=bool)
            keep[won] = False
            left, probe = left[keep], (probe[keep] + 1) % len(packed.slots)
        return packed

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(len(self.slots)) >> np.uint64(32)).astype(np.int64)

    def arrays(self) -> list[np.ndarray]:
        return [self.blob, self.ends, self.ids, self.slots, self.tags]

    def lengths(self, prefix: bytes = b"") -> np.ndarray:
        """The byte lengths of pieces that begin with ``prefix``, longest first, without it."""
        size = np.diff(self.ends)
        own = size >= len(prefix)
        for i, b in enumerate(prefix):
            own[own] &= self.blob[self.ends[:-1][own] + i] == b
        return np.unique(size[own] - len(prefix))[::-1]

    def find(self, text: Substrings, begin: np.ndarray, size: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """The id of the piece that spells ``prefix`` and each stretch, -1 where there is none."""
        h = text.hashes(begin, size, prefix)
        out = np.full(len(begin), -1, dtype=np.int64)
        probe, tag, left = self._slot(h), h.astype(np.uint16), np.arange(len(begin))
        while len(left):
            at = self.slots[probe[left]]
            left, at = left[at != FREE], at[at != FREE]
            like = np.flatnonzero(self.tags[probe[left]] == tag[left])
            same = np.zeros(len(left), dtype=bool)
            same[like] = self._spells(text.data, begin[left[like]], size[left[like]], prefix, at[like])
            # Equal pieces lie one behind the other; the first one placed has the lowest id.
            out[left[same]] = self.ids[at[same]]
            left = left[~same]
            probe[left] = (probe[left] + 1) % len(self.slots)
        return out

    def _spells(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, prefix: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece is, byte for byte, the prefix and the stretch."""
        start = self.ends[piece].astype(np.int64)
        same = self.ends[piece + 1] - start == size + len(prefix)
        for i, b in enumerate(prefix):
            same[same] &= self.blob[start[same] + i] == b
        rows = np.flatnonzero(same & (size > 0))
        if len(rows):
            n = size[rows]
            first = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(first, n)
            equal = data[np.repeat(begin[rows], n) + step] == self.blob[np.repeat(start[rows] + len(prefix), n) + step]
            same[rows] = np.logical_and.reduceat(equal, first)
        return same


def split_words(column: pa.Array, pieces: PackedPieces, unknown: int, continuation: str, max_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy pieces of each word: ids, the characters each covers, and where each word's pieces begin (n + 1 values).

    A word that is a piece is that piece. Words without letters, of more than
    ``max_chars`` characters, or with a stretch that no piece begins, are the unknown piece.
    """
    data, offsets = flat_text(column)
    text, prefix = Substrings(data), np.frombuffer(continuation.encode(), dtype=np.uint8)
    none = prefix[:0]
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    words = len(offsets) - 1
    size = np.diff(offsets)
    length = chars[offsets[1:]] - chars[offsets[:-1]]
    whole = pieces.find(text, offsets[:-1], size, none)
    active = np.flatnonzero((whole < 0) & (length >= 1) & (length <= max_chars))
    at = offsets[active]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    failed = np.zeros(words, dtype=bool)
    turn = 0
    by_turn = pieces.lengths(), pieces.lengths(continuation.encode())
    while len(active):
        best, n_best = np.full(len(active), -1, dtype=np.int64), np.zeros(len(active), dtype=np.int64)
        room = offsets[active + 1] - at
        for n in by_turn[min(turn, 1)]:
            if not n:
                continue
            open_ = np.flatnonzero((best < 0) & (room >= n))
            if len(open_):
                best[open_] = pieces.find(text, at[open_], np.full(len(open_), n, dtype=np.int64), prefix if turn else none)
                n_best[open_[best[open_] >= 0]] = n
        hit = best >= 0
        failed[active[~hit]] = True
        found.append((active[hit], best[hit], chars[at[hit] + n_best[hit]] - chars[at[hit]]))
        active, at = active[hit], at[hit] + n_best[hit]
        more = at < offsets[active + 1]
        active, at = active[more], at[more]
        turn += 1
    single = np.flatnonzero((whole >= 0) | (length < 1) | (length > max_chars) | failed)
    parts = [(w[~failed[w]], i[~failed[w]], n[~failed[w]]) for w, i, n in found]
    parts.append((single, np.where(whole[single] >= 0, whole[single], unknown), length[single]))
    owner, ids, covered = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(owner, kind="stable")  # a word's pieces were found in their order
    return ids[order].astype(np.int32), covered[order].astype(np.int32), np.searchsorted(owner[order], np.arange(words + 1))
