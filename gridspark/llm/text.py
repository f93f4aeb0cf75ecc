"""Words, shingles and hashes of Arrow string columns, computed for many rows at once with numpy.

All rules of this subpackage work on UTF-8 bytes: only A-Z are lower-cased, and every separator is one ASCII byte, so
byte positions and words agree with the code point definitions. Nulls count as empty texts. Work is cut into pieces
of whole texts, so that memory follows the piece (or the one longest text), not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are turned into numpy arrays at once; one longer text makes a piece of its own.
PIECE_BYTES = 1 << 17
#: Words of a shingle, unless an operator says otherwise.
SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes of ``[^\x20\x09-\x0D]+``.
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text: digits, letters, everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x41:0x5B] = ALPHANUMERIC[0x80:] = True
#: Word bytes of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: letters and everything beyond ASCII.
LETTERS = ALPHANUMERIC.copy()
LETTERS[0x30:0x3A] = False
#: Lines: everything but the line feed.
LINES = np.ones(256, dtype=bool)
LINES[0x0A] = False

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=64)
def _order(width: int) -> np.ndarray:
    """One odd factor for each place in a window."""
    return mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)


class Piece:
    """Some whole texts: ``data`` holds their bytes, text ``i`` being ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1
        self.lower = _LOWER[data]

    def spans(self, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every run of ``word_bytes``, and the index of each text's first run (one more at the end)."""
        inside = word_bytes[self.data]
        before = np.zeros(len(inside) + 1, dtype=bool)
        before[1:] = inside
        cut = np.zeros(len(inside) + 1, dtype=bool)
        cut[self.offsets] = True
        starts = np.flatnonzero(inside & (~before[:-1] | cut[:-1]))
        after = np.zeros(len(inside) + 1, dtype=bool)
        after[:-1] = inside
        ends = np.flatnonzero(inside & (~after[1:] | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self, word_bytes: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The lower-cased runs of ``word_bytes``, equal ones under one code, and the text that each is in."""
        starts, ends, first = self.spans(word_bytes)
        where = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=where[1:])
        data = self.lower[word_bytes[self.data]]
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(data))
        return found.dictionary_encode(), np.repeat(np.arange(self.n), np.diff(first))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each lower-cased span: its blocks of eight bytes are mixed in one after the other."""
        padded = np.zeros(len(self.lower) + 8, dtype=np.uint8)
        padded[: len(self.lower)] = self.lower
        blocks = np.ndarray(len(self.lower) + 1, dtype="<u8", buffer=padded, strides=(1,))
        left = ends - starts
        out = mix(left.astype(np.uint64) + _STEP)
        of, at = np.flatnonzero((left > 0) & (left <= LONG_WORD)), starts
        while len(of):
            bits = np.minimum(left[of], 8).astype(np.uint64) * np.uint64(8)
            own = blocks[at[of]] & (~np.uint64(0) >> (np.uint64(64) - bits))
            out[of] = mix(out[of] ^ own) + _STEP
            left, at = left - 8, at + 8
            of = of[left[of] > 0]
        for i in np.flatnonzero(ends - starts > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.lower[starts[i] : ends[i]].tobytes())
        return mix(out)


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of an Arrow string array in pieces of about ``limit`` bytes, in order."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield Piece(at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive word hashes; the caller drops those that cross texts."""
    count = max(0, len(words) - width + 1)
    total = np.full(count, width, dtype=np.uint64)
    for j, factor in enumerate(_order(width)):
        total += words[j : j + count] * factor
    return mix(total)


def shingle_sets(piece: Piece, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one, a text without words none."""
    starts, ends, first = piece.spans(BLANK_SEPARATED)
    words = piece.hashes(starts, ends)
    all_grams = grams(words, width)
    sets = []
    for i in range(piece.n):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            own = np.sort(all_grams[a : b - width + 1])
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            sets.append(grams(words[a:b], int(b - a)) if b > a else np.zeros(0, dtype=np.uint64))
    return sets
