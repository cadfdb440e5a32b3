"""Word shingles of whole texts, hashed for a batch at once with NumPy.

All texts of an Arrow batch are looked at as one run of UTF-8 bytes: blanks are found with one
comparison, word hashes come from lanes of eight bytes, shingle hashes from the hashes of
neighbouring words.  Nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Capital ASCII letters as their small letters.
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed in one go, so that working arrays stay small.
PIECE = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _hash_piece(raw: np.ndarray) -> np.ndarray:
    """Word hashes of a piece that no word crosses.  A word is read in lanes of eight bytes, each
    mixed with its place, so words of up to eight bytes never share a hash with one of their length."""
    blank = _BLANK[raw]
    edge = np.diff(blank.view(np.int8), prepend=1, append=1)
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    lanes = (last - first + 7) >> 3
    start = np.cumsum(lanes) - lanes
    place = np.arange(start[-1] + lanes[-1]) - np.repeat(start, lanes)
    at = np.repeat(first, lanes) + 8 * place
    unused = 8 * (8 - np.minimum(np.repeat(last, lanes) - at, 8))
    padded = np.concatenate([_SMALL[raw], np.zeros(8, dtype=np.uint8)])
    # the eight bytes from every place on, of which only the lanes are read
    lane = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))[at]
    lane &= ~_U(0) >> unused.astype(np.uint64)
    mixed = mix(lane ^ mix(place.astype(np.uint64) + _U(1)))
    return mix(np.add.reduceat(mixed, start) + (last - first).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of one text, in order.  ``raw``: its UTF-8 bytes.  Long texts
    are hashed in pieces that end at a blank, so a word's hash does not depend on its place."""
    done, start = [], 0
    while start < len(raw):
        end = start + PIECE
        if end < len(raw):
            blanks = np.flatnonzero(_BLANK[raw[start:end]])
            while not len(blanks) and end < len(raw):  # a word longer than a piece
                blanks = np.flatnonzero(_BLANK[raw[start : (end := end + PIECE)]])
            end = start + int(blanks[-1]) + 1 if len(blanks) else len(raw)
        done.append(_hash_piece(raw[start:end]))
        start = end
    return np.concatenate(done) if done else np.zeros(0, dtype=np.uint64)


def shingle_set(raw: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of one text; with fewer words, the
    whole sequence is one shingle; without words, none."""
    words = word_hashes(raw)
    if not len(words):
        return words
    width = min(size, len(words))
    h = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        h = mix(h + words[k : len(words) - width + 1 + k])
    if width < size:
        h = mix(h + _U(width))
    return np.unique(h)


def texts_as_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield raw[at[k] : at[k + 1]] if valid[k] else raw[:0]
