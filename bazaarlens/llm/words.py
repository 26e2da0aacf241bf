"""Words and word shingles of a text as arrays of 64-bit hashes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
Hashes of words and shingles are treated as the words and shingles themselves; two different ones meet
with a probability of 2**-64.
"""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5

_U = np.uint64
# The odd factors of splitmix64, xxhash and related mixers.
_FACTORS = tuple(map(_U, (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB,
)))
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[list(b" \t\n\x0b\x0c\r")] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of a value moves every bit of its result."""
    values = (values ^ (values >> _U(30))) * _FACTORS[3]
    values = (values ^ (values >> _U(27))) * _FACTORS[4]
    return values ^ (values >> _U(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=_U) * _FACTORS[0])
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[ord("A"):ord("Z") + 1] = _BYTE_VALUES[ord("a"):ord("z") + 1]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                row = np.full(size, base, _U)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))
        return self.up, self.down


_powers = _Powers()


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start and end in the bytes of a text."""
    gaps = np.flatnonzero(_SEPARATORS[data])
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(data)]))
    filled = ends > starts
    return starts[filled], ends[filled]


def _chunks(data: np.ndarray):
    """The text in parts of about a mebibyte that end between words."""
    at = 0
    while len(data) - at > _CHUNK:
        end = at + _CHUNK
        while end < len(data):
            found = np.flatnonzero(_SEPARATORS[data[end:end + _CHUNK]])
            if len(found):
                end += int(found[0])
                break
            end = min(len(data), end + _CHUNK)
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(raw: bytes, fold_case: bool = False) -> np.ndarray:
    """One hash per word, in order; with fold_case, A-Z count as a-z.

    A word's hash is a polynomial in its byte values. Prefix sums over the whole text, divided by the
    power at the word's start, give all of them without a loop over words.
    """
    values = _FOLDED_VALUES if fold_case else _BYTE_VALUES
    parts = []
    for data in _chunks(np.frombuffer(raw, np.uint8)):
        starts, ends = word_spans(data)
        up, down = _powers.first(len(data))
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(values[data] * up[:len(data)], out=sums[1:])
        parts.append(mixed((sums[ends] - sums[starts]) * down[starts]))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def window_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash for each run of so many words, five at most; none if there are fewer words.

    Hashes of words are random already, so a weighted sum of them is enough before the last mixing.
    """
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, _U)
    total = words[:n] * _FACTORS[0]
    for j in range(1, size):
        total += words[j:n + j] * _FACTORS[j]
    return mixed(total)


def shingle_set(raw: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles of so many words of a text, ascending.

    A text with fewer words has its whole sequence as the only shingle, a text without words none.
    """
    words = word_hashes(raw, fold_case=True)
    if 0 < len(words) < size:
        return window_hashes(words, len(words)) ^ _U(len(words))
    hashes = np.sort(window_hashes(words, size))
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))] if len(hashes) else hashes
