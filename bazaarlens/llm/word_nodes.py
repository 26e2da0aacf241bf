"""Words of many texts at once, and hashes of them and of their first letters, as arrays.

Texts are lower-cased and read as code points. A word is a run of letters; in scripts without spaces between words, where
a run is a clause, every two neighbouring letters are one instead. What is known of a word are nodes: its first four, five
and six letters, if it has more, and the whole word. A node is its 64-bit hash, and different ones meet with a
probability of 2**-64.

Bytes that are not UTF-8 are read as replacement characters, which are no letters. Long texts are cut between words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from bazaarlens.llm.quality import UNSPACED_SCRIPTS
from bazaarlens.llm.tables import raw_texts
from bazaarlens.llm.words import _powers, mixed

PREFIXES = (4, 5, 6)
#: Code points that are worked on at once.
CHUNK = 1 << 19

_U = np.uint64
_WHOLE = _U(0x5851F42D4C957F2D)
_ROW = _U(0x9E3779B97F4A7C15)
_LETTERS = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")


@lru_cache(maxsize=1)
def _points() -> tuple[np.ndarray, np.ndarray]:
    """For every code point, its kind (0 none, 1 letter, 2 letter of a script without spaces) and a hash."""
    kinds = np.zeros(0x110000, np.uint8)
    for run in _LETTERS.finditer("".join(map(chr, range(0x110000)))):
        kinds[run.start():run.end()] = 1
    for low, high in UNSPACED_SCRIPTS:
        part = kinds[low:high + 1]
        part[part > 0] = 2
    return kinds, mixed(np.arange(1, 0x110001, dtype=_U) * _ROW)


class Units:
    """The words of texts, in order: where they start and end, their keys, and where each text's words begin."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, hashes = _points()
        kind = np.concatenate(([0], kinds[points], [0])).astype(np.uint8)
        before, here, after = kind[:-2], kind[1:-1], kind[2:]
        pairs = here == 2
        self.starts = np.flatnonzero(((here == 1) & (before != 1)) | (pairs & ((after == 2) | (before != 2))))
        self.ends = self.starts + 1 + (after[self.starts] == 2)
        self.ends[here[self.starts] == 1] = np.flatnonzero((here == 1) & (after != 1)) + 1
        up, down = _powers.first(len(points) + 1)
        self._down, self._sums = down, np.zeros(len(points) + 1, _U)
        np.cumsum(hashes[points] * up[:len(points)], out=self._sums[1:])
        self.keys = self._hash(self.starts, self.ends) ^ _WHOLE
        self.lengths = self.ends - self.starts
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.edges = self.starts.searchsorted(begins)

    def _hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def prefix_keys(self, which: np.ndarray, size: int) -> np.ndarray:
        """Keys of the first letters of some words, which are longer."""
        return self._hash(self.starts[which], self.starts[which] + size)


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > CHUNK:
        gap = _GAP.search(text, at + CHUNK)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:]


def chunks(column: pa.Array) -> Iterator[list[tuple[int, str]]]:
    """(row, lower-case text) of a column, in lists of about a chunk; a long text in several pieces."""
    held, size = [], 0
    for row, raw in enumerate(raw_texts(column)):
        for piece in _pieces(raw.decode(errors="replace").lower()):
            held.append((row, piece))
            size += len(piece) + 1
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def by_row(column: pa.Array, measure: Callable[[Units], np.ndarray]) -> Iterator[np.ndarray]:
    """For each text, what is measured of its words, one number each."""
    row, held = 0, []
    for pieces in chunks(column):
        units = Units([text for _, text in pieces])
        values = measure(units)
        for (at, _), low, high in zip(pieces, units.edges, units.edges[1:], strict=False):
            if at != row:
                yield np.concatenate(held) if len(held) > 1 else held[0]
                row, held = at, []
            held.append(values[low:high])
    if held:
        yield np.concatenate(held) if len(held) > 1 else held[0]


# --- nodes ---

def _distinct(*columns: np.ndarray) -> np.ndarray:
    """The first row of each combination of the first two columns."""
    return np.unique(mixed(columns[0] * _ROW + columns[1]), return_index=True)[1]


def distinct_nodes(column: pa.Array) -> list[np.ndarray]:
    """row, key, level and parent of every node that a text has, once per text.

    Levels 0 to 2 are prefixes by their length, 3 is the whole word. A node's parent is the longest prefix below it, 0 if none.
    """
    found = []
    for pieces in chunks(column):
        units = Units([text for _, text in pieces])
        row = np.repeat(np.array([at for at, _ in pieces], _U), np.diff(units.edges))
        at = _distinct(row, units.keys)
        length = units.lengths[at]
        longest = np.zeros(len(at), _U)
        for level, size in enumerate(PREFIXES):
            longer = length > size
            key = np.zeros(len(at), _U)
            key[longer] = units.prefix_keys(at[longer], size)
            one = _distinct(row[at][longer], key[longer])
            found.append([x[longer][one] for x in (row[at], key, np.full(len(at), level, _U), longest)])
            longest = np.where(longer, key, longest)
        found.append([row[at], units.keys[at], np.full(len(at), len(PREFIXES), _U), longest])
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, _U)] * 4
    one = _distinct(columns[0], columns[1])
    return [x[one] for x in columns]


class NodeScores:
    """Scores of nodes, looked up for many words at once."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray):
        order = np.argsort(keys)
        self.keys = np.append(keys[order], _U((1 << 64) - 1))
        self.scores = np.append(scores[order], np.nan)
        # Keys are hashes, so the first bits of one say nearly where it is.
        bits = max(1, min(22, len(keys).bit_length()))
        self.shift = _U(64 - bits)
        self.first = self.keys[:-1].searchsorted(np.arange(1 << bits, dtype=_U) << self.shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The scores of these nodes, NaN where none is known."""
        place = self.first[keys >> self.shift]
        short = np.flatnonzero(self.keys[place] < keys)
        while len(short):
            place[short] += 1
            short = short[self.keys[place[short]] < keys[short]]
        return np.where(self.keys[place] == keys, self.scores[place], np.nan)

    def of_words(self, units: Units) -> np.ndarray:
        """For each word the score of the longest node that is known, 0 if none is."""
        distinct, at, place = np.unique(units.keys, return_index=True, return_inverse=True)
        scores = self.find(distinct)
        for size in reversed(PREFIXES):
            open_ = np.flatnonzero(np.isnan(scores) & (units.lengths[at] > size))
            scores[open_] = self.find(units.prefix_keys(at[open_], size))
        return np.nan_to_num(scores, nan=0.0)[place]
