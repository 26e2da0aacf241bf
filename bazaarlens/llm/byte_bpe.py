"""Byte-level BPE encoding and decoding without a merge loop.

Bytes are mapped to Latin-1 characters so that the trie of an Aho-Corasick automaton over the vocabulary
finds the longest token at a position. Encoding walks from left to right: take the
longest token, check that it can stand next to the one before, else try its longest proper prefix that
is a token, else give up the previous token and continue from there. A pair of tokens is compatible if merging by
rank would not have merged across their border; this follows from how the two are themselves
merged, and is memoised. The one sequence in which all neighbours are compatible is the one that
merging by rank gives, and each position is left for good at most once, so the work is linear.

Texts are split by the tokenizer's pattern first. Pieces repeat, so their ids are memoised too, in a cache of
bounded size that a task gives back when it ends; a worker keeps the vocabulary alone.

Defined results: a null text is encoded as the empty one, which has no tokens; rows stay as many as they
were, repeated ones with equal ids; bytes that are not UTF-8 are encoded as the U+FFFD that Python's decoder puts in their place;
long texts are encoded whole; of tokens that fit, the longest compatible one is unique, so there are no ties.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bazaarlens.llm.tables import raw_texts

CACHED_PIECES = 250_000
CACHED_PAIRS = 250_000
LONGEST_CACHED = 64

# The letters, digits and white space of Latin-1, in the categories of the split pattern.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\t-\r \x85\xa0"
#: The tokenizer's pattern for texts within Latin-1, where its Unicode classes are short lists.
_LATIN_PATTERN = re.compile(
    rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+"
    rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder for a vocabulary of byte strings by rank; every single byte must be in it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        self.most_bytes = max(map(len, ranks))
        self.ids: dict[str, int] = {}
        self.paths: dict[str, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            parts = self._merged(token, rank)
            if len(parts) > 2:
                continue  # no merge makes it: only a piece that equals it can have it
            if len(parts) == 2:
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
                self.merges[self.halves[rank]] = rank
            name = token.decode("latin-1")
            self.ids[name] = rank
            self.automaton.add_word(name, rank)

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """The parts that the merges of lower rank make of a token's bytes."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    @functools.lru_cache(maxsize=None)  # one entry per token at most
    def shorter(self, token: int) -> int | None:
        """The longest proper prefix of a token that is a token too."""
        whole = self.bytes_of[token].decode("latin-1")
        return next((self.ids[whole[:end]] for end in range(len(whole) - 1, 0, -1) if whole[:end] in self.ids), None)

    def longest(self, piece: str, at: int) -> int:
        """The longest token at a position: the last one on the path that the trie follows there."""
        ahead = piece[at:at + self.most_bytes]
        path = ahead[:self.automaton.longest_prefix(ahead)]
        token = self.paths.get(path)
        if token is None:
            end = next(end for end in range(len(path), 0, -1) if path[:end] in self.ids)
            token = self.paths[path] = self.ids[path[:end]]  # one entry per node of the trie at most
        return token

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between two neighbouring tokens alone.

        Undo the merges of both sides, the latest first. The border would have vanished if the two parts
        at it merge by a rank below that of the merge undone last.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, limit, fine = left, right, len(self.ranks) + 1, True
        while True:
            merged = self.merges.get((a, b))
            if merged is not None and merged < limit:
                fine = False
                break
            if a > b:
                if a not in self.halves:
                    if b not in self.halves:
                        break
                    limit, b = b + 1, self.halves[b][0]
                else:
                    limit, a = a, self.halves[a][1]
            elif b in self.halves:
                limit, b = b + 1, self.halves[b][0]
            elif a in self.halves:
                limit, a = a, self.halves[a][1]
            else:
                break
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = fine
        return fine

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        text, n = piece.decode("latin-1"), len(piece)
        alive = bytearray(b"\x01") * (n + 1)  # positions not yet given up
        tokens: list[int] = []
        at, token = 0, self.longest(text, 0)
        while at < n:
            while token is not None:
                end = at + len(self.bytes_of[token])
                if alive[end] and (not tokens or self.compatible(tokens[-1], token)):
                    break
                token = self.shorter(token)
            if token is not None:
                tokens.append(token)
                at = end
                token = self.longest(text, at) if at < n else None
            else:  # nothing fits here: go back and try a shorter token in place of the last
                alive[at] = 0
                last = tokens.pop()
                at -= len(self.bytes_of[last])
                token = self.shorter(last)
        return tuple(tokens)

    def encode(self, text: str) -> list[int]:
        try:
            text.encode("latin-1")
            found = _LATIN_PATTERN.findall(text)
        except UnicodeEncodeError:
            found = self.pattern.findall(text)
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        pieces, out = self.pieces, []
        for piece in found:
            ids = pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= LONGEST_CACHED:
                    pieces[piece] = ids
            out.append(ids)
        return list(chain.from_iterable(out))

    def forget(self) -> None:
        self.pieces.clear()
        self.pairs.clear()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the token ids of each text; ``path`` is a rank file that every executor has."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            for part in _slices(batch):
                ids = [bpe.encode(raw.decode(errors="replace")) for raw in raw_texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(encoded, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded again."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for raw in raw_texts(batch.column(1)):
                ids = bpe.encode(raw.decode(errors="replace"))
                counts.append(len(ids))
                encoded.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(
        digested, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that the ids of few documents are held at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text that the ids stand for; bytes that are no UTF-8 become U+FFFD."""
    schema = T.StructType([
        T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("text", T.StringType()),
    ])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or ()).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, schema)
