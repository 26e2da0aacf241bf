import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from bazaarlens.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def both(request):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(request.param))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN), library


ALPHABETS = (
    "aab ", "the andinger ", "abcdefghijklmnopqrstuvwxyz'", "äöüßéèñ中文字🙂 \n\t0123456789²½", "  \n \r\x85\xa0\x1c e",
    "<|endoftext|>", "!?.,;:()[]{}#*$%", "̀‍١Ⅷ x",
)


def test_same_ids_as_the_library(both):
    ours, library = both
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, 60)))
        ids = ours.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert ours.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 30_000, " " * 20_000 + "x", "é" * 20_000, "🙂" * 10_000, "1" * 30_000])
def test_long_pieces(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_tokens_that_no_merge_makes():
    """A vocabulary with such a token: a piece that equals it has it, others do not."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abcd": 257, b"aa": 258, b"aaa": 259}
    ours = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abcd", "abcdx", "xabcd", "aaaa", "aaaaaaa", "aaab", "abab"):
        assert ours.encode(text) == library.encode_ordinary(text), text


def test_query_rows(corpus_docs, both):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={},
    )
    got = {r.doc_id: r for r in byte_bpe.round_trip(corpus_docs, PATH, public_tokenizers.PATTERN).collect()}
    for r in corpus_docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((r.text or "").encode()).hexdigest(),
        )


def test_texts_come_back(odd_docs, no_docs):
    encoded = byte_bpe.encode_texts(odd_docs, PATH, public_tokenizers.PATTERN)
    texts = sorted(r.text for r in byte_bpe.decode_ids(encoded, PATH, public_tokenizers.PATTERN).collect())
    assert texts == sorted(r.text or "" for r in odd_docs.select("text").collect())
    assert byte_bpe.round_trip(odd_docs, PATH, public_tokenizers.PATTERN).count() == odd_docs.count()
    assert byte_bpe.round_trip(no_docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_caches_are_bounded(both, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 10)
    monkeypatch.setattr(byte_bpe, "CACHED_PAIRS", 10)
    text = " ".join(f"w{i}x" for i in range(200))
    assert both[0].encode(text) == both[1].encode_ordinary(text)
    both[0].encode("again")
    assert len(both[0].pieces) <= 11


def test_bytes_that_are_no_text(spark):
    broken = spark.sql("SELECT 1 AS doc_id, cast(unhex('61FF20E28262') AS string) AS text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    row, = byte_bpe.round_trip(broken, path, public_tokenizers.PATTERN).collect()
    assert row.decoded_sha256 == hashlib.sha256("a� �b".encode()).hexdigest()
