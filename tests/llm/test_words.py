import random
import re

import numpy as np

from bazaarlens.llm.words import shingle_set, window_hashes, word_hashes


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_equal_hashes_are_equal_words():
    rng = random.Random(5)
    words = ["a", "A", "ab", "ba", "É", "é", "中", "aa", "aaa", "b" * 40]
    for _ in range(200):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(rng.randint(0, 30)))
        found = word_hashes(text.encode())
        expected = plain_words(text)
        assert len(found) == len(expected)
        by_hash = dict(zip(found.tolist(), expected, strict=True))
        assert [by_hash[h] for h in found.tolist()] == expected
        assert len(set(found.tolist())) == len(set(expected))
        assert len(set(word_hashes(text.encode(), fold_case=True).tolist())) == len({folded(w) for w in expected})


def test_long_texts_are_hashed_in_parts_alike():
    text = " ".join(f"w{i % 1000}" for i in range(500_000)).encode()
    assert len(text) > 1 << 21
    found = word_hashes(text)
    assert len(found) == 500_000
    assert np.array_equal(found[:1000], found[499_000:])
    assert len(word_hashes(b"x" * (3 << 20) + b" y")) == 2


def test_shingles_are_the_distinct_windows():
    rng = random.Random(6)
    for _ in range(100):
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        words = plain_words(text)
        windows = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
        assert len(shingle_set(text.encode())) == len(windows)
    assert len(window_hashes(word_hashes(b"a b c d"))) == 0
    assert shingle_set(b"a b").tolist() != shingle_set(b"a b a").tolist()
    assert shingle_set(b"A b c d e").tolist() == shingle_set(b"a B c d  e\n").tolist()
