import hashlib
import random

import numpy as np
import pytest

from bazaarlens.llm import fingerprints as fp
from bazaarlens.llm.words import shingle_set


def expected(rows):
    """Edits and neighbours by a plain sort; nulls first."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 4
        change = text[:len(text) - n] + after[:n]
        own, mark, other = (fp.fingerprint(t.encode()) for t in (text, change, after))
        out[doc_id] = (len(text), hashlib.sha256(change.encode()).hexdigest(), own, mark, fp.likeness(own, mark), fp.likeness(own, other))
    return out


def compared(docs, ranges=None):
    return {r.doc_id: tuple(r)[1:] for r in fp.compare_with_next(docs, ranges).collect()}


@pytest.mark.parametrize("ranges", [1, 2, 7, 50])
def test_next_documents_by_range(make_docs, ranges):
    rng = random.Random(ranges)
    rows = [(rng.randrange(-10**12, 10**12), " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    rows.append((None, "text without an id"))
    assert compared(make_docs(rows).repartition(3), ranges) == expected(rows)


def test_given_documents(corpus_docs):
    rows = [(r.doc_id, r.text) for r in corpus_docs.collect()]
    assert compared(corpus_docs) == expected(rows)


def test_likeness_estimates_jaccard():
    rng = random.Random(3)
    errors = []
    for share in (0.0, 0.2, 0.5, 0.8, 0.95):
        for size in (40, 400):
            words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            other = words[:int(size * share)] + [f"v{rng.randrange(10**6)}" for _ in range(size - int(size * share))]
            a, b = " ".join(words).encode(), " ".join(other).encode()
            one, two = set(shingle_set(a).tolist()), set(shingle_set(b).tolist())
            errors.append(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - len(one & two) / len(one | two))
    assert max(map(abs, errors)) < 0.15 and abs(np.mean(errors)) < 0.05


def test_every_bin_is_filled_from_a_filled_one():
    for n in (1, 2, 10, 255, 5000):
        shingles = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        minima = fp.bin_minima(shingles)
        assert len(minima) == fp.BINS and set(minima.tolist()) <= set(shingles.tolist())


def test_odd_rows(odd_docs, no_docs, make_docs):
    rows = fp.compare_with_next(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id == 8}) == 1
    assert fp.compare_with_next(no_docs).count() == 0
    alone = compared(make_docs([(1, "a b c d e f g h")]))
    assert alone[1][5] == 1.0
    assert fp.likeness("", "") == 1.0 and fp.likeness("", fp.fingerprint(b"a")) == 0.0
    assert fp.fingerprints(odd_docs).count() == odd_docs.count()


def splitmix(value):
    value &= (1 << 64) - 1
    value = ((value ^ (value >> 30)) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    value = ((value ^ (value >> 27)) * 0x94D049BB133111EB) & (1 << 64) - 1
    return value ^ (value >> 31)


def plain_fingerprint(shingles):
    """Bin by bin: the smallest hash of the bin, or of the first filled one that the bin's draws name."""
    filled = {}
    for value in shingles:
        filled[value >> 56] = min(value, filled.get(value >> 56, value))
    digits = []
    for place in range(256):
        donor, attempt = place, 0
        while donor not in filled:
            donor = splitmix((place << 32) + attempt + 1) % 256
            attempt += 1
        digits.append(f"{splitmix(filled[donor] ^ splitmix(place + 1 << 40)) & 15:x}")
    return "".join(digits)


def test_fingerprints_bin_by_bin():
    rng = random.Random(6)
    for n in (1, 3, 5, 8, 60, 900, 5000):
        raw = " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)).encode()
        assert fp.fingerprint(raw) == plain_fingerprint(shingle_set(raw).tolist())


def test_different_short_texts_are_not_alike():
    """A text of up to five words has one shingle, which fills all bins."""
    rng = random.Random(7)
    for n in range(1, 11):
        prints = [fp.fingerprint(" ".join(f"w{k}x{rng.randrange(10**9)}" for k in range(n)).encode()) for _ in range(4000)]
        assert len(set(prints)) == 4000
        found = [fp.likeness(a, b) for a, b in zip(prints[::2], prints[1::2])]
        assert max(found) < 0.3 and sum(found) / len(found) < 0.01, n


def test_bytes_that_are_no_text(spark):
    broken = spark.sql("SELECT 1 AS doc_id, cast(unhex('6120FF20E28220622063') AS string) AS text UNION ALL SELECT 2, 'a b c d e'")
    rows = {r.doc_id: r for r in fp.compare_with_next(broken).collect()}
    assert len(rows) == 2 and rows[1].n_chars == 9 and rows[1].near_next < 0.3
