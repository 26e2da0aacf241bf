import hashlib
import random
import re

import numpy as np
import pytest

from bazaarlens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, span):
    digits = [int(c) for c in span if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return sorted(
        (m.start(), order, m.end()) for order, (kind, p) in enumerate(PATTERNS.items())
        for m in re.finditer(p, text or "") if valid(kind, m[0])
    )


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@pytest.mark.parametrize("alphabet", ["ab.@-+%_1 2", "0123456789. -", "+12 ().-3", "a@.b\n"])
def test_base_spans_are_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
        assert sorted((s, k, e) for k, s, e in pii.base_spans(text)) == brute(text), text


def test_long_words_cost_little():
    for text in ("a" * 500_000, "1" * 300_000, "a@" * 50_000, "1." * 50_000 + "x", "+1" + " " * 100_000, "x@y" + ".z" * 50_000):
        list(pii.candidates(text))
    assert list(pii.base_spans("b" * 1000 + "@c.de")) == [(0, 0, 1005)]


def test_query_on_given_documents(corpus_docs):
    got = {r.doc_id: r for r in pii.report(corpus_docs).collect()}
    for r in corpus_docs.select("doc_id", "text").collect():
        base = brute(r.text)
        row = got[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(listed(base).split(",")) <= set(row.spans.split(","))


def test_odd_rows(odd_docs, no_docs, make_docs):
    result = pii.report(odd_docs).collect()
    assert len(result) == odd_docs.count()
    assert all(r.spans == "" for r in result)
    assert pii.report(no_docs).count() == 0
    same = pii.report(make_docs([(1, "mail a@b.cd")] * 2)).collect()
    assert [r.spans for r in same] == ["email:5:11"] * 2


def test_proposals_are_added_and_base_spans_stay(make_docs):
    rows = [(i, f"call +1 (212) 555-01{i:02d} or mail p{i}@mail.com now") for i in range(40)]
    rows += [(100, "please call (212) 555-0199 now"), (101, "mail bob (at) mail (dot) com"), (102, "order 1234 5678 9012 3456 shipped")]
    got = {r.doc_id: r for r in pii.report(make_docs(rows)).collect()}
    assert got[100].spans == "phone:12:26" and got[100].n_phone == 0
    assert got[101].spans.startswith("email:5:")
    assert got[102].spans == ""
    assert got[0].spans.count(":") == 4


@pytest.fixture(scope="module")
def planted(make_docs):
    """Base spans in plenty, spans that only the wide patterns see, and numbers that look like these."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(n))
    name = lambda: rng.choice(("bob", "Eva.Lang", "j_doe", "x" * 90))
    wanted, decoys, rows = {}, {}, []

    def add(i, text, span, kind, into):
        if brute(text):  # random digits may be a card number
            return
        into[i] = f"{kind}:{text.index(span)}:{text.index(span) + len(span)}"
        rows.append((i, text))

    for i in range(120):
        rows.append((i, f"mail {name()}{i}@mail.com, call +44 20 {digits(4)} {digits(4)}, server 10.{i}.3.4, card 4539 1488 0343 6467"))
    for i in range(1000, 1040):
        at, dot = rng.choice(((" (at) ", " (dot) "), ("[AT]", "[DOT]"), (" at ", " dot "), (" At ", " DoT "), ("{at}", ".")))
        span = f"{name()}{at}{rng.choice(('mail', 'post-box', 'a' * 70))}{dot}{rng.choice(('sub' + dot, ''))}{rng.choice(('com', 'ORG'))}"
        add(i, f"Reach me: {span} today", span, "email", wanted)
    for i in range(2000, 2040):
        span = rng.choice((f"2001:db8::{hexes(2)}", f"fe80::{hexes(4)}", f"2a02:{hexes(7)}", f"fd00:{hexes(2)}::1", f"2001:{hexes(1)}::"))
        add(i, f"the server address {span} is up", span, "ip", wanted)
    for i in range(3000, 3060):
        span = (f"06 {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"020 7{digits(3)} {digits(4)}", f"030 {digits(7)}",
                f"(212) 5{digits(2)}-{digits(4)}", f"612 {digits(3)} {digits(3)}", f"0049 30 {digits(8)}")[i % 6]
        add(i, f"phone {span} please", span, "phone", wanted)
    for i in range(4000, 4060):
        span, kind = ((f"2024-0{1 + i % 9}-1{i % 10}", "phone"), (f"{10 + i % 80} 000 000", "phone"), (f"1{i % 10}:3{i % 6}:{10 + i % 49}", "ip"),
                      (f"{digits(4)} {digits(4)} {digits(4)} 0000", "phone"), (f"12.05.2024 {1000 + i}", "phone"), (f"{10 + i % 9}.{digits(8)}", "phone"))[i % 6]
        add(i, f"invoice number of {span} was paid", span, kind, decoys)
    return make_docs(rows), wanted, decoys


def test_written_out_compressed_and_national_spans_are_found(planted):
    docs, wanted, decoys = planted
    found = {r.doc_id: r.spans.split(",") for r in pii.report(docs).collect()}
    assert [i for i, span in wanted.items() if span not in found[i]] == []
    assert [i for i in decoys if any(x.startswith(("phone", "ip", "email")) for x in found[i])] == []


def test_every_labeler_votes(planted):
    docs, _, _ = planted
    votes = [set() for _ in pii.LABELERS]
    for row in docs.select("text").collect():
        for *_, code in pii.candidates(row.text):
            for i, vote in enumerate(pii.decoded(code)[2]):
                votes[i].add(vote)
    assert all(seen & {pii.YES, pii.NO} for seen in votes) and all(len(seen) > 1 for seen in votes)


def test_proposals_cost_little_in_long_texts():
    for text in ("at " * 200_000, " (at) " * 100_000, "a (at) b" + " dot c" * 50_000, ":" * 300_000, "1:" * 200_000, "12 " * 200_000,
                 "x" * 300_000 + " (at) " + "y" * 300_000 + ".com", "00" * 100_000, "(1234) " * 100_000, " at a" * 100_000):
        list(pii.candidates(text))
    span, = pii.written_emails("x" * 300_000 + " (AT) " + "y" * 300_000 + ".com")
    assert span == (0, 600_010)


def test_bytes_that_are_no_text(spark):
    broken = spark.sql("SELECT 1 AS doc_id, cast(unhex('FF20') AS string) || 'a@b.cd' AS text")
    assert [r.spans for r in pii.report(broken).collect()] == ["email:2:8"]


def test_codes_round_trip():
    for kind in range(4):
        for cast in ((1, 0, 2, 1, 0, 2), (2,) * 6, (0,) * 6):
            assert pii.decoded(pii.encoded(kind, kind % 2 == 0, cast)) == (kind, kind % 2 == 0, cast)


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    cast = np.column_stack([
        np.where(rng.random(4000) < share, truth, ~truth).astype(int) for share in (0.95, 0.9, 0.85, 0.55, 0.8, 0.7)
    ])
    belief = pii.reliabilities(cast, np.ones(4000))
    assert ((belief > 0.5) == truth).mean() > 0.95
