import random

import pytest

from bazaarlens.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_sites):
    sites, first = {}, {}
    for doc_id, text, site in sorted(rows, key=lambda r: r[0]):
        for place, line in enumerate((text or "").split("\n")):
            if line.strip(BLANK):
                sites.setdefault(line, set()).add(site)
                first.setdefault(line, (doc_id, place))
    out = {}
    for doc_id, text, _ in rows:
        kept = [
            line for place, line in enumerate((text or "").split("\n"))
            if not line.strip(BLANK) or len(sites[line]) < min_sites or first[line] == (doc_id, place)
        ]
        out[doc_id] = None if text is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("min_sites", [2, 5, 12])
def test_lines_on_many_sites_go_but_for_the_first(make_docs, min_sites):
    rng = random.Random(min_sites)
    lines = [f"line {i}" for i in range(30)] + ["", "  ", "é"]
    rows = [
        (i, "\n".join(rng.choice(lines[:rng.randint(3, 33)]) for _ in range(rng.randint(0, 8))), f"s{rng.randint(0, 14)}")
        for i in range(150)
    ] + [(900, None, "s1"), (901, "", None), (902, "line 1\nline 2", None)]
    got = {r.doc_id: r.text for r in line_dedup.remove_boilerplate(make_docs(rows), min_sites=min_sites).collect()}
    assert got == brute(rows, min_sites)


def test_spread_is_exact_near_the_threshold(make_docs):
    docs = make_docs([(i, "shared", f"s{i % 5}") for i in range(50)] + [(99, "four", f"s{i}") for i in range(4)])
    lines = line_dedup.lines_of(docs)
    assert [(r.sites, r["first"].doc_id) for r in line_dedup.spread(lines, 5).collect()] == [(5, 0)]


def test_odd_rows(odd_docs, no_docs):
    cleaned = line_dedup.remove_boilerplate(odd_docs, min_sites=2)
    assert cleaned.columns == odd_docs.columns and cleaned.count() == odd_docs.count()
    texts = {r.doc_id: r.text for r in cleaned.where("doc_id IN (0, 1, 2, 10)").collect()}
    assert texts[0] is None and texts[1] == "" and texts[2] == " \t\r\n" and texts[10] == "line\nline\nline"
    assert line_dedup.remove_boilerplate(no_docs).count() == 0
    assert line_dedup.removed_lines(odd_docs).count() == odd_docs.count()
