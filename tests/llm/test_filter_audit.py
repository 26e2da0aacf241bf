import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import filter_audit

WORD = re.compile("[^\x20\x09-\x0d]+")
LABELS = "doc_id bigint, quality int, toxic int"


def fails(text):
    text = text or ""
    words = WORD.findall(text)
    tests = {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": re.search("[#$%&*|]", text) is not None,
    }
    return {letter for letter, failed in tests.items() if failed}


def brute(rows, labels):
    """All orders, filter by filter, over the documents themselves."""
    first, known = {}, {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, quality, toxic in labels:
        good, bad = known.get(doc_id, (False, False))
        known[doc_id] = (good or quality == 1, bad or toxic == 1)
    docs = []
    for doc_id, text, source in rows:
        own = fails(text) | ({"E"} if doc_id is not None and doc_id > first[text or ""] else set())
        docs.append((source or "", own, *(known.get(doc_id, (False, False)) if doc_id is not None else (False, False))))
    result = {}
    for part in {d[0] for d in docs}:
        totals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, letter in enumerate(order, start=1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                every = [d for d in docs if d[0] == part and letter in d[1]]
                totals[letter] += len(gone)
                result[part, order, step] = [
                    len(left), len(gone), len(every) - len(gone), sum(d[1] == {letter} for d in every),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
        for (p, order, step), figures in result.items():
            if p == part:
                figures.append(totals[order[step - 1]])
    return result


def found(docs, labels):
    rows = filter_audit.audit(filter_audit.cells(docs, labels)).collect()
    result = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in rows}
    assert len(result) == len(rows)
    return result


def some_documents(rng):
    texts = []
    for _ in range(150):
        words = [rng.choice(("word", "Other", "THIRD", "x")) + str(rng.randrange(rng.choice((3, 200)))) for _ in range(rng.choice((5, 49, 50, 80)))]
        texts.append(rng.choice((" ", "\n", "\x0b\t")).join(words) + rng.choice(("", "", "#", "|")))
    texts += texts[:40]
    return [(i, text, rng.choice(["a", "b", None])) for i, text in enumerate(texts)]


def test_figures_are_those_of_filtering(spark, make_docs):
    rng = random.Random(2)
    rows = some_documents(rng)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 190, 2)] + [(2, 1, 1), (None, 1, 1), (9999, 1, 1)]
    assert found(make_docs(rows), spark.createDataFrame(labels, LABELS)) == brute(rows, labels)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = [(1, 1, 1), (8, 1, None), (None, 1, 1)]
    known = spark.createDataFrame(labels, LABELS).withColumn("good", F.lit("clash")).withColumn("labelled", F.lit("clash"))
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.select("doc_id", "text", "source").collect()]
    assert found(odd_docs, known) == brute(rows, labels)
    assert found(no_docs, known) == {}
    assert len(found(odd_docs, known.limit(0))) == 600 * 3


@pytest.mark.parametrize("filters", [1, 3, 5])
def test_the_walk_gives_the_survivors_of_every_subset(filters):
    size = 1 << filters
    counts = np.random.default_rng(filters).integers(0, 50, (4, size, 3))
    states = filter_audit.survivors(counts)
    for subset in range(size):
        alive = [m for m in range(size) if not m & subset]
        assert (states[:, subset] == counts[:, alive].sum(axis=1)).all()


def test_a_text_that_most_documents_have(make_docs, spark):
    rows = [(i, "the same text", "s") for i in range(300)] + [(None, "the same text", "s"), (300, "another", "s")]
    assert found(make_docs(rows), spark.createDataFrame([], LABELS)) == brute(rows, [])
