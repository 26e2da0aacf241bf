import random

import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import ngram_join

from .test_words import folded, plain_words


def shingles(text):
    words = tuple(plain_words(folded(text or "")))
    return {words[i:i + 5] for i in range(len(words) - 4)} if len(words) >= 5 else {words} - {()}


def brute(rows):
    """component_id and set size by comparing all pairs."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows)}


def found(docs, **limits):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(docs, **limits).collect()}


def near_copies(rng, base, n, changes):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("limits", [{"most": 2, "at_once": 700, "block": 8}, {"most": 4}, {}])
def test_components_are_those_of_all_pairs(make_docs, limits):
    """Groups near the threshold, shared passages, copies and short texts; with few mates every round has work."""
    rng = random.Random(len(limits))
    texts = []
    for size, n, changes in ((120, 40, 6), (60, 25, 3), (30, 20, 1), (300, 12, 12), (9, 12, 1)):
        texts += near_copies(rng, [f"b{size}w{i}" for i in range(size)], n, changes)
    passage = [f"p{i}" for i in range(70)]
    texts += [" ".join(passage + [f"own{k}x{i}" for i in range(rng.randint(5, 120))]) for k in range(40)]
    texts += [" ".join(f"g{i}" for i in range(20))] * 30
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, start=100))
    assert found(make_docs(rows), **limits) == brute(rows)


def test_given_documents(corpus_docs):
    rows = [(r.doc_id, r.text) for r in corpus_docs.select("doc_id", "text").collect()]
    assert found(corpus_docs) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    result = ngram_join.linked_components(odd_docs).collect()
    assert len(result) == odd_docs.count()
    by_id = {r.doc_id: r for r in result}
    assert by_id[0].n_shingles == by_id[1].n_shingles == by_id[2].n_shingles == 0
    assert by_id[1].component_id == 1 and by_id[9].component_id == 8
    assert any(r.doc_id is None and r.n_shingles == 1 and r.component_id is None for r in result)
    assert ngram_join.linked_components(no_docs).count() == 0


def test_one_of_each_group_stays(odd_docs, make_docs, no_docs):
    kept = ngram_join.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count("same text of six words here") == 1
    assert "another text under a used id" in texts and "without an id" in texts
    assert sum(1 for t in texts if not (t or "").strip(" \t\r\n\x0b\x0c")) >= 4
    assert ngram_join.representatives(no_docs).count() == 0
    two_texts = make_docs([(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j j"), (2, "a b c d e f g h i j")])
    assert ngram_join.representatives(two_texts).count() == 1


def test_blocks_of_a_large_subset(make_docs):
    rng = random.Random(9)
    rows = list(enumerate(near_copies(rng, [f"w{i}" for i in range(80)], 50, 5)))
    assert found(make_docs(rows), most=2, block=4) == brute(rows)


def test_a_subset_that_all_sets_share_leaves_each_task_short(make_docs):
    """A passage in every document: its subsets reach their task as a few rows from each task, and all members are marked."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"own{k}x{i}" for i in range(55)]) for k in range(400)]
    rows = list(enumerate(texts + texts[:50]))
    docs = make_docs(rows).repartition(4)
    from functools import partial
    sent = docs.select("text").mapInArrow(
        partial(ngram_join._subset_rows, mates=5, at_once=1 << 19), "key bigint, member bigint, costly bigint",
    )
    most = sent.where("costly IS NULL").groupBy("key").count().agg(F.max("count")).first()[0]
    marked = sent.where("costly IS NOT NULL")
    assert most <= 6 * 4 and marked.count() > 1000
    assert marked.where("key <> member").count() == 0
    near = [(1000 + k, texts[k] + " " + rng.choice("xyz")) for k in range(0, 400, 9)]
    assert found(make_docs(rows + near), most=5) == brute(rows + near)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_short_texts_meet_in_empty_subsets_too(make_docs, most):
    """Sets of few shingles have fewer subsets than they may differ in, and link with sets that have more."""
    rng = random.Random(most)
    texts = []
    for size in (8, 10, 12, 15, 19):
        texts += near_copies(rng, [f"s{i}" for i in range(size)], 25, 1)
        texts += [" ".join([*(f"s{i}" for i in range(size)), *(f"end{k}x{i}" for i in range(k % 4))]) for k in range(15)]
    rows = list(enumerate(texts))
    assert found(make_docs(rows), most=most) == brute(rows)


@pytest.mark.parametrize("null_ids", [False, True])
def test_repeated_rows_do_not_crowd_out_subsets(make_docs, monkeypatch, null_ids):
    """Every set is whole once, and gets as many different subsets, however often its rows occur."""
    rng = random.Random(5)
    texts = list(near_copies(rng, [f"w{i}" for i in range(120)], 40, 3))
    rows = [(None if null_ids else i, text) for i, text in enumerate(texts)]
    seen = []
    original = ngram_join.rare_subsets

    def spied(left, costly, whole):
        rare = original(left, costly, whole)
        for df, keys in ((whole, ["set_id"]), (rare, ["key", "member"])):
            seen.append((df.count(), df.select(*keys).distinct().count()))
        return rare

    monkeypatch.setattr(ngram_join, "rare_subsets", spied)

    def groups(rows):
        found = ngram_join.linked_components(make_docs(rows), most=2).select("text_key", "component_key").distinct().collect()
        return {r.text_key: r.component_key for r in found}

    assert groups(rows * 3) == groups(rows)
    assert len(seen) == 4 and all(n == distinct for n, distinct in seen)


def test_components_of_a_chain(spark):
    rng = random.Random(1)
    names = [rng.randrange(-2**62, 2**62) * 2 for _ in range(60)]
    links = spark.createDataFrame([(min(p), max(p)) for p in zip(names, names[1:])], "a bigint, b bigint")
    roots = ngram_join.components(links).select(F.countDistinct("root"), F.count("set_id")).first()
    assert tuple(roots) == (1, 60)
