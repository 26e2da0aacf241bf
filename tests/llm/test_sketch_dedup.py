import random
from itertools import pairwise

import numpy as np
import pytest

from bazaarlens.llm import sketch_dedup

from .test_ngram_join import near_copies
from .test_words import folded, plain_words


def shingles(text):
    words = tuple(plain_words(folded(text or "")))
    return {words[i:i + 3] for i in range(len(words) - 2)} if len(words) >= 3 else {words} - {()}


def brute(rows):
    """Set size, component and whether it is kept, by comparing all pairs."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[find(i)], least[find(i)] == doc_id) for i, (doc_id, _) in enumerate(rows)}


def found(docs, **limits):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in sketch_dedup.linked_components(docs, **limits).collect()}


def crowded_texts(rng):
    """Groups near the threshold, shared passages, copies and short texts."""
    texts = []
    for size, n, changes in ((400, 40, 14), (120, 40, 4), (60, 25, 2), (30, 20, 1), (1000, 12, 30), (9, 12, 1)):
        texts += near_copies(rng, [f"b{size}w{i}" for i in range(size)], n, changes)
    passage = [f"p{i}" for i in range(150)]
    texts += [" ".join(passage + [f"own{k}x{i}" for i in range(rng.randint(3, 90))]) for k in range(60)]
    texts += [" ".join(passage[:rng.randint(120, 150)]) for _ in range(25)]
    texts += [" ".join(f"g{i}" for i in range(20))] * 30
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("limits", [{}, {"mates": 2, "at_once": 500, "block": 8}, {"mates": 5, "at_once": 1 << 20}])
def test_components_are_those_of_all_pairs(make_docs, limits):
    rows = list(enumerate(crowded_texts(random.Random(len(limits))), start=100))
    assert found(make_docs(rows).repartition(3), **limits) == brute(rows)


def test_given_documents(corpus_docs):
    rows = [(r.doc_id, r.text) for r in corpus_docs.select("doc_id", "text").collect()]
    assert found(corpus_docs) == brute(rows)


def test_values_that_all_sets_have(make_docs):
    """A passage in all texts: its lists are cut in every task, and what is found does not change."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(90)]
    rows = [(k, " ".join(passage + [f"own{k}x{i}" for i in range(rng.randint(10, 60))])) for k in range(150)]
    rows += [(1000 + k, f"{rows[k][1]} one") for k in range(0, 150, 5)]
    assert found(make_docs(rows), mates=3, at_once=1000) == brute(rows)


def test_long_lists_leave_a_task_short(spark):
    """Of a value in every set, each cut of a task sends a few rows; every set counts it as shared or lost once."""
    sets = spark.createDataFrame([(n, 3, [7, 1000 + n, 10**6 + n % 2]) for n in range(400)], "set_id bigint, size bigint, sketch array<bigint>").repartition(2)
    shared, lost = sketch_dedup.shared_values(sets, mates=5, at_once=100)
    assert shared.count() == 0
    assert {r.member: r.lost for r in lost.collect()} == {n: 2 for n in range(400)}


def open_list(members, apart=6):
    """Rows of one list whose members differ from a common set in ``apart`` values each, all linked and none connected."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 2**63, 300, dtype=np.uint64)
    rows = []
    for n in range(members):
        values = np.unique(np.concatenate((common, rng.integers(0, 2**63, apart, dtype=np.uint64))))
        rows.append((7, 1, members, 10 + n, 0, len(values), 10 + n, *[sketch_dedup.parity_bits(values, k) for k in (sketch_dedup.K, sketch_dedup.FINE)]))
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_a_forest_connects_near_copies_by_fewer_pairs_than_rows(spark, block):
    """A group of near copies that no link connects yet: a block names a forest of it and not the square."""
    rows = open_list(60)
    kind = "value bigint, band int, mates bigint, member bigint, role int, size bigint, root bigint, bits binary, fine binary"
    table = spark.createDataFrame(rows, kind)
    opened, bits = table.drop("bits", "fine"), table.select("member", "bits", "fine")
    chosen = [(r.a, r.b) for r in sketch_dedup.unconnected_pairs(opened, bits, block, forest=True).collect()]
    every = {(r.a, r.b) for r in sketch_dedup.unconnected_pairs(opened, bits, block).collect()}
    blocks = -(-60 // block)
    assert len(every) == 60 * 59 // 2 and set(chosen) <= every
    assert 59 <= len(chosen) < 60 * blocks
    root = {n: n for n in range(10, 70)}
    for a, b in chosen:
        root = {n: root[a] if of == root[b] else of for n, of in root.items()}
    assert len(set(root.values())) == 1


def near_misses(members, size=700, own=60):
    """Whole sets of which no two are linked, though each two share more than four fifths of what a link needs."""
    rng = np.random.default_rng(6)
    common = rng.integers(0, 2**63, size - own, dtype=np.uint64)
    return [np.unique(np.concatenate((common, rng.integers(0, 2**63, own, dtype=np.uint64)))) for _ in range(members)]


def test_pairs_that_are_not_links_leave_no_rows(spark):
    """Large sets just below the threshold: sketches allow a link of each two, whole sets of none but a copy's."""
    sets = near_misses(50)
    sets.append(np.delete(sets[20], slice(0, 9)))
    sizes = [len(x) for x in sets]
    whole = spark.createDataFrame([(10 + n, x.view(np.int64).tolist()) for n, x in enumerate(sets)], "set_id bigint, shingles array<bigint>")
    opened = spark.createDataFrame(
        [(7, 39, len(sets), 10 + n, 0, size, 10 + n) for n, size in enumerate(sizes)],
        "value bigint, band int, mates bigint, member bigint, role int, size bigint, root bigint",
    )
    for block in (4096, 16):
        for forest in (True, False):
            rows = sketch_dedup.unconnected_pairs(opened, sketch_dedup.sketch_bits(whole), block, forest).collect()
            assert [(r.a, r.b) for r in rows] == [(30, 60)]


def test_lists_of_one_group_are_compared_as_one(spark):
    """Near copies share a list per value; with one center their members are dealt once, other lists stay as they are."""
    rows = [(value, 3, 20, member, 0, 99, 1) for value in range(100, 130) for member in range(1, 21)]
    rows += [(value, 3, 2, member, 0, 99, 1000) for value in range(200, 210) for member in (1000, value)]
    lists = spark.createDataFrame(rows, "value bigint, band int, mates bigint, member bigint, role int, size bigint, center bigint")
    no_links = spark.createDataFrame([], "set_id bigint, root bigint")
    opened = [(r.value, r.mates, r.member, r.root) for r in sketch_dedup.open_lists(lists, no_links).collect()]
    assert sorted(opened) == sorted([(1, 20, m, m) for m in range(1, 21)] + [(v, 2, m, m) for v in range(200, 210) for m in (1000, v)])


def test_pairs_apart_after_the_forest_are_still_compared(make_docs):
    """Chains in which a member is linked with its neighbours only, and pairs whose bitmaps allow a link that is none."""
    rng = random.Random(9)
    rows, at = [], 0
    for size, step in ((120, 4), (120, 9), (300, 20), (700, 50), (700, 56)):
        words = [f"c{size}x{step}w{i}" for i in range(size + 40 * step)]
        rows += [(at + n, " ".join(words[n * step:n * step + size])) for n in range(40)]
        at += 100
    rng.shuffle(rows)
    for limits in ({"mates": 2, "at_once": 500}, {"mates": 2, "at_once": 500, "block": 8}):
        assert found(make_docs(rows).repartition(3), **limits) == brute(rows)


def test_sketches_of_unions():
    rng = np.random.default_rng(1)
    for size in (1, 10, 63, 64, 65, 500):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate((a[:size // 2], rng.integers(0, 2**63, size, dtype=np.uint64))))
        union = np.unique(np.concatenate((a, b)))[:sketch_dedup.K]
        padded = [np.pad(x[:sketch_dedup.K], (0, max(0, sketch_dedup.K - len(x))), constant_values=2**64 - 1)[None] for x in (a, b)]
        whole, shared = sketch_dedup.union_shared(*padded)
        assert whole[0] == len(union)
        assert shared[0] == len(set(union.tolist()) & set(a.tolist()) & set(b.tolist()))


def test_the_least_number_of_shared_values():
    """A linked pair shares fewer in one of a thousand million cases; a set of few shingles shares its exact part."""
    assert [sketch_dedup.least_shared(k) for k in (1, 8, 64)] == [0, 0, 34]
    assert sketch_dedup.must_share(np.array([1, 2, 20, 39, 64, 5000])).tolist() == [1, 2, 17, 34, 34, 34]
    assert all(a <= b for a, b in pairwise(sketch_dedup.must_share(np.arange(1, 200)).tolist()))


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for size in (20, 64, 200, 512, 3000):
        for _ in range(40):
            common = rng.integers(0, 2**63, size, dtype=np.uint64)
            own = [rng.integers(0, 2**63, int(size * rng.uniform(0, 0.1)), dtype=np.uint64) for _ in range(2)]
            a, b = (np.unique(np.concatenate((common, x))) for x in own)
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 85 * (len(a) + len(b) - shared):
                continue
            for k, least in ((sketch_dedup.K, sketch_dedup.LEAST_SHARED), (sketch_dedup.FINE, sketch_dedup.LEAST_SHARED_FINE)):
                one, other = (np.frombuffer(sketch_dedup.parity_bits(x, k), np.uint64) for x in (a, b))
                apart = np.bitwise_count(one ^ other).sum()
                assert apart <= sketch_dedup.most_apart(np.array([len(a)]), len(b), k, least)[0]


def test_odd_rows(odd_docs, no_docs, make_docs):
    result = sketch_dedup.linked_components(odd_docs).collect()
    assert len(result) == odd_docs.count()
    assert sum(r.doc_id == 8 for r in result) == 3 and all(r.kept and r.component_id == 8 for r in result if r.doc_id == 8)
    by_id = {r.doc_id: r for r in result if r.doc_id != 4}
    assert all(by_id[i].n_shingles == 0 and by_id[i].component_id == i and by_id[i].kept for i in (0, 1, 2))
    assert by_id[9].component_id == 8 and not by_id[9].kept
    assert any(r.doc_id is None and r.n_shingles == 0 and r.kept for r in result)
    assert sketch_dedup.linked_components(no_docs).count() == 0
    repeated = make_docs([(None, "a b c d"), (None, "a b c d"), (7, "A B c d")])
    assert {(r.doc_id, r.component_id, r.kept) for r in sketch_dedup.linked_components(repeated).collect()} == {
        (None, 7, False), (7, 7, True)}
