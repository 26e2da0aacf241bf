import hashlib
import math
import random

import numpy as np
import pytest

from bazaarlens.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=16, most=64, rounds=2):
    """vec_id, code, error, label_error by comparing every part with every entry; and the digest of the codebooks."""
    kept = [
        (i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    edges = [i * width // parts for i in range(parts + 1)]
    books = [[v[a:b] for _, v, _ in kept[:most]] for a, b in zip(edges, edges[1:])]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, entry)), n) for n, entry in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                part = v[edges[p]:edges[p + 1]]
                groups.setdefault(nearest(part, book)[1], []).append(part)
            books[p] = [
                [sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else entry for n, entry in enumerate(book)
            ]
    found, by_label = [], {}
    for i, v, label in kept:
        best = [nearest(v[a:b], book) for a, b, book in zip(edges, edges[1:], books)]
        error = sum(d for d, _ in best)
        by_label[label] = by_label.get(label, 0) + error
        found.append((i, "".join(f"{n:02x}" for _, n in best), error, label))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in found), key=str)


def found(spark, rows):
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    df = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def vectors(rng, n, width, spread=1.0):
    return [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(width)], rng.choice([0, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("n,width,spread", [(300, 64, 0.2), (150, 32, 0.01), (40, 16, 3.0), (120, 37, 0.1), (100, 5, 0.5)])
def test_codes_are_those_of_all_comparisons(spark, n, width, spread):
    rows = vectors(random.Random(n), n, width, spread)
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rng = random.Random(4)
    rows = vectors(rng, 90, 16, 0.2)
    rows += [(500, None, 1), (501, [None] + [0.1] * 15, 1), (502, [float("nan")] + [0.0] * 15, 1), (503, [float("inf")] * 16, 2)]
    rows += [(504, [], 1), (505, [0.5] * 8, 1), (506, [0.5] * 16, None), (None, [0.25] * 16, None)]
    rows += [rows[3], rows[3], (3, [-0.7] * 16, 0)]
    assert found(spark, rows) == brute(rows)


def test_only_faulty_or_no_vectors(spark):
    assert found(spark, [(1, None, 1), (2, [float("nan")], 1), (3, [], None)]) == []
    assert found(spark, []) == []
    assert found(spark, [(1, [0.5] * 16, 3)]) == brute([(1, [0.5] * 16, 3)])


def test_large_components_saturate(spark):
    rows = [(1, [1e30] * 16, 0), (2, [-1e30] * 16, 0), (3, [0.0] * 16, 0)]
    assert [r[2] for r in found(spark, rows)] == [0, 0, 0]


def test_first_vectors_of_another_width(spark):
    rows = [(0, [0.5] * 4, 0), (1, [0.1] * 32, 0), (2, [0.2] * 4, 0), (3, [0.3] * 4, None)]
    assert found(spark, rows) == brute(rows)


def test_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F
    rows = vectors(random.Random(1), 30, 16)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("components", "code", "error", "of", "entry", "dim", "total", "number"):
        df = df.withColumn(name, F.lit("clash"))
    assert vector_codes.compressed(df).count() == 30


@pytest.mark.parametrize("few", [1, 3, 512])
def test_the_walk_finds_the_nearest_entries(few, monkeypatch):
    """Long common prefixes, at every number of parts that are left to a walk by levels."""
    monkeypatch.setattr(vector_codes, "FEW", few)
    rng = np.random.default_rng(few)
    parts, place, weights = vector_codes.distinct_parts(rng.integers(-3, 4, (900, 5)))
    assert (np.diff([tuple(p) < tuple(q) for p, q in zip(parts, parts[1:])]) == 0).all() and weights.sum() == 900
    entries = rng.integers(-4, 5, (20, 5))
    nearest, apart = vector_codes.nearest_entries(parts, entries)
    distances = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (nearest == distances.argmin(axis=1)).all() and (apart == distances.min(axis=1)).all()
