import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import toxicity, word_nodes
from bazaarlens.llm.quality import UNSPACED_SCRIPTS

from .conftest import DATA


def brute_segments(scores):
    """All maximal segments by definition: the best run of a stretch, then the same left and right of it."""
    if not any(s > 0 for s in scores):
        return []
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = round(sum(scores[i:j]), 9)
            if best is None or total > best[0] + 1e-9 or (abs(total - best[0]) < 1e-9 and (j - i) < best[2] - best[1]):
                best = (total, i, j)
    total, i, j = best
    left, right = brute_segments(scores[:i]), brute_segments(scores[j:])
    return left + [(i, j)] + [(a + j, b + j) for a, b in right]


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(2)
    for _ in range(400):
        scores = rng.integers(-40, 30, rng.integers(0, 14)) + rng.random()
        got = [(s, e) for s, e, _ in toxicity.maximal_segments(scores)]
        assert got == brute_segments(scores.tolist()), scores
    for start, end, score in toxicity.maximal_segments(np.array([4.0, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5])):
        assert score > 0 and end > start


def test_segment_scan_is_linear():
    scores = np.tile([2.0, -1.0], 200_000)
    assert len(toxicity.maximal_segments(scores)) == 1
    assert len(toxicity.maximal_segments(np.tile([1.0, -2.0], 200_000))) == 200_000


# --- the method in plain Python, word by word ---

def plain_words(text):
    """Runs of letters; pairs of neighbours in scripts without spaces."""
    def unspaced(c):
        return any(low <= ord(c) <= high for low, high in UNSPACED_SCRIPTS)

    words = []
    for run in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for kind, part in itertools.groupby(run, unspaced):
            part = "".join(part)
            words += [part[i:i + 2] for i in range(max(1, len(part) - 1))] if kind else [part]
    return words


def plain_nodes(word):
    return [word[:n] for n in (4, 5, 6) if len(word) > n] + [word + "."]


def plain_scores(texts):
    """word -> score, from (text, toxic)."""
    counts = {1: Counter(), 0: Counter()}
    for text, toxic in texts:
        counts[toxic].update({n for w in plain_words(text) for n in plain_nodes(w)})
    totals = Counter(toxic for _, toxic in texts)
    balance = totals[1] / totals[0]
    scores = {}

    def odds_and_score(chain):
        odds, score = 0.0, 0.0
        for node in chain:
            if not counts[1][node] and not counts[0][node]:
                break
            share = 1 / (1 + math.exp(-odds))
            yes, no = counts[1][node] + 2 * share, counts[0][node] * balance + 2 * (1 - share)
            odds = math.log(yes / no)
            score = math.copysign(max(0.0, abs(odds) - math.sqrt(1 / yes + 1 / max(no, 0.5))), odds)
        return score

    def score(word):
        if word not in scores:
            scores[word] = odds_and_score(plain_nodes(word)) - 1.0
        return scores[word]

    return score


def plain_result(docs, labels):
    """doc_id -> score, from (doc_id, text) without repeated texts and doc_id -> toxic."""
    known = [(text, labels[i]) for i, text in docs if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    score = plain_scores(known)

    def scan(text):
        scores = [score(w) for w in plain_words(text)]
        runs = [sum(scores[a:b]) for a, b in brute_segments(scores)]
        return scores, runs, max(runs, default=max(scores, default=None))

    clean = [scan(text) for text, toxic in known if not toxic]
    bins = Counter(round(x * 20) / 20 for scores, _, _ in clean for x in scores)
    number = sum(bins.values())
    low, high = 0.0, 1.0
    excess = lambda rate: sum(n / number * math.exp(rate * x) for x, n in bins.items()) - 1
    if not any(x > 0 for x in bins):
        rate = 1.0
    else:
        while excess(high) < 0:
            low, high = high, 2 * high
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (low, middle) if excess(middle) >= 0 else (middle, high)
        rate = high
    log_k = sum(rate * best - math.log(len(scores)) for scores, _, best in clean if scores) / sum(bool(s) for s, _, _ in clean) - np.euler_gamma

    def evidence(text):
        scores, runs, _ = scan(text)
        chances = [-math.expm1(-math.exp(log_k + math.log(len(scores)) - rate * run)) for run in runs]
        return min(300.0, sum(-math.log(max(p, 1e-300)) for p in chances if p < 0.05))

    points = [(round(evidence(text) * 20) / 20, toxic) for text, toxic in known]
    x, y = np.array([[e, 1.0] for e, _ in points]), np.array([float(t) for _, t in points])
    w = np.zeros(2)
    for _ in range(20_000):  # small steps uphill, to the same optimum
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w)
        w += 0.2 * step
        if np.abs(step).max() < 1e-10:
            break
    return {i: 1 / (1 + math.exp(-(w[0] * evidence(text) + w[1]))) for i, text in docs}


def word_score(model, words):
    found = model.nodes.toArrow()
    table = word_nodes.NodeScores(found.column("key").to_numpy().view(np.uint64), found.column("score").to_numpy())
    return {w: float(table.of_words(word_nodes.Units([w]))[0]) - toxicity.WORD_COST for w in words}


def test_words_of_many_texts():
    texts = ["The Quick-brown fox_2 jumps", "", "ÉTÉ déjà İstanbul", "漢字かな交じり文 and 東 京", "a1b2c3 __ ", "ภาษาไทย x", "word " * 40]
    units = word_nodes.Units([t.lower() for t in texts])
    joined = "\n".join(t.lower() for t in texts)
    for i, text in enumerate(texts):
        at = slice(units.edges[i], units.edges[i + 1])
        assert [joined[a:b] for a, b in zip(units.starts[at], units.ends[at])] == plain_words(text), text
    words = [w for t in texts for w in plain_words(t)]
    assert len(set(units.keys.tolist())) == len(set(words))


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{chr(97 + k)}" for k in rng.integers(0, 26, n)) for n in (3, 400, 0, 90, 1)] + [None]
    column = pa.array(texts, pa.string())

    def lengths():
        return [list(map(int, x)) for x in word_nodes.by_row(column, lambda u: u.keys % np.uint64(10**9))]

    def nodes():
        return sorted(zip(*[x.tolist() for x in word_nodes.distinct_nodes(column)]))

    whole, whole_nodes = lengths(), nodes()
    monkeypatch.setattr(word_nodes, "CHUNK", 60)
    assert lengths() == whole and [len(x) for x in whole] == [3, 400, 0, 90, 1, 0] and nodes() == whole_nodes


def test_looking_up_nodes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(np.concatenate((rng.integers(0, 2**64, n, dtype=np.uint64), np.array([0, 2**64 - 2], np.uint64)[:n])))
        table = word_nodes.NodeScores(keys[::-1].copy(), np.arange(len(keys))[::-1].astype(float))
        assert table.find(keys).tolist() == list(range(len(keys)))
        assert np.isnan(table.find(np.array([5, 2**63, 2**64 - 3], np.uint64))).all()


def test_prefixes_carry_over_to_unseen_words(spark):
    rows = [("nasty the", 1)] * 40 + [("the end", 0)] * 60
    model = toxicity.word_model(spark.createDataFrame(rows, "text string, toxic int"))
    scores = word_score(model, ["nasty", "nastily", "the", "other", "nast"])
    assert scores["nasty"] > 1 and scores["nastily"] > 1 and scores["the"] <= -1
    assert scores["other"] == scores["nast"] == -toxicity.WORD_COST


def test_rare_toxic_words_count_beside_many_ordinary_ones(spark):
    """Sixty thousand words are in more toxic texts than the one that only toxic texts have."""
    letters = "abcdefghijklmnopqrst"
    ordinary = " ".join("".join(w) for w in itertools.islice(itertools.product(letters, repeat=4), 60_000))
    rows = [(f"{ordinary} zzzz" if i < 3 else ordinary, 1) for i in range(5)] + [(f"{ordinary} {i}", 0) for i in range(5)]
    scores = word_score(toxicity.word_model(spark.createDataFrame(rows, "text string, toxic int")), ["zzzz", "aaaa", "zzzy"])
    assert scores["zzzz"] > -toxicity.WORD_COST and scores["aaaa"] == scores["zzzy"] == -toxicity.WORD_COST


def test_words_score_as_word_by_word(spark, corpus_docs):
    """All words of the given texts, also those of a single one, and none that the table leaves out changes."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    texts = [(r.text, r.toxic) for r in toxicity.training_texts(corpus_docs, labels).collect()]
    score = plain_scores(texts)
    words = {w for text, _ in texts for w in plain_words(text)}
    model = toxicity.word_model(spark.createDataFrame(texts, "text string, toxic int"))
    found = word_score(model, words)
    assert len(words) > 1000 and all(found[w] == pytest.approx(score(w), abs=1e-9) for w in words)


@pytest.fixture(scope="module")
def labelled(make_docs, spark):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(600):
        words = [f"w{k}" for k in rng.integers(0, 400, rng.integers(5, 80))]
        toxic = int(i % 5 == 0)
        for _ in range(toxic * 3):
            words.insert(rng.integers(0, len(words)), rng.choice(["stupidly", "stupidest", "moronic"]))
        rows.append((i, " ".join(words)))
        marks.append((i, toxic))
    return make_docs(rows), spark.createDataFrame(marks, "doc_id bigint, toxic int"), dict(marks)


@pytest.mark.parametrize("most_sent", [0, toxicity.MOST_SENT])
def test_scores_are_those_of_the_method_in_plain_python(labelled, make_docs, most_sent):
    """Whether the nodes are sent or joined; texts with scripts without spaces and unknown words among them."""
    docs, labels, marks = labelled
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    further = {9001: "stupidly 漢字かな moronic stupidest", 9002: "", 9003: "unknown words only", 9004: "Stupidly! MORONIC? stupids"}
    model = toxicity.fit(docs, labels, most_sent)
    assert (model.words.size > most_sent) == (most_sent == 0)
    found = {r.doc_id: r.score for r in toxicity.scored(docs.select("doc_id", "text").unionAll(make_docs(list(further.items())).select("doc_id", "text")), model).collect()}
    expected = plain_result(sorted(rows.items()) + sorted(further.items()), marks)
    assert found.keys() == expected.keys()
    assert max(abs(found[i] - expected[i]) for i in found) < 1e-6


def test_rate_solves_its_equation():
    scores, counts = np.array([-1.0, 2.0]), np.array([9.0, 1.0])
    rate = toxicity.rate_of(scores, counts)
    assert 0.9 * np.exp(-rate) + 0.1 * np.exp(2 * rate) == pytest.approx(1)


def test_held_out_accuracy(labelled):
    docs, labels, marks = labelled
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == marks[r.doc_id] for r in held) / len(held) > 0.97


def test_held_out_labels_do_not_matter(labelled):
    docs, labels, _ = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (
        {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, given)).collect()} for given in (labels, turned)
    )
    assert one == other


def test_passages_lie_on_toxic_words(labelled):
    docs, labels, marks = labelled
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    found = toxicity.passages(docs, model.words, model.law).collect()
    assert found
    for r in found:
        assert any(w.startswith(("stupid", "moron")) for w in texts[r.doc_id][r.start:r.stop])


def test_bytes_that_are_no_text(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    broken = spark.sql("SELECT 1 AS doc_id, cast(unhex('73747570696420FF20E282') AS string) AS text")
    row, = toxicity.scored(broken, model).collect()
    assert row.doc_id == 1 and 0 <= row.score <= 1


def test_odd_rows(odd_docs, no_docs, labelled, spark):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(r.predicted == 0 for r in rows)
    assert toxicity.scored(no_docs, model).count() == 0
    odd_labels = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 1)], "doc_id bigint, toxic int")
    assert toxicity.fit(odd_docs, odd_labels) is None
    assert {r.score for r in toxicity.scored(odd_docs, None).collect()} == {0.0}
    assert toxicity.fit(no_docs, odd_labels) is None
