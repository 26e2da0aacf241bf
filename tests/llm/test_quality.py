from collections import Counter

import pytest

from bazaarlens.llm import quality

from .test_words import plain_words


def brute(text):
    text = text or ""
    words = plain_words(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if plain_words(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def measured(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_measures_of_given_documents(corpus_docs):
    texts = {r.doc_id: r.text for r in corpus_docs.collect()}
    rows = quality.judge(corpus_docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert measured(r) == brute(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_order_does_not_change_what_is_kept(corpus_docs):
    one, other = (
        {r.doc_id: r.kept for r in quality.judge(corpus_docs, rules).collect()}
        for rules in (quality.RULES, quality.RULES[::-1])
    )
    assert one == other
    kept = {r.doc_id for r in quality.keep(corpus_docs).collect()}
    assert kept == {k for k, v in one.items() if v}


def test_clean_documents_stay(corpus_docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality.judge(docs).join(labels, "doc_id").where("n_words >= 10")
    good = judged.where("quality = 1")
    assert good.where("kept").count() / good.count() > 0.97
    bad = judged.where("quality = 0 AND toxic = 0")
    assert bad.where("NOT kept").count() / bad.count() > 0.6


def test_plan_takes_rejections_per_cost(monkeypatch):
    rules = [quality.Rule(n, lambda f: False) for n in "abc"]
    monkeypatch.setattr(quality, "estimate", lambda *_: ([1.0, 1.0, 0.1], {0b001: 30, 0b011: 50, 0b100: 7, 0b010: 1, 0: 900}))
    assert [r.name for r in quality.plan(None, rules)] == ["a", "c", "b"]


@pytest.mark.parametrize("words,kept", [(9, False), (10, True)])
def test_few_words(make_docs, words, kept):
    text = " ".join(f"word{i}" for i in range(words))
    assert quality.judge(make_docs([(1, text)])).first().kept == kept


RUSSIAN = "в прошлом году учёные из USA показали как устроена память человека и почему она слабеет с возрастом"
GREEK = "οι ερευνητές του DNA έδειξαν πώς αλλάζει η μνήμη με τα χρόνια και γιατί ο ύπνος βοηθά πολύ"
ARABIC = "نشر باحثون من USA دراسة جديدة عن الذاكرة والنوم وكيف تتغير مع مرور السنين عند الناس"
CHINESE = [f"第{i}章介绍了研究人员如何在实验中观察记忆的形成过程以及睡眠对学习效果产生的长期影响和作用" for i in range(12)]
THAI = [f"บทที่{i}อธิบายว่านักวิจัยสังเกตการก่อตัวของความทรงจำในการทดลองอย่างไรและการนอนหลับมีผลอย่างไร" for i in range(12)]


@pytest.mark.parametrize("text", [RUSSIAN, GREEK, ARABIC, "\n".join(CHINESE), "\n".join(THAI)])
def test_clean_texts_of_other_scripts_stay(text):
    assert quality.first_rejection(quality.TextFeatures(text.encode()), quality.RULES) is None


@pytest.mark.parametrize("text,rule", [
    (RUSSIAN.upper(), "shouting"), ("BUY NOW " * 3 + "ONE TWO THREE FOUR FIVE SIX SEVEN", "shouting"),
    (" ".join("xyzuvw"[i % 6] * (40 + i) for i in range(12)), "word_length"),
    (" ".join(f"{i}" + "я" * (40 + i) for i in range(12)), "word_length"),
])
def test_shouting_and_long_words_go(text, rule):
    added = [r for r in quality.RULES if r.name == rule]
    assert quality.first_rejection(quality.TextFeatures(text.encode()), added) == rule


def test_odd_rows(odd_docs, no_docs):
    rows = quality.judge(odd_docs).collect()
    texts = Counter((r.doc_id, brute(r.text)) for r in odd_docs.collect())
    assert Counter((r.doc_id, measured(r)) for r in rows) == texts
    kept = quality.keep(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.keep(no_docs).count() == 0 and quality.judge(no_docs).count() == 0


def test_bytes_that_are_no_text(spark):
    broken = spark.sql("SELECT 1 AS doc_id, concat(repeat('some words ', 20), cast(unhex('FFE282') AS string)) AS text")
    row, = quality.judge(broken).collect()
    assert row.n_words == 41
