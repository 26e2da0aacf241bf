from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Texts that every operator has to cope with.
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD_TEXTS = (
    None, "", " \t\r\n", "one", "a b c d", "x" * 50_000, LONG, "ß é 中文 🙂 a b \x0b\x0c", "same text of six words here",
    "same text of six words here", "line\nline\nline", "&amp; <|im_end|> </s>[INST]", "\x1c\x1d\x1e\x85  ",
)


@pytest.fixture(scope="session")
def spark(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    return spark


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    def make(rows):
        return spark.createDataFrame(
            [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows], COLUMNS,
        )

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, make_docs):
    """Odd texts, null ids and sources, repeated rows, equal ids, and columns with the operators' own names."""
    rows = [(i, text, None if i % 3 == 0 else f"s{i % 2}") for i, text in enumerate(ODD_TEXTS)]
    rows += [rows[8], rows[8], (4, "another text under a used id", "s1"), (None, "without an id", "s0"), (None, None, None)]
    docs = make_docs(rows)
    for name in ("size", "shard", "slot", "kept", "places", "copies", "target", "set_id", "row", "key", "id", "site",
                 "places", "clean", "component_id", "spans", "score", "n_words", "fingerprint", "range", "extra",
                 "text_key", "toxic", "rate", "copy", "had_text", "mix_source", "gone_id"):
        if name not in docs.columns:
            from pyspark.sql import functions as F
            docs = docs.withColumn(name, F.lit("clash"))
    return docs.cache()


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def corpus_docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
