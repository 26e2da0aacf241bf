import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from bazaarlens.llm import byte_bpe, line_dedup, mixing, quality

from . import test_line_dedup, test_mixing, test_ngram_join, test_quality
from .conftest import DATA
from .test_words import plain_words


def brute(rows):
    """The pipeline on (doc_id, text, source) rows in plain Python."""
    rules = {r.name: r.rejects for r in quality.RULES}
    rows = [r for r in rows if not test_quality.brute(r[1])[5] and not any(
        reject(quality.TextFeatures((r[1] or "").encode())) for reject in rules.values()
    )]
    texts = test_line_dedup.brute(rows, line_dedup.MIN_SITES)
    rows = [(i, texts[i], s) for i, t, s in rows if plain_words(texts[i] or "") or not plain_words(t or "")]
    components = test_ngram_join.brute([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if components[r[0]][1] == r[0]]
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(plain_words(text or ""))
    targets = test_mixing.brute_targets(sizes)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    )
    out = []
    for doc_id, text, source in rows:
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        draw = int(hashlib.md5(f"{mixing.SEED}:{doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        ids = library.encode_ordinary(text or "")
        row = (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        out += [row] * (int(rate) + (draw < rate - int(rate)))
    return sorted(out)


def test_run_as_in_plain_python(spark, corpus_docs):
    rows = [(r.doc_id, r.text, r.source) for r in corpus_docs.collect()]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == brute(rows)


def test_stages_keep_the_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, DATA)
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
            kept.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
