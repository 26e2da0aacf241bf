"""One query per operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import (
    byte_bpe, chat_format, filter_audit, fingerprints, line_dedup, mixing, ngram_join, pii, quality, sharding,
    sketch_dedup, toxicity, vector_codes,
)
from bazaarlens.llm.sql import OP11_SQL, OP12_SQL
from bazaarlens.llm.tables import corpus

Query = Callable[[SparkSession, str], DataFrame]

#: The conversation that op2 formats beside the table's own, as a JSON record in the messages layout.
CONTROL_STRINGS = "</s>[INST] ok [/INST]"


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked_components(corpus(spark, folder)).select("doc_id", "n_shingles", "component_id")


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(CONTROL_STRINGS).alias("content")) for role in ("user", "assistant")
    ])
    record = spark.range(1).select(F.to_json(F.struct(F.lit(-7).alias("conv_id"), said.alias("messages"))).alias("record"))
    further, _ = chat_format.canonical_turns_of_records(record, "record")
    turns = chat_format.canonical_turns(corpus(spark, folder, "conversations")).unionAll(further)
    return chat_format.digests(chat_format.read_back(chat_format.render(turns))).drop("conv_key")


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(corpus(spark, folder))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = corpus(spark, folder)
    return toxicity.scored(docs, toxicity.fit(docs, corpus(spark, folder, "labels")))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.removed_lines(corpus(spark, folder))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = corpus(spark, folder)
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    taken = mixing.with_copies(sized, mixing.source_targets(docs))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
    )


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(corpus(spark, folder), path, public_tokenizers.PATTERN)


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(corpus(spark, folder))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(corpus(spark, folder)).drop("rejected_by")


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_next(corpus(spark, folder))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compressed(corpus(spark, folder, "embeddings"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(filter_audit.cells(corpus(spark, folder), corpus(spark, folder, "labels")))


def op13_sketch_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return sketch_dedup.linked_components(corpus(spark, folder)).drop("text_key")


QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_chat_format": op2_chat_format,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_fingerprints": op10_fingerprints,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_sketch_dedup": op13_sketch_dedup,
}

_DRAW = "(('0x' || substr(md5({key}), 1, 13))::BIGINT)"

OP2_SQL = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), pieces AS (
    SELECT *, replace(text, '&', '&amp;') AS plain, replace(role, '&', '&amp;') AS plain_role,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
    FROM turns
), escaped AS (
    SELECT *, regexp_replace(regexp_replace(plain,
            '<(/?s>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|</?SYS>>)', '&lt;\\1', 'g'),
            '\\[(/?INST\\])', '&lsqb;\\1', 'g') AS body
    FROM pieces
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY place)) AS loss_sha256,
    sum(length('<|im_start|>') + length(plain_role) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT
        AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP5_SQL = """
WITH docs AS (SELECT doc_id, text, coalesce('=' || source, '') AS site, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, site, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM docs),
filled AS (
    SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS occurrence
    FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
spread AS (SELECT line, count(DISTINCT site) AS sites FROM filled GROUP BY line),
gone AS (
    SELECT doc_id, place FROM filled JOIN spread USING (line) WHERE sites >= 5 AND occurrence > 1
),
cleaned AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text FROM lines ANTI JOIN gone USING (doc_id, place)
    GROUP BY doc_id
),
counts AS (SELECT doc_id, count(*) AS n FROM filled GROUP BY doc_id),
losses AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(c.n, 0) AS n_lines, coalesce(x.n, 0) AS n_removed,
    CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM docs d LEFT JOIN cleaned k USING (doc_id) LEFT JOIN counts c USING (doc_id) LEFT JOIN losses x USING (doc_id)
"""

OP6_SQL = f"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
    FROM documents
), sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, 2 * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS words,
        [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM sources
), ranked AS (SELECT *, most / weight AS full_at, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place FROM weighed),
levels AS (
    SELECT a.place, any_value(a.full_at) AS full_at,
        (any_value(a.words) - coalesce(sum(b.most) FILTER (WHERE b.place < a.place), 0)::DOUBLE)
            / sum(b.weight) FILTER (WHERE b.place >= a.place) AS level
    FROM ranked a, ranked b GROUP BY a.place
), final AS (SELECT max(level) AS level FROM levels WHERE level <= full_at),
targets AS (
    SELECT source, source_size, CASE WHEN level IS NULL OR full_at < level THEN most::DOUBLE ELSE weight * level END AS target
    FROM ranked, final
), rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
    (floor(rate)::BIGINT + CASE WHEN {_DRAW.format(key="concat_ws(':', 'mix', doc_id::VARCHAR)")}::DOUBLE / 4503599627370496.0
        < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
"""


ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
