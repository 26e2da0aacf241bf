"""SQL for the queries on vectors and on filters, in plain row-level form."""

from __future__ import annotations

from itertools import permutations


def _vector_codes() -> str:
    """Every part against every entry, round by round; distance and entry are packed into one number to break ties."""
    def assigned(book: str) -> str:
        apart = "list_inner_product(part, part) - 2 * list_inner_product(part, entry) + list_inner_product(entry, entry)"
        return f"""SELECT n, p, any_value(part) AS part, min(({apart})::BIGINT * 64 + e) AS best
            FROM parts JOIN {book} USING (p) GROUP BY n, p"""

    def refined(book: str, near: str) -> str:
        return f"""SELECT p, e, coalesce(mean, entry) AS entry FROM {book} LEFT JOIN (
            SELECT p, e, list(floor(total / number) ORDER BY i) AS mean FROM (
                SELECT p, best % 64 AS e, i, sum(part[i]) AS total, count(*) AS number
                FROM {near}, range(1, 1000) t(i) WHERE i <= len(part) GROUP BY p, best % 64, i
            ) GROUP BY p, e) USING (p, e)"""

    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id, label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT n, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS part FROM kept, range(16) t(p)
), book0 AS (SELECT p, n AS e, part AS entry FROM parts WHERE n < 64),
near0 AS ({assigned("book0")}), book1 AS ({refined("book0", "near0")}),
near1 AS ({assigned("book1")}), book2 AS ({refined("book1", "near1")}),
near2 AS ({assigned("book2")}),
codes AS (
    SELECT n, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error
    FROM near2 GROUP BY n
), digest AS (
    SELECT sha256(string_agg(entry[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
    FROM book2, range(1, 1000) t(i) WHERE i <= len(entry)
), labelled AS (SELECT label, sum(error)::BIGINT AS label_error FROM kept JOIN codes USING (n) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM kept k JOIN codes USING (n) JOIN labelled l ON k.label IS NOT DISTINCT FROM l.label, digest
"""


_ORDERS = ", ".join(f"('{''.join(order)}')" for order in permutations("ABCDE"))

OP11_SQL = _vector_codes()

OP12_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM docs),
known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
    SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
        CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
    FROM worded LEFT JOIN known USING (doc_id)
),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
steps AS (
    SELECT filter_order, step, filter_order[step] AS letter, filter_order[:step - 1] AS earlier
    FROM (VALUES {_ORDERS}) orders(filter_order), range(1, 6) t(step)
),
met AS (
    SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS own, fails = letter AS only_own,
        len(list_filter(string_split(earlier, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone
    FROM steps, cells
),
audited AS (
    SELECT part, filter_order, step, letter,
        coalesce(sum(n) FILTER (WHERE NOT gone AND NOT own), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (WHERE NOT gone AND own), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (WHERE gone AND own), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (WHERE only_own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (WHERE NOT gone AND own), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE NOT gone AND own), 0)::BIGINT AS toxic_lost
    FROM met GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM audited
"""
