"""DuckDB SQL of the training-data queries that SQL can express.

The others are tested against brute-force versions: token counts, fingerprints and piece ids need
functions that SQL lacks, and the neighbour graph and the three models are iterative.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op11_lexical_search"] = r"""
WITH read_docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS a
    FROM documents
),
counted AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(a) AS term FROM read_docs) GROUP BY ALL),
corpus AS (SELECT count(*) AS nn, sum(len(a))::BIGINT AS ll FROM read_docs WHERE len(a) > 0),
factors AS (SELECT r, 100 - 75 + ((75 * len(a) * nn) // ll) AS m FROM read_docs, corpus WHERE len(a) > 0),
wanted AS (
    SELECT item_id, term, count(*) AS k FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark)
    GROUP BY ALL
),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counted, corpus GROUP BY term
),
scored AS (
    SELECT item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM wanted JOIN counted USING (term) JOIN weights USING (term) JOIN factors USING (r)
    GROUP BY ALL
),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM numbered WHERE rank <= 10
"""

SQL["op5_line_dedup"] = r"""
WITH cut AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (
    SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
    FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM cut)
),
places AS (
    SELECT doc_id, i, 2 AS n, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS piece FROM lines
    UNION ALL SELECT doc_id, i, 1, line FROM lines WHERE words > 50
),
anchors AS (
    SELECT doc_id, i, n FROM places WHERE piece IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY piece ORDER BY doc_id, i) > 1
),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM anchors),
runs AS (
    SELECT doc_id, i, words, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM covered JOIN lines USING (doc_id, i)
),
gone AS (SELECT doc_id, i FROM runs QUALIFY sum(words) OVER (PARTITION BY doc_id, run) >= 20),
texts AS (
    SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS rest,
        count(g.i)::INT AS removed_lines
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT doc_id, CASE WHEN removed_lines > 0 THEN rest ELSE text END AS text, removed_lines
FROM documents JOIN texts USING (doc_id)
"""

SQL["op8_sharding"] = r"""
WITH hashed AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')), 1, 15))::BIGINT AS h
    FROM documents
),
prefixes AS (SELECT *, h >> (60 - d) AS p FROM hashed, (SELECT unnest(range(0, 61)) AS d)),
fitting AS (
    SELECT d, p FROM prefixes GROUP BY d, p HAVING sum(n_bytes) <= 1000000 OR min(h) = max(h)
),
placed AS (
    SELECT doc_id, n_bytes, h, min(d)::INT AS depth FROM prefixes JOIN fitting USING (d, p)
    GROUP BY doc_id, n_bytes, h
)
SELECT doc_id, n_bytes, depth, substr(lpad(bin(h), 60, '0'), 1, depth) AS shard FROM placed
"""

# The exponent of the repetition limit 2 in closed form: (largest / smallest) ^ (1 - a) = 2.
SQL["op9_mixing"] = r"""
WITH docs AS (
    SELECT doc_id, source, coalesce('s' || source, 'n') AS s,
        coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, '')) AS k,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
    FROM documents
),
totals AS (SELECT s, sum(tokens)::BIGINT AS total FROM docs GROUP BY s),
live AS (
    SELECT max(total) AS most, CASE WHEN max(total) <= 2 * min(total) THEN 0.0
        ELSE 1 - ln(2) / ln(max(total) / min(total)) END AS a
    FROM totals WHERE total > 0
),
quotas AS (
    SELECT s, total, CASE WHEN total > 0 THEN round(pow(total, a) * most / pow(most, a))::BIGINT END AS quota
    FROM totals, live
),
plan AS (
    SELECT s, coalesce(quota // total, 1) AS whole, coalesce(quota % total, 0) AS rest,
        greatest(ceil(total / 100000.0), 1)::INT AS blocks
    FROM (SELECT s, quota, nullif(total, 0) AS total FROM quotas)
),
last_epoch AS (
    SELECT doc_id, source, s, k, whole, rest, blocks, sum(tokens) OVER (
        PARTITION BY s ORDER BY ('0x' || substr(md5(k || '/' || whole::VARCHAR), 1, 15))::BIGINT) AS upto
    FROM docs JOIN plan USING (s)
),
drawn AS (
    SELECT *, unnest(range(0, whole + (rest > 0 AND upto <= rest)::INT)) AS epoch FROM last_epoch
)
SELECT doc_id, source, epoch::INT AS epoch, least(floor(
    ('0x' || substr(md5(k || '/' || epoch::VARCHAR), 1, 15))::BIGINT / 1152921504606846976.0 * blocks
)::INT, blocks - 1)::INT AS block
FROM drawn
"""


def registered() -> dict[str, str]:
    return dict(SQL)
