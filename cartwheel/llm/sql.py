"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from cartwheel.llm.quality import FREQUENT

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# sources get their weights by rank; the k sources with the least room are at their caps, for the smallest k that
# leaves no other source above its own
OP3 = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
                  substr(md5(concat_ws('|', '7', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 16) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, row_number() OVER least_room AS i, sum(source_size) OVER () AS total,
             coalesce(sum(2 * source_size) OVER (least_room ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (least_room ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
      FROM w WINDOW least_room AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)),
r AS (SELECT CAST(150 * total - 100 * held AS DOUBLE) / CAST(100 * open_weight AS DOUBLE) AS ratio FROM o
      WHERE (150 * total - 100 * held) * weight <= 200 * source_size * open_weight ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, least((SELECT ratio FROM r) * weight, CAST(2 * source_size AS DOUBLE)) AS target FROM w),
p AS (SELECT row_number() OVER () AS r, d.*, t.source_size, t.target,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(upto + pass * source_size AS DOUBLE) / target AS finish FROM p CROSS JOIN (SELECT unnest(range(2)) AS pass)),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, k, doc_id, source NULLS LAST, size, pass ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM c),
b AS (SELECT sum(CAST(floor(target) AS BIGINT)) AS budget FROM t)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(size, budget - before))) AS BIGINT) AS taken
FROM q, b GROUP BY r, doc_id, size, source_size, target
"""

_FREQUENT = ", ".join(f"'{w}'" for w in FREQUENT)

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) >= 3),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
v AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM c WHERE n > 1) GROUP BY r),
h AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM d WHERE len(ws) >= 5),
k AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4] FROM h) GROUP BY r),
f AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS letters, len(list_filter(ws, lambda w: w IN ({_FREQUENT}))) AS frequent,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS open_lines, len(lines) AS n_lines, coalesce(k.n, 0) AS windows
      FROM d LEFT JOIN v USING (r) LEFT JOIN k USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND 10 * n_symbols <= n_words
          AND NOT (n_dup_lines >= 3 AND 20 * n_dup_lines > n_words) AND 10 * letters >= 6 * word_chars AND frequent >= 2
          AND 10 * open_lines <= 3 * n_lines AND 10 * windows >= 3 * (n_words - 4) AS kept FROM b
"""

_AHEAD = ", ".join(f"lead(word, {i}) OVER here" for i in range(1, 20))

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
e AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
w AS (SELECT r, doc_id, i, word, lead(word, 19) OVER here IS NOT NULL AS whole, concat_ws(' ', word, {_AHEAD}) AS said
      FROM e WINDOW here AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, i, word, whole AND row_number() OVER (PARTITION BY whole, said ORDER BY doc_id NULLS LAST, r, i) > 1 AS again FROM w),
m AS (SELECT r, i, word, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM s),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

SQL = {"op3_mixed_sources": OP3, "op7_quality_rules": OP7, "op12_word_windows": OP12}
