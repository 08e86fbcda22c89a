"""DuckDB SQL for the queries that it can express: plain rules over whole tables, by no operator's method."""

from __future__ import annotations


def _words(pattern: str) -> str:
    """The words of the column text, a null text's too, with A-Z in lower case."""
    return f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"


#: Equal payloads refer to the least page_id that has them; the digest's base32 is put together from five hexadecimal digits for four letters.
WARC_RECORDS = r"""
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sums AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS n, sha1(payload) AS hex FROM payloads),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex, n) AS first_id FROM sums)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts"""

#: All links of two-word shingles at 80 %, closed over components of distinct sets.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         {_words(r"[^\x20\x09-\x0D]+")} AS w
  FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
pairs AS (SELECT r, word, word || ' ' || lead(word) OVER (PARTITION BY r ORDER BY i) AS two, count(*) OVER (PARTITION BY r) AS n FROM words),
shingles AS (SELECT DISTINCT r, CASE WHEN n = 1 THEN word ELSE two END AS s FROM pairs WHERE n = 1 OR two IS NOT NULL),
sized AS (SELECT r, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS h FROM shingles GROUP BY r),
sets AS (SELECT h, min(r) AS r, any_value(n) AS n FROM sized GROUP BY h),
of_sets AS (SELECT r, s, n, count(*) OVER (PARTITION BY s) AS c FROM shingles JOIN sets USING (r)),
-- Sets that share 80 % share one of the first n - ceil(0.8 n) + 1 of either, in any one order of all shingles: here from the rarest on.
ranked AS (SELECT r, s, n, row_number() OVER (PARTITION BY r ORDER BY c, s) AS k FROM of_sets),
firsts AS (SELECT r, s, n FROM ranked WHERE k <= n - (80 * n + 99) // 100 + 1),
tried AS (
  SELECT DISTINCT a.r AS a, b.r AS b, a.n AS a_n, b.n AS b_n FROM firsts a JOIN firsts b ON a.s = b.s AND a.r < b.r
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM tried JOIN of_sets x ON x.r = a JOIN of_sets y ON y.r = b AND y.s = x.s
  GROUP BY a, b, a_n, b_n HAVING 100 * count(*) >= 80 * (a_n + b_n - count(*))),
reach (a, b) AS (
  SELECT r, r FROM sets
  UNION SELECT reach.a, l.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = reach.b),
least_of AS (SELECT t.h, min(d.doc_id) AS least_id FROM sized t JOIN docs d USING (r) GROUP BY t.h),
component AS (SELECT own.h, min(o.least_id) AS component_id FROM sets own JOIN reach ON reach.a = own.r JOIN sets other ON other.r = reach.b JOIN least_of o ON o.h = other.h GROUP BY own.h)
SELECT d.doc_id, coalesce(t.n, 0) AS n_shingles, CASE WHEN t.h IS NULL THEN d.doc_id ELSE c.component_id END AS component_id,
       d.doc_id IS NOT DISTINCT FROM (CASE WHEN t.h IS NULL THEN d.doc_id ELSE c.component_id END) AS kept
FROM docs d LEFT JOIN sized t ON t.r = d.r LEFT JOIN component c ON c.h = t.h"""

#: Every run of ten words of every document, and of as many as the shorter items have, against the items' windows.
BENCHMARK_HITS = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w
  FROM documents),
items AS (
  SELECT row_number() OVER () AS r, coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w
  FROM benchmark),
item_words AS (SELECT r, item_id, least(len(w), 10) AS k, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM items),
item_runs AS (SELECT item_id, k, n, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run FROM item_words),
windows AS (SELECT DISTINCT item_id, k, run FROM item_runs WHERE i <= n - k + 1),
doc_words AS (SELECT r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
doc_runs AS (
  SELECT r, n, i, k, string_agg(word, ' ') OVER (PARTITION BY r, k ORDER BY i ROWS BETWEEN CURRENT ROW AND k - 1 FOLLOWING) AS run
  FROM doc_words CROSS JOIN (SELECT DISTINCT k FROM windows)),
found AS (SELECT d.r, d.i, d.k, v.item_id FROM doc_runs d JOIN windows v ON v.k = d.k AND v.run = d.run WHERE d.i <= d.n - d.k + 1),
places AS (SELECT r, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT r, i, k FROM found)),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM places GROUP BY r),
owned AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN owned USING (r)"""

#: Every document's score for every item, by their common terms; the fifty highest of each item.
RANKED_SEARCH = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
items AS (SELECT row_number() OVER () AS q, item_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark),
totals AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM docs WHERE len(w) > 0),
stated AS (SELECT DISTINCT q, item_id, unnest(w) AS term FROM items),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM stated) GROUP BY r, term),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM held CROSS JOIN totals GROUP BY term),
damped AS (SELECT r, doc_id, CAST(100 - 50 + (50 * len(w) * n_docs) // n_terms AS BIGINT) AS m FROM docs CROSS JOIN totals WHERE len(w) > 0),
scored AS (
  SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM stated JOIN weighed USING (term) JOIN held USING (term) JOIN damped USING (r) GROUP BY q, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS "rank", doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= 50"""
