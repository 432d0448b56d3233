"""SQL for DuckDB that gives the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH t AS (SELECT doc_id, {LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt,
    length('<|im_start|>') + length(role) + length(regexp_replace(role, '[^%
]', '', 'g')) * 2 + len(regexp_extract_all(role, '<\\*\|')) + 1
      + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(length(learnt)) AS BIGINT) AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: base32 of the SHA-1, 5 hexadecimal digits (4 letters) at a time.
OP7 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(h, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM m
"""

#: Rank, draw and targets in the same steps and the same double arithmetic as the operator.
OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth, 3 * source_size AS ceiling FROM sources
), shares AS (
  SELECT *, CAST([5, 2, 1][nth % 3 + 1] AS BIGINT) AS weight FROM weighed
), levels AS (
  SELECT *,
    CAST((SELECT sum(source_size) FROM sources) - sum(ceiling) OVER (ORDER BY ceiling / weight, nth ROWS UNBOUNDED PRECEDING) + ceiling AS BIGINT)
      / CAST(sum(weight) OVER (ORDER BY ceiling / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM shares
), goals AS (
  SELECT source, source_size,
    CASE WHEN ceiling <= level * weight THEN CAST(ceiling AS DOUBLE)
         ELSE (SELECT max(level) FROM levels WHERE NOT ceiling <= level * weight) * weight END AS target
  FROM levels
), planned AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target, least(coalesce(g.target / nullif(g.source_size, 0), 0), 3) AS expected,
    (CAST('0x' || substr(md5('mix|' || d.doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), ranked AS (
  SELECT *, floor(expected) AS certain, expected - floor(expected) AS chance, target - floor(expected) * source_size AS rest FROM planned
), drawn AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u / (1 - u) / (chance / (1 - chance)), doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM ranked WHERE chance > 0 AND size > 0
)
SELECT doc_id, size, source_size, target, CAST((certain + CAST(upto - size / 2 <= rest AS BIGINT)) * size AS BIGINT) AS taken FROM drawn
UNION ALL
SELECT doc_id, size, source_size, target, CAST(certain * size AS BIGINT) FROM ranked WHERE NOT (chance > 0 AND size > 0)
"""

#: Every run of words of a window's length in a document, held against every window.
OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), lengths AS (
  SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), starts AS (
  SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM lengths
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM starts
), places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM places
), hits AS (
  SELECT doc_id, i, r.n, item FROM runs r JOIN windows USING (n, k)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

APART = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def plain_rounds(rounds: int) -> str:
    """Nearest centroids and their means, a pair of tables for each round, in whole numbers; the mean is floored by its remainder."""
    out = ""
    for r in range(rounds + 1):
        out += f"""
, a{r} AS MATERIALIZED (
  SELECT rid, c, d FROM (
    SELECT rid, c.c, {APART} AS d, row_number() OVER (PARTITION BY rid ORDER BY {APART}, c.c) AS nth FROM kept k, c{r} c
  ) WHERE nth = 1
)"""
        if r < rounds:
            out += f"""
, s{r} AS (
  SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT a.c, unnest(k.v) AS x, unnest(range(64)) AS i FROM a{r} a JOIN kept k USING (rid)) GROUP BY c, i
), m{r} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c
), c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (c)
)"""
    return out


OP11 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT 40)
){plain_rounds(5)}
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a5 a JOIN kept k USING (rid) JOIN c5 c ON a.c = c.c
"""

OP12 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS i, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS j,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS r
  FROM t
), parts AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN r < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(i, j)], '') AS p, array_to_string(u[least(i, j) + 1:greatest(i, j)], '') AS m, array_to_string(u[greatest(i, j) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

SQL: dict[str, str] = {
    "op2_exact_dedup": OP2,
    "op3_chat": OP3,
    "op7_warc": OP7,
    "op9_mixing": OP9,
    "op10_decontaminate": OP10,
    "op11_clusters": OP11,
    "op12_fill_middle": OP12,
}
