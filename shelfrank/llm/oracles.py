"""SQL that the registered queries of this package must agree with, run by DuckDB."""

# All pairs that share a shingle; the texts hold no white space beyond blanks and line ends.
OP3 = r"""
WITH RECURSIVE
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS words
  FROM documents),
grams AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram
  FROM docs),
sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
shared AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.rid < b.rid GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b
  WHERE 5 * shared.n >= 4 * (x.n + y.n - shared.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT rid AS a, rid AS b FROM docs
  UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT d.doc_id, min(o.doc_id) AS class_id, (SELECT count(*) FROM ways WHERE ways.a = d.rid) AS n_links
FROM docs d JOIN reach ON reach.a = d.rid JOIN docs o ON o.rid = reach.b GROUP BY d.rid, d.doc_id
"""

# The addresses of the test pages have nothing to encode.
OP4 = r"""
WITH sized AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
kept AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM sized)
SELECT page_id, payload_bytes, payload_digest, url,
  CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM kept
"""

OP5 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, row_number() OVER w - 1 AS place, lag(role) OVER w AS before,
    length(text) + length(text) - length(replace(replace(replace(text, '~', ''), '[', ''), '<', ''))
      + CASE role WHEN 'system' THEN 6 + 7 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 6 + 4
        ELSE 8 + length(role) + length(role)
          - length(replace(replace(replace(replace(role, '~', ''), '[', ''), '<', ''), ']', '')) + 8 END AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
judged AS (
  SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user')
    WHEN role = 'assistant' THEN before = 'user'
    WHEN role = 'user' THEN before IN ('system', 'assistant') ELSE false END AS fine
  FROM sized),
each AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars, min(place) FILTER (NOT fine) AS bad_turn,
    list(role ORDER BY place) AS roles
  FROM judged GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
  bad_turn IS NULL AS valid,
  CASE WHEN bad_turn IS NULL THEN roles[n_turns] WHEN bad_turn = 0 THEN 'start' ELSE roles[bad_turn] END
    AS end_state,
  bad_turn IS NULL AND roles[n_turns] = 'assistant' AS complete, bad_turn
FROM each
"""

OP6 = r"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
each AS (
  SELECT DISTINCT doc_id, source, line FROM (SELECT doc_id, source, unnest(lines) AS line FROM pages)
  WHERE trim(line) <> ''),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
common AS (
  SELECT each.source, list(line) AS drop FROM (
    SELECT source, line, count(*) AS pages FROM each GROUP BY source, line) each
  JOIN totals ON each.source IS NOT DISTINCT FROM totals.source
  WHERE pages >= 3 AND pages > 0.1::DOUBLE * total GROUP BY each.source),
kept AS (
  SELECT doc_id, pages.source, text, lines,
    list_filter(lines, lambda x: NOT list_contains(coalesce(drop, []), x)) AS stay
  FROM pages LEFT JOIN common ON pages.source IS NOT DISTINCT FROM common.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(stay, chr(10)), '') END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(stay), 0)::BIGINT AS n_dropped
FROM kept
"""

# The table is filled claim by claim: at claim n it is the turn of shard n modulo 64, which takes the
# first slot of its order of preference that nobody has.
OP7 = r"""
WITH RECURSIVE
shards AS (
  SELECT i, ('0x' || substr(md5('offset:' || name), 1, 15))::BIGINT % 8191 AS first,
    ('0x' || substr(md5('skip:' || name), 1, 15))::BIGINT % 8190 + 1 AS skip
  FROM (SELECT i, printf('shard-%02d', i) AS name FROM range(64) t(i))),
params AS (SELECT list(first ORDER BY i) AS first, list(skip ORDER BY i) AS skip FROM shards),
fill AS (
  SELECT 0 AS claim, first, skip, list_transform(range(64), lambda x: 0::BIGINT) AS tries, NULL::BIGINT AS slot,
    list_transform(range(8191), lambda x: false) AS taken
  FROM params
  UNION ALL
  SELECT claim + 1, first, skip,
    list_concat(list_concat(tries[1:turn], [step + 1]), tries[turn + 2:]), (first[turn + 1] + step * skip[turn + 1]) % 8191,
    list_concat(list_concat(taken[1:(first[turn + 1] + step * skip[turn + 1]) % 8191], [true]),
      taken[(first[turn + 1] + step * skip[turn + 1]) % 8191 + 2:])
  FROM (
    SELECT *, list_filter(range(tries[turn + 1], 8191),
      lambda j: NOT taken[(first[turn + 1] + j * skip[turn + 1]) % 8191 + 1])[1] AS step
    FROM (SELECT *, claim % 64 AS turn FROM fill WHERE claim < 8191)))
SELECT doc_id, n_chars, fill.slot::INTEGER AS slot, printf('shard-%02d', (claim - 1) % 64) AS shard
FROM documents JOIN fill
  ON fill.slot = ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % 8191
"""

OP10 = r"""
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)::INTEGER) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
    list_sum(list_transform(range(1, 65), lambda i: abs(q.code[i] - r.code[i])))::BIGINT AS distance
  FROM codes q, codes r WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank,
  neighbor_id, distance
FROM pairs QUALIFY rank <= 10
"""


def oracles() -> dict[str, str]:
    return {
        "op3_jaccard_join": OP3, "op4_warc": OP4, "op5_chat_format": OP5, "op6_line_dedup": OP6, "op7_sharding": OP7, "op10_hamming_topk": OP10,
    }
