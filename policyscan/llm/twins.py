"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

#: CRC-32 of a text's UTF-8 bytes: the table by its rule, then one step per byte.
_CRC32 = """
crc_table AS (
  SELECT list(entry ORDER BY n) AS entries
  FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)),
      lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS entry
    FROM range(256) numbers(n)
  )
)"""

_TEXT_CRC32 = """xor(4294967295, list_reduce(
  list_prepend(4294967295, list_transform(
    regexp_extract_all(hex(encode(text)), '..'), lambda pair: ('0x' || pair)::BIGINT)),
  lambda c, byte: xor(entries[xor(c, byte) % 256 + 1], c >> 8)))"""


def _draw(shard: str) -> str:
    return (
        "-ln((('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN 'null' ELSE '=' || doc_id END"
        f" || ':' || {shard}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
    )


#: A vector with an id and without null or non-finite components.
_USABLE = """vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

TWINS: dict[str, str] = {
    "op1_rendezvous_shards": f"""
WITH {_CRC32},
measured AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size,
    CASE WHEN text IS NOT NULL THEN CAST({_TEXT_CRC32} AS BIGINT) END AS text_crc32
  FROM documents, crc_table
),
drawn AS (
  SELECT *, list_transform(range(24), lambda s: {_draw("s")}) AS draws, {_draw("24")} AS more
  FROM measured
),
placed AS (
  SELECT doc_id, size, text_crc32,
    CAST(list_position(draws, list_min(draws)) - 1 AS INTEGER) AS shard,
    more < list_min(draws) AS wins
  FROM drawn
),
grown AS (
  SELECT doc_id, size, text_crc32, shard, CASE WHEN wins THEN 24 ELSE shard END AS grown_shard
  FROM placed
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (
    PARTITION BY shard
    ORDER BY md5(coalesce(doc_id::VARCHAR, 'null') || ':' || size || ':'
      || coalesce(text_crc32::VARCHAR, 'null') || ':' || shard || ':' || grown_shard),
      doc_id, size, text_crc32
  ) - 1 AS slot,
  grown_shard
FROM grown""",
    "op3_temperature_mixture": r"""
WITH measured AS (
  SELECT doc_id, source,
    CAST(greatest(1, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS BIGINT) AS tokens
  FROM documents
),
totals AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total FROM measured GROUP BY source),
ends AS (SELECT max(total)::DOUBLE AS most, min(total)::DOUBLE AS least FROM totals),
tempered AS (
  SELECT most, CASE WHEN most <= 2 * least THEN 0.0 ELSE round(1 - ln(2) / ln(most / least), 6) END AS e FROM ends
),
sized AS (
  SELECT any_value(e) AS e, sum(pow(total::DOUBLE, e)) AS whole,
    ceil(any_value(most) * sum(exp(ln(total / most) * e))) AS budget
  FROM totals, tempered
),
weights AS (
  SELECT source, total, CAST(budget AS BIGINT) AS whole_budget,
    CAST(least(round(pow(total::DOUBLE, e) / whole * budget), floor(2.0 * total)) AS BIGINT) AS budget
  FROM totals, sized
),
parts AS (SELECT greatest(1, (any_value(whole_budget) + 1048575) // 1048576) AS n FROM weights),
used AS (
  SELECT doc_id, m.source, tokens, total, budget,
    CAST(unnest(range(CAST(ceil(budget / total::DOUBLE) AS BIGINT))) AS INTEGER) AS epoch
  FROM measured m JOIN weights w ON m.source IS NOT DISTINCT FROM w.source
),
ranked AS (
  SELECT *, md5('0:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')) AS rank FROM used
),
started AS (
  SELECT *, CAST(epoch * total + sum(tokens) OVER (
      PARTITION BY source, epoch ORDER BY rank, doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS BIGINT) AS start
  FROM ranked
),
placed AS (
  SELECT *, CAST(least(floor(start::DOUBLE * n / budget), n - 1) AS BIGINT) AS block
  FROM started, parts WHERE start < budget
)
SELECT doc_id, source, epoch, tokens, start, block,
  CAST(row_number() OVER (PARTITION BY block ORDER BY md5(rank || ':0'), source, doc_id, tokens) - 1 AS INTEGER) AS slot
FROM placed""",
    "op2_quantised_vector_duplicates": f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x
  FROM embeddings WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95
),
reached AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
),
direct AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
least_reached AS (SELECT a AS vec_id, min(b) AS b FROM reached GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
  least(vec_id, coalesce(b, vec_id)) IS NOT DISTINCT FROM vec_id AS kept
FROM embeddings LEFT JOIN direct USING (vec_id) LEFT JOIN least_reached USING (vec_id)""",
    "op4_approximation_file_search": f"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE {_USABLE}
),
scores AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM vectors q JOIN vectors v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x)
  WHERE q.vec_id % 50 = 0
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
  FROM scores
)
SELECT * FROM ranked WHERE rank <= 5""",
    "op12_repeated_phrase_removal": r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
starts AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS s FROM texts),
windows AS (SELECT r, s, array_to_string(words[s : s + 34], ' ') AS content FROM starts),
repeated AS (SELECT r, s FROM windows QUALIFY count(*) OVER (PARTITION BY content) > 1),
removed AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS place FROM repeated),
placed AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS content
  FROM placed ANTI JOIN removed USING (r, place) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(content, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)""",
    "op13_spelling_variants": f"""
WITH RECURSIVE {_CRC32},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(
      unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
),
counted AS (SELECT run, id || ':' || run AS text, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
summed AS (SELECT run, n, {_TEXT_CRC32} AS h FROM counted, crc_table),
shortened AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM summed
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM shortened WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
),
gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n
  FROM gaps a JOIN gaps b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON b.word = a.l || a.r
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON b.word = a.l || a.r
),
most AS (SELECT word, count(*) AS n_near, max(near_n) AS best FROM pairs GROUP BY word),
chosen AS (
  SELECT word, any_value(n_near) AS n_near, any_value(best) AS best, min(near) AS near
  FROM most JOIN pairs USING (word) WHERE near_n = best GROUP BY word
),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 2 * n THEN near END AS form,
    CASE WHEN best >= 2 * n THEN best END AS form_n
  FROM words LEFT JOIN chosen USING (word)
),
paths AS (
  SELECT word, word AS place, form AS further FROM forms
  UNION ALL
  SELECT p.word, f.word, f.form FROM paths p JOIN forms f ON f.word = p.further
)
SELECT word, form, place AS root, n, n_near, form_n FROM forms JOIN paths USING (word) WHERE further IS NULL""",
}
