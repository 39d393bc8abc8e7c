"""DuckDB SQL of the training-data queries that SQL can express."""

from quizlens.llm import mixing, sharding

_HASH32 = "('0x' || substr(md5({}), 1, 8))::BIGINT"

#: CRC-32 by its definition: a table by rule (polynomial 0xEDB88320, eight shifts a byte), then a fold over the bytes.
_CRC = """
crc_table AS (SELECT list(v ORDER BY i) AS tbl FROM (
    SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, s:
        CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) t(i))),
crc AS (SELECT r.rid, xor(list_reduce([4294967295::BIGINT] || list_transform(
        regexp_extract_all(hex(encode(r.text)), '..'), lambda p: ('0x' || p)::BIGINT),
        lambda c, b: xor(c // 256, k.tbl[xor(c % 256, b) + 1])), 4294967295) AS text_crc32
    FROM rows r, crc_table k)"""

SHARDING = f"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
        coalesce('0' || source, '1') AS src FROM documents),
{_CRC},
keyed AS (SELECT r.doc_id, r.src, strlen(r.text) + 1 AS size, c.text_crc32,
        {_HASH32.format(f"'{sharding.SEED}|' || coalesce(r.doc_id::VARCHAR, '')")} AS h
    FROM rows r JOIN crc c USING (rid)),
sourced AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank,
        count(*) OVER (PARTITION BY src) AS n,
        {_HASH32.format(f"'{sharding.SEED}|start|' || src")} / 4294967296.0::DOUBLE AS start FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY (rank + start) / n, src, rank) - 1 AS pos, count(*) OVER () AS total
    FROM sourced)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * {sharding.SHARDS} // total)::INT AS shard,
    pos - ((pos * {sharding.SHARDS} // total) * total + {sharding.SHARDS - 1}) // {sharding.SHARDS} AS slot,
    NULL::INT AS grown_shard
FROM placed"""

_W = mixing.WEIGHTS
MIXING = f"""
WITH rows AS (SELECT doc_id, coalesce('0' || source, '1') AS src,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
        coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS key FROM documents),
sources AS (SELECT src, sum(size)::BIGINT AS source_size FROM rows GROUP BY src),
weighted AS (SELECT *, ([{', '.join(f'{w}::DOUBLE' for w in _W)}])[((row_number() OVER (ORDER BY src) - 1) % {len(_W)} + 1)::INT] AS w,
        source_size * {float(mixing.MAX_REPEATS)}::DOUBLE AS cap FROM sources),
-- Sources in the order in which a rising level meets their caps; the first whose cap holds sets the level.
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, src
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
chosen AS (SELECT arg_min(level, (cap / w, src)) AS level FROM levels WHERE level * w <= cap),
targets AS (SELECT src, source_size, least(cap, (SELECT level FROM chosen) * w) AS target FROM weighted),
rated AS (SELECT doc_id, size, source_size, target, key, row_number() OVER (PARTITION BY src, key) - 1 AS number, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
    FROM rows JOIN targets USING (src))
SELECT doc_id, size, source_size, target,
    (floor(rate) + CASE WHEN {_HASH32.format(f"'{mixing.SEED}|copy|' || key || '|' || number")} / 4294967296.0::DOUBLE
        < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size AS taken
FROM rated"""

EXACT_DEDUP = """
WITH rows AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
grouped AS (SELECT doc_id, norm, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS place FROM rows
    WINDOW same AS (PARTITION BY norm))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM grouped"""

DIVERGENCE = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
grps AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
sizes AS (SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(s.n, 0) + coalesce(l.v, 0) AS whole, coalesce(l.n, 0) + coalesce(l.v, 0) AS whole_lang
    FROM grps g LEFT JOIN langs l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source) s USING (lang, source)),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // s.whole AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // s.whole_lang AS q
    FROM sizes s JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
