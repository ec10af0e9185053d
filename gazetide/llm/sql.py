"""SQL counterparts (DuckDB) of the registered queries, where SQL can express them."""

OP5 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id,
           list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
),
sets AS (
    SELECT doc_id,
           CASE WHEN len(w) = 0 THEN []
                WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')))
           END AS s
    FROM words
),
-- Equal sets fold into their smallest id.
folded AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h, s FROM sets),
heads AS (SELECT h, min(doc_id) AS head FROM folded WHERE n > 0 GROUP BY h),
grams AS (
    SELECT f.doc_id AS id, f.n, unnest(f.s) AS g
    FROM folded f JOIN heads ON heads.head = f.doc_id AND heads.h = f.h
),
-- Shingles of one document link nothing.
shared AS (SELECT id, n, g FROM grams WHERE g IN (SELECT g FROM grams GROUP BY g HAVING count(*) > 1)),
links AS (
    SELECT a.id AS a, b.id AS b
    FROM shared a JOIN shared b ON a.g = b.g AND a.id < b.id
    GROUP BY a.id, b.id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT a, b FROM both_ways
    UNION
    SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
),
smallest AS (SELECT a AS head, least(a, min(b)) AS component FROM reach GROUP BY a)
SELECT f.doc_id,
       CAST(f.n AS BIGINT) AS n_shingles,
       coalesce(s.component, h.head, f.doc_id) AS component_id,
       f.doc_id = coalesce(s.component, h.head, f.doc_id) AS kept
FROM folded f LEFT JOIN heads h ON f.n > 0 AND h.h = f.h LEFT JOIN smallest s ON s.head = h.head
"""

_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP7 = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n,
           unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2),
                                 lambda i: array_to_string(w[i : i + least(len(w), 13) - 1], ' '))) AS win
    FROM items WHERE len(w) > 0
),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT d.doc_id, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS pos, d.w
    FROM docs d JOIN lengths l ON l.n <= len(d.w)
),
hits AS (
    SELECT p.doc_id, p.pos, p.n, x.item_id
    FROM (SELECT doc_id, n, pos, array_to_string(w[pos : pos + n - 1], ' ') AS win FROM places) p
    JOIN windows x ON x.n = p.n AND x.win = p.win
),
covered AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit
    FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS word FROM hits) GROUP BY doc_id
),
found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id,
       CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""

OP2 = """
WITH usable AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
    FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    WHERE q.vec_id % 50 = 0
),
ranked AS (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP10 = r"""
WITH all_rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
counted AS (
    SELECT *, length(role) + length(text) + length('<|turn |><|end|>') AS plain,
           concat(role, chr(10), text) AS both_texts
    FROM all_rows
),
-- A backslash is doubled, a control string gets one.
sized AS (
    SELECT *, plain + length(both_texts) - length(replace(both_texts, chr(92), ''))
        + list_sum(list_transform(['<|', '|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
            lambda c: (length(both_texts) - length(replace(both_texts, c, ''))) // length(c))) AS chars
    FROM counted
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP13 = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS HUGEINT) AS size
    FROM documents
),
sources AS (
    SELECT source, sum(size) AS s, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
    FROM sized GROUP BY source
),
-- A source is capped if the water level at which it fills up holds less than all words.
judged AS (
    SELECT a.source, a.s, a.w, sum(least(3 * b.s * a.w, 3 * a.s * b.w)) < (SELECT sum(s) FROM sources) * a.w AS capped
    FROM sources a JOIN sources b ON true GROUP BY a.source, a.s, a.w
),
level AS (
    SELECT sum(s) - coalesce(sum(3 * s) FILTER (capped), 0) AS num, greatest(coalesce(sum(w) FILTER (NOT capped), 0), 1) AS den
    FROM judged
),
goals AS (
    SELECT source, s AS source_size,
           CASE WHEN capped THEN CAST(3 * s AS DOUBLE) ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target,
           CASE WHEN s = 0 THEN 0 WHEN capped THEN 3 * 4294967296 ELSE (w * num * 4294967296) // (s * den) END AS step,
           CAST(concat('0x', substr(md5(concat('mix:', coalesce(source, ''))), 1, 8)) AS HUGEINT) AS shift
    FROM judged CROSS JOIN level
),
line AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS place FROM sized)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * ((place * step + shift) // 4294967296 - ((place - 1) * step + shift) // 4294967296) AS BIGINT) AS taken
FROM line JOIN goals ON line.source IS NOT DISTINCT FROM goals.source
"""

OP12 = r"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
first AS (SELECT text, min(doc_id) AS head FROM docs GROUP BY text),
masks AS (
    SELECT d.part, coalesce(f.good, 0) AS good, coalesce(f.toxic, 0) AS toxic,
           CASE WHEN len(d.w) < 100 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(d.w)) < 80 * len(d.w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * (length(d.text) - length(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(d.text) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN d.doc_id > x.head THEN 16 ELSE 0 END AS mask
    FROM docs d JOIN first x ON x.text = d.text LEFT JOIN flags f ON f.doc_id = d.doc_id
),
counts AS (SELECT part, mask, good, toxic, count(*) AS n FROM masks GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, own)),
orders AS (
    SELECT concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order,
           [a.own, b.own, c.own, d.own, e.own] AS owns
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.own + b.own + c.own + d.own + e.own = 31
      AND len(list_distinct([a.own, b.own, c.own, d.own, e.own])) = 5
),
steps AS (
    SELECT filter_order, s AS step, owns[s] AS own, coalesce(list_sum(owns[1 : s - 1]), 0) AS earlier
    FROM (SELECT *, unnest(range(1, 6)) AS s FROM orders)
),
per_step AS (
    SELECT c.part, s.filter_order, s.step, s.own,
           sum(CASE WHEN c.mask & s.own = 0 AND c.mask & s.earlier = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN c.mask & s.own <> 0 AND c.mask & s.earlier = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN c.mask & s.own <> 0 AND c.mask & s.earlier <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN c.mask = s.own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN c.mask & s.own <> 0 AND c.mask & s.earlier = 0 AND good = 1 THEN n ELSE 0 END) AS good_lost,
           sum(CASE WHEN c.mask & s.own <> 0 AND c.mask & s.earlier = 0 AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
    FROM counts c CROSS JOIN (SELECT filter_order, step, CAST(own AS BIGINT) AS own, CAST(earlier AS BIGINT) AS earlier FROM steps) s
    GROUP BY c.part, s.filter_order, s.step, s.own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM per_step
"""
