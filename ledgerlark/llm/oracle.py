"""SQL counterparts of the registered queries, for DuckDB."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE["op1_source_mix"] = rf"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents
), sums AS (
    SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
    FROM sized GROUP BY source
), filled AS (
    SELECT source, source_size, w, 3 * source_size AS cap,
        COALESCE(sum(3 * source_size) OVER before, 0) AS held,
        sum(w) OVER (ORDER BY 3 * source_size / w DESC, source NULLS FIRST) AS rest_w,
        sum(source_size) OVER () AS total
    FROM sums
    WINDOW before AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
    SELECT (total - held)::BIGINT AS over, rest_w::BIGINT AS under
    FROM filled WHERE w * (total - held) <= cap * rest_w
    ORDER BY cap / w, source NULLS LAST LIMIT 1
), targets AS (
    SELECT source, source_size,
        CASE WHEN w * over > cap * under THEN cap::DOUBLE ELSE (w * over)::DOUBLE / under END AS target
    FROM filled, level
), drawn AS (
    SELECT doc_id, size, source_size, target,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
        ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '') || ':mix-1'), 1, 13))::BIGINT / 4503599627370496.0 AS u
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken
FROM (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM drawn)
"""

_WORD_RULES = ("casino", "cheap-pills", "free-bets", "porn", "spam-farm", "xxx")
_WORD_MATCHES = ", ".join(
    f"CASE WHEN regexp_matches(host, '(^|[^a-z0-9]){w.replace('-', '[^a-z0-9]')}([^a-z0-9]|$)') THEN '{w}' END"
    for w in _WORD_RULES
)

ORACLE["op3_url_filter"] = rf"""
WITH parts AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts
), rules AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/'
        END AS rule,
        list_filter([{_WORD_MATCHES}], lambda x: x IS NOT NULL) AS words
    FROM split
), chosen AS (
    SELECT *, (SELECT max({{'n': len(x), 'x': x}}).x FROM unnest(words) AS t(x)) AS word FROM rules
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NULL AND word IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
    COALESCE(rule, word) AS matched
FROM chosen
"""

ORACLE["op4_substring_dedup"] = rf"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{_WORD}') AS w FROM documents
), windows AS (
    SELECT doc_id, unnest(range(len(w) - 19)) AS pos,
        unnest(list_transform(range(len(w) - 19), lambda i: array_to_string(w[i + 1:i + 20], ' '))) AS win
    FROM docs WHERE len(w) >= 20
), again AS (
    SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM windows) WHERE n > 1
), gone AS (
    SELECT DISTINCT doc_id, pos + d AS pos FROM again, range(20) AS t(d)
), kept AS (
    SELECT d.doc_id, string_agg(d.word, ' ' ORDER BY d.pos) FILTER (g.pos IS NULL) AS text, count(g.pos) AS n_removed
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM docs) d LEFT JOIN gone g USING (doc_id, pos)
    GROUP BY d.doc_id
)
SELECT doc_id, len(w) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

_COMMON = {
    "de": ("das", "den", "der", "des", "die", "ein", "für", "ist", "mit", "nicht", "und", "von", "zu"),
    "en": ("a", "and", "are", "as", "for", "in", "is", "it", "of", "on", "that", "the", "to", "was", "with"),
    "es": ("con", "de", "del", "el", "en", "la", "las", "los", "por", "que", "se", "un", "una", "y"),
    "fr": ("dans", "de", "des", "du", "est", "et", "la", "le", "les", "pour", "que", "un", "une"),
}
_LISTED = ", ".join(f"('{lang}', '{w}')" for lang, listed in _COMMON.items() for w in listed)
_CLASSES = ("[a-z]+", r"[\x20\x09-\x0D]+", r"[^\x00-\x7F]+", "[A-Z]+", "[0-9]+", "[#*$%&|<>]+", r"""[.,;:!?''"()-]+""")
_LEFT = "".join(
    f", left{i + 1} AS (SELECT *, regexp_replace(l{i}, '{pattern}', '', 'g') AS l{i + 1} FROM left{i})"
    for i, pattern in enumerate(_CLASSES)
)
_CLASS_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, key, {i} AS bin, length(l{i}) - length(l{i + 1}) AS n FROM left{len(_CLASSES)}" for i in range(len(_CLASSES))
)

ORACLE["op5_quality_rules"] = rf"""
WITH listed(lang, word) AS (VALUES {_LISTED}), lists AS (
    SELECT lang, word FROM listed UNION SELECT '*', word FROM listed
), docs AS (
    SELECT doc_id, COALESCE(text, '') AS text, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE '*' END AS key,
        regexp_extract_all(COALESCE(text, ''), '{_WORD}') AS w
    FROM documents
), tokens AS (
    SELECT doc_id, key, unnest(w) AS word FROM docs
), windows AS (
    SELECT doc_id, unnest(range(len(w) - 2)) AS pos, unnest(list_transform(range(len(w) - 2), lambda i: [w[i + 1], w[i + 2], w[i + 3]])) AS tri
    FROM docs WHERE len(w) > 2
), repeated AS (
    SELECT doc_id, count(DISTINCT pos + d) AS n
    FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM windows), (VALUES (0), (1), (2)) AS t(d)
    WHERE n > 1 GROUP BY doc_id
), dup AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id
), left0 AS (SELECT doc_id, key, text AS l0 FROM docs){_LEFT}, chars AS (
    {_CLASS_ROWS} UNION ALL SELECT doc_id, key, {len(_CLASSES)}, length(l{len(_CLASSES)}) FROM left{len(_CLASSES)}
), common AS (
    SELECT t.doc_id, t.key, COALESCE(l.word, '') AS bin, count(*) AS n
    FROM tokens t LEFT JOIN lists l ON l.lang = t.key AND l.word = lower(t.word) GROUP BY ALL
), bins AS (
    SELECT doc_id, key, 'c' AS kind, bin::VARCHAR AS bin, n::DOUBLE AS n FROM chars
    UNION ALL SELECT doc_id, key, 'w', bin, n FROM common
), refs AS (
    SELECT key, kind, bin, n / sum(n) OVER (PARTITION BY key, kind) AS q FROM (SELECT key, kind, bin, sum(n) AS n FROM bins GROUP BY ALL)
), shares AS (
    SELECT doc_id, key, kind, bin, n / sum(n) OVER (PARTITION BY doc_id, kind) AS p FROM bins
), distances AS (
    SELECT d.doc_id, r.kind, sqrt(greatest(0, sum(-m * log2(m)) - (sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) + sum(-q * log2(q))) / 2)) AS far
    FROM (
        SELECT d.doc_id, r.kind, r.q, COALESCE(s.p, 0) AS p, (COALESCE(s.p, 0) + r.q) / 2 AS m
        FROM docs d JOIN refs r ON r.key = d.key AND r.q > 0
        LEFT JOIN shares s ON s.doc_id = d.doc_id AND s.kind = r.kind AND s.bin = r.bin
    ) AS r JOIN docs d USING (doc_id) GROUP BY ALL
), figures AS (
    SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[ 	-
]+', '', 'g')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, COALESCE(dup.n, 0) AS n_dup_lines,
        COALESCE(repeated.n, 0) AS n_repeat_words, length(text) AS n_chars, c.far AS cd, v.far AS wd
    FROM docs d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id)
    LEFT JOIN distances c ON c.doc_id = d.doc_id AND c.kind = 'c'
    LEFT JOIN distances v ON v.doc_id = d.doc_id AND v.kind = 'w'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
        AND NOT (n_chars >= 200 AND COALESCE(cd, 0) > 0.30) AND NOT (n_words >= 50 AND COALESCE(wd, 0) > 0.14 + 1.35 / sqrt(greatest(n_words, 1))) AS kept
FROM figures
"""

ORACLE["op6_ngram_jaccard"] = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END) AS s
    FROM docs WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
        JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), sides AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reached r JOIN sides l ON l.a = r.b
)
SELECT d.doc_id, COALESCE(z.n, 0) AS n_shingles, (SELECT min(b) FROM reached r WHERE r.a = d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes z USING (doc_id)
"""

ORACLE["op7_preference_chat"] = """
WITH known AS (
    SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM conversations WHERE conv_id IS NOT NULL
), paired AS (
    SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, turn, role, text FROM known
    UNION ALL SELECT -conv_id - 1, true, turn, role, text FROM known
    UNION ALL SELECT -conv_id - 1, false, turn, role,
        CASE WHEN role = 'assistant' AND turn = last THEN left(text, length(text) // 2) ELSE text END FROM known
), turns AS (
    SELECT pair_id, COALESCE(turn, -9223372036854775808) AS place, role, text,
        count(*) FILTER (chosen) AS c, count(*) FILTER (NOT chosen) AS r
    FROM paired GROUP BY ALL
), splits AS (
    SELECT pair_id, min(place) FILTER (c <> r) AS split, sum(c) > 0 AS has_c, sum(r) > 0 AS has_r FROM turns GROUP BY pair_id
), parts AS (
    SELECT pair_id, place, role, text, has_c, has_r, unnest(CASE
        WHEN split IS NULL OR place < split THEN [{'part': 'prompt', 'copies': c}]
        ELSE [{'part': 'chosen', 'copies': c}, {'part': 'rejected', 'copies': r}] END) AS p
    FROM turns JOIN splits USING (pair_id)
), shown AS (
    SELECT pair_id, p.part AS part, place, role, text, has_c, has_r, COALESCE(role = 'assistant', false) AS trained,
        repeat('<|' || COALESCE(role, 'user') || '|>' || chr(10) || COALESCE(text, '') || '<|end|>' || chr(10), p.copies::BIGINT) AS piece
    FROM parts WHERE p.copies > 0
), spanned AS (
    SELECT *, COALESCE(sum(length(piece)) OVER (PARTITION BY pair_id, part ORDER BY place, role NULLS FIRST, text NULLS FIRST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM shown
)
SELECT pair_id, 'pair' AS form, NULL::BIGINT AS turn,
    CASE WHEN any_value(has_c) AND any_value(has_r) THEN 'both' WHEN any_value(has_c) THEN 'chosen' ELSE 'rejected' END AS sides,
    COALESCE(string_agg(piece, '' ORDER BY start) FILTER (part = 'prompt'), '') AS prompt,
    COALESCE(string_agg(piece, '' ORDER BY start) FILTER (part = 'chosen'), '') AS chosen,
    COALESCE(string_agg(start || '+' || length(piece), ',' ORDER BY start) FILTER (part = 'chosen' AND trained), '') AS chosen_spans,
    COALESCE(string_agg(piece, '' ORDER BY start) FILTER (part = 'rejected'), '') AS rejected,
    COALESCE(string_agg(start || '+' || length(piece), ',' ORDER BY start) FILTER (part = 'rejected' AND trained), '') AS rejected_spans
FROM spanned GROUP BY pair_id
"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLE["op8_warc"] = f"""
WITH digests AS (
    SELECT page_id, strlen(COALESCE(html, '')) AS payload_bytes, sha1(COALESCE(html, '')) AS hex FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM digests
)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('{_B32}', 1 + (
        (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""

ORACLE["op11_embedding_dedup"] = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v,
        label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
            AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS usable
    FROM embeddings
), units AS (
    SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS size FROM vectors WHERE usable
), pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM units a JOIN units b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.98
), degrees AS (
    SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a
), reached AS (
    SELECT a, a AS b FROM pairs UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON p.a = r.b
), heads AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT vec_id, COALESCE(n_links, 0)::BIGINT AS n_links, COALESCE(component_id, vec_id) AS component_id,
    vec_id = COALESCE(component_id, vec_id) AS kept
FROM vectors LEFT JOIN degrees USING (vec_id) LEFT JOIN heads USING (vec_id)
"""
