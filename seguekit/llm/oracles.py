"""DuckDB SQL for the queries that SQL can express."""

_TURNS = r"""t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<', '\l'), '"', '\q') AS body, replace(replace(replace(role, '\', '\\'), '<', '\l'), '"', '\q') AS name FROM t)"""
_ORDER = "ORDER BY turn NULLS FIRST, role, body"

OP1 = f"""WITH {_TURNS}
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length('<turn role="' || name || '">' || body || '</turn>' || chr(10)))::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, sum(ceil(strlen(text) / 4.0))::BIGINT AS expanded_tokens
FROM e GROUP BY conv_id"""

OP3 = r"""WITH a AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
    regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS x FROM pages),
b AS (SELECT page_id, host, regexp_replace(x, '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|nav|article|section|header|footer|title|body|head|html)(?:\s[^>]*)?/?>', chr(10), 'g') AS x FROM a),
c AS (SELECT page_id, host, trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[ \t\r]*\n[\s]*', chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM b),
l AS (SELECT page_id, host, string_split(text, chr(10)) AS lines, text FROM c),
s AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct([trim(y) for y in lines if trim(y) <> ''])) AS line FROM l WHERE host <> '') GROUP BY ALL),
h AS (SELECT host, count(*) AS pages FROM l WHERE host <> '' GROUP BY host),
d AS (SELECT host, list(line) AS cut FROM s JOIN h USING (host) WHERE n >= 2 AND n > 0.3 * pages GROUP BY host),
k AS (SELECT page_id, l.host, lines, text, CASE WHEN cut IS NULL THEN lines ELSE [y for y in lines if trim(y) = '' OR NOT list_contains(cut, trim(y))] END AS kept FROM l LEFT JOIN d ON d.host = l.host)
SELECT page_id, host, len(lines) AS lines_total, len(lines) - len(kept) AS lines_dropped, sha256(CASE WHEN len(kept) < len(lines) THEN array_to_string(kept, chr(10)) ELSE text END) AS text_sha256 FROM k"""

OP10 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents WHERE doc_id IS NOT NULL),
size AS (SELECT doc_id, len(words) AS size FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM w) GROUP BY ALL),
n AS (SELECT count(*) AS docs, sum(size) / count(*) AS mean FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT doc_id AS query_id, term, df FROM tf JOIN df USING (term) WHERE doc_id % 20 = 0),
hit AS (SELECT query_id, tf.doc_id, sum(CAST(floor(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * size / mean)) * 1000000 + 0.5) AS BIGINT)) AS s
    FROM q JOIN tf USING (term) JOIN size ON size.doc_id = tf.doc_id, n GROUP BY ALL)
SELECT query_id, rank, doc_id, s / 1000000 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM hit) WHERE rank <= 10"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# h: CRC-32 of the id's digits, bit by bit (a byte goes in, eight shifts follow). m: equal words p apart; s: stretches of them.
OP11 = rf"""WITH a AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS raw, coalesce(CAST(doc_id AS VARCHAR), '') AS digits FROM documents),
b AS (SELECT *, len(raw) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[-1 - ascii(digits[k]), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] for k in range(1, length(digits) + 1)])),
    lambda c, x: CASE WHEN x < 0 THEN xor(c, -1 - x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM a),
c AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND doc_id IS NOT NULL AND n > 0 THEN (h // 10) % n END AS a0 FROM b),
d AS MATERIALIZED (SELECT id, doc_id, n, CASE WHEN a0 IS NULL THEN raw ELSE [raw[1 + (CASE WHEN i < a0 THEN i ELSE a0 + (i - a0) % (1 + (n - a0) // (3 + g % 8)) END)] for i in range(0, n)] END AS words FROM c),
w AS MATERIALIZED (SELECT id, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM d),
m AS (SELECT x.id, y.i - x.i AS p, x.i FROM w x JOIN w y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY id, p ORDER BY i) AS island FROM m) GROUP BY id, p, island),
r AS MATERIALIZED (SELECT id, start, length, min(p) AS period FROM s WHERE length >= greatest(6, 4 * p) GROUP BY id, start, length),
e AS (SELECT id, count(*) AS n_runs, max_by({{'start': start, 'length': length, 'period': period}}, (length, -start, -period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY id),
x AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT w.id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN x ON x.id = w.id AND x.i = w.i GROUP BY w.id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, n AS n_words FROM d LEFT JOIN e USING (id) LEFT JOIN k USING (id)"""

OP12 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(doc_id, 9223372036854775807) AS rank, {_WORDS} AS words FROM documents),
w AS (SELECT id, rank, i, array_to_string(words[i + 1 : i + 50], ' ') AS passage FROM (SELECT id, rank, words, unnest(range(0, len(words) - 49)) AS i FROM d WHERE len(words) >= 50)),
f AS (SELECT id, i FROM (SELECT id, i, rank, min(rank) OVER (PARTITION BY passage) AS low FROM w) WHERE low < rank),
x AS (SELECT DISTINCT id, unnest(range(i, i + 50)) AS i FROM f),
g AS (SELECT id, count(*) AS n FROM x GROUP BY id),
k AS (SELECT p.id, string_agg(word, ' ' ORDER BY p.i) AS kept FROM (SELECT id, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM d) p ANTI JOIN x ON x.id = p.id AND x.i = p.i GROUP BY p.id)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (id) LEFT JOIN k USING (id)"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
m AS (SELECT id, doc_id, 10 + (90 * len(terms) * docs) // total AS m FROM d, s WHERE len(terms) > 0 AND doc_id IS NOT NULL),
hit AS (SELECT item_id, id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (id) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hit WHERE score > 0) WHERE rank <= 10"""

ORACLES: dict[str, str] = {"op1_chat_formatting": OP1, "op3_line_dedup": OP3, "op10_topk_search": OP10, "op11_periodic_runs": OP11, "op12_substring_dedup": OP12, "op13_ranked_search": OP13}
