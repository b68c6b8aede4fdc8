"""DuckDB SQL for the queries that SQL can express over whole tables in reasonable time.

Secrets, personal data, suffix removal, token files and language-model scores are tested against brute force.
"""

SQL: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS3 = "list_filter(regexp_split_to_array(" + _LOWER.format("coalesce(text, '')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"

SQL["op3_decontamination"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS3} AS ws FROM benchmark),
w AS (SELECT DISTINCT item, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win, least(10, len(ws)) AS n
      FROM b, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS t(i) WHERE len(ws) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS3} AS ws FROM documents),
p AS (SELECT r, ws, i, n FROM d, (SELECT DISTINCT n FROM w) s, unnest(generate_series(1, len(ws) - n + 1)) AS t(i)),
h AS (SELECT r, i, p.n, item FROM p JOIN w ON w.n = p.n AND w.win = array_to_string(ws[i : i + p.n - 1], ' ')),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM h, unnest(generate_series(i, i + n - 1)) AS t(j) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""

SQL["op4_mixing"] = f"""
WITH d0 AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS hex FROM documents),
d AS (SELECT *, coalesce('s' || source, 'n') AS src, CASE WHEN size < 64 THEN 0 WHEN size < 1024 THEN 1 ELSE 2 END AS band,
             (CAST('0x' || substr(hex, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM d0),
s0 AS (SELECT src, source, CAST(sum(size) AS DOUBLE) AS ss FROM d GROUP BY 1, 2),
s1 AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 2.0 * ss AS cap, 1.5 * sum(ss) OVER () AS total FROM s0),
s2 AS (SELECT *, cap / w AS f FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s2),
s AS (SELECT src, ss, CASE WHEN f <= coalesce((SELECT min(lv) FROM s3 x WHERE x.lv <= x.f AND x.f = (SELECT min(f) FROM s3 y WHERE y.lv <= y.f)), 1e308) THEN cap
             ELSE w * (SELECT min(lv) FROM s3 x WHERE x.lv <= x.f AND x.f = (SELECT min(f) FROM s3 y WHERE y.lv <= y.f)) END AS target FROM s3),
b0 AS (SELECT src, band, CAST(sum(size) AS DOUBLE) AS bs FROM d GROUP BY 1, 2),
b1 AS (SELECT b0.*, target, 2.0 * bs AS cap, [1.0, 2.0, 1.5][band + 1] * bs AS w FROM b0 JOIN s USING (src)),
b2 AS (SELECT *, CASE WHEN w > 0 THEN cap / w ELSE 0.0 END AS f FROM b1),
b3 AS (SELECT *, (target - coalesce(sum(cap) OVER (PARTITION BY src ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(w) OVER (PARTITION BY src ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lv FROM b2),
b4 AS (SELECT *, min(CASE WHEN lv <= f THEN f END) OVER (PARTITION BY src) AS f0 FROM b3),
b5 AS (SELECT *, min(CASE WHEN lv <= f AND f = f0 THEN lv END) OVER (PARTITION BY src) AS level FROM b4),
b6 AS (SELECT *, CASE WHEN bs > 0 THEN least(2.0, CASE WHEN f <= coalesce(level, 1e308) THEN cap ELSE w * level END / bs) ELSE 0.0 END AS copies FROM b5),
b AS (SELECT src, band, floor(copies) AS whole, copies - floor(copies) AS p, sum((copies - floor(copies)) * bs) OVER (PARTITION BY src) AS want FROM b6),
q AS (SELECT d.*, ss, target, whole, want, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS o FROM d JOIN s USING (src) JOIN b USING (src, band)),
v AS (SELECT *, o / (1 + o) AS v FROM q),
m AS (SELECT *, v IS NOT NULL AND size > 0 AS ranked, coalesce(sum(CASE WHEN v IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY src ORDER BY v NULLS LAST, hex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS mid FROM v)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target, CAST(size * (whole + CASE WHEN ranked AND mid <= want THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""

SQL["op8_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM t),
e AS (SELECT doc_id, unnest(g) AS x FROM t),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n_shingles + y.n_shingles - k)),
r(doc_id, other) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT n.doc_id, n_shingles, least(n.doc_id, coalesce(min(other), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n_shingles
"""

_B32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_NIBBLES = " || ".join(f"lpad(bin(CAST(('0x' || substr(h, {i}, 1)) AS INTEGER)), 4, '0')" for i in range(1, 41))
_LETTERS = " || ".join(f"substr({_B32}, 1 + " + " + ".join(f"{16 >> k} * CAST(substr(bits, {5 * i + k + 1}, 1) AS INTEGER)" for k in range(5)) + ", 1)" for i in range(32))

SQL["op9_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, {_NIBBLES} AS bits, max(page_id) OVER (PARTITION BY h, strlen(payload)) AS newest FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM q
"""


def _quality_sql() -> str:
    from quillon.llm.quality import ALPHA, DELTA, RULES, steps

    rules, path = list(RULES), steps()
    values = ", ".join(f"{metric} AS m{i}" for i, (metric, _) in enumerate(RULES.values()))
    first = ", ".join(f"CASE WHEN m{rules.index(rule)} > {cut} THEN {i} END" for i, (rule, cut) in enumerate(path))
    table = ", ".join(f"({i}, {rules.index(rule)}, {cut}::DOUBLE)" for i, (rule, cut) in enumerate(path))
    broken = " OR ".join(f"coalesce(m{i} > (SELECT cut FROM limits WHERE limits.g = v.g AND rule = {i}), FALSE)" for i in range(len(rules)))
    term = f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA}))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(0)) AS g, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
f AS (SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS win FROM d, unnest(generate_series(1, len(ws) - 7)) AS s(i)),
w AS (SELECT r, i FROM f QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM w, unnest(generate_series(i, i + 7)) AS s(j) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.r, doc_id, g, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) - length(replace(t, '!', '')) AS n_bangs FROM d JOIN l ON l.r = d.r LEFT JOIN c ON c.r = d.r),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {values} FROM m),
good AS (SELECT g, coalesce(list_min([{first}]), {len(path)}) AS first FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
strata AS (SELECT g, count(*) AS own FROM good GROUP BY g),
shares AS (SELECT {DELTA} / (greatest(1, count(*)) + 1) AS share FROM strata),
pools AS (SELECT g, CASE WHEN own >= ceil(ln(share) / ln(1 - {ALPHA})) THEN g END AS pool FROM strata, shares),
cells AS (SELECT pool, i, count(*) AS n, count(*) FILTER (WHERE first <= i) AS k FROM good JOIN pools USING (g), range({len(path)}) AS s(i) GROUP BY pool, i),
proven AS (SELECT pool, i FROM cells, shares WHERE k < n * {ALPHA} AND list_sum(list_transform(generate_series(0, k), lambda j: {term})) <= share),
limits AS (SELECT g, rule, min(cut) AS cut FROM pools JOIN proven ON proven.pool IS NOT DISTINCT FROM pools.pool JOIN (VALUES {table}) AS p(i, rule, cut) USING (i) GROUP BY g, rule)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT ({broken}) AS kept FROM v
"""


SQL["op10_quality"] = _quality_sql()
