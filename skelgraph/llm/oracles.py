"""DuckDB SQL for the operators that SQL can express."""
from . import licenses

OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, round(k / n::DOUBLE, 6) AS containment FROM m JOIN n USING (item_id) WHERE k / n::DOUBLE >= 0.8
"""

OP10 = r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(v, h, q) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
m AS (SELECT page_id, host, path, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS k
      FROM p LEFT JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

OP11 = r"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
n AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM n),
df AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY t, docs),
q AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest({words}) AS t FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score FROM q JOIN df USING (t) JOIN tf USING (t) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0) WHERE rank <= 20
""".replace("{words}", _WORDS.format(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


OP13 = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {words} AS w FROM documents),
df AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= 30),
c AS (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) JOIN df USING (lang, t) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, t, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p FROM g JOIN df USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, t)),
q AS (SELECT lang, t, 1 + (1000000000 * (sum(n)::BIGINT + 5)) // (any_value(total) + 5 * any_value(v)) AS q FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total)::BIGINT AS total FROM g GROUP BY lang) USING (lang) GROUP BY lang, t),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', t, (p - q)::BIGINT FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM e) WHERE part = 'pair' OR rank <= 50
""".replace("{words}", _WORDS.format(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"))


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_TEMPLATE_WORDS = [(t, j, w) for t, (_, line, _) in enumerate(licenses.TEMPLATES) for j, w in enumerate(line.split())]
_PHRASES = [(t, need) for t, (_, _, need) in enumerate(licenses.TEMPLATES)] + [(-1 - k, p) for k, (_, p) in enumerate(licenses.BASE)]
_PHRASE_WORDS = [(t, j, w) for t, p in _PHRASES for j, w in enumerate(p.split())]

# Every place of every template, by joins of words; no index and no order of words.
OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM d),
t(t, j, w) AS (VALUES {_values(_TEMPLATE_WORDS)}),
q(t, j, w) AS (VALUES {_values(_PHRASE_WORDS)}),
names(t, label) AS (VALUES {_values([(t, x) for t, (x, _, _) in enumerate(licenses.TEMPLATES)] + [(-1 - k, x) for k, (x, _) in enumerate(licenses.BASE)])}),
tn AS (SELECT t, count(*) AS n FROM t GROUP BY t),
qn AS (SELECT t, count(*) AS n FROM q GROUP BY t),
phrase AS (SELECT doc_id, t, i - j AS pos, any_value(n) AS n FROM x JOIN q USING (w) JOIN qn USING (t) GROUP BY doc_id, t, i - j HAVING count(*) = any_value(n)),
place AS (SELECT doc_id, t, i - j AS pos, any_value(n) AS n, count(*) AS k FROM x JOIN t USING (w) JOIN tn USING (t) GROUP BY doc_id, t, i - j HAVING count(*) >= {licenses.SHARE} * any_value(n) - 1e-9),
own AS (SELECT DISTINCT place.doc_id, place.t, k / place.n::DOUBLE AS score FROM place JOIN phrase ON place.doc_id = phrase.doc_id AND place.t = phrase.t AND phrase.pos >= place.pos AND phrase.pos + phrase.n <= place.pos + place.n),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM phrase JOIN names USING (t) WHERE t < 0 GROUP BY doc_id),
every AS (SELECT doc_id, t, score FROM own UNION ALL SELECT doc_id, t, 1.0::DOUBLE FROM phrase WHERE t < 0),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM every JOIN names USING (t) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id)
"""

ORACLES = {"op4_decontam": OP4, "op9_licenses": OP9, "op10_urlfilter": OP10, "op11_ranked": OP11, "op13_audit": OP13}
