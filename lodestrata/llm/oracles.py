"""SQL that gives the same rows as a query, for the operators that SQL can express."""

from __future__ import annotations

from . import licenses, quality

_WORDS = r"[^\x20\x09-\x0D]+"

#: Every window as the text of its words; the smallest id of each decides.
OP10_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50),
x AS (SELECT s.doc_id, s.k, md5(array_to_string(list_slice(d.w, s.k, s.k + 49), ' ')) AS h FROM s JOIN d ON s.doc_id = d.doc_id),
f AS (SELECT h, min(doc_id) AS first_id FROM x GROUP BY 1),
g AS (SELECT x.doc_id, list(x.k) AS starts FROM x JOIN f ON x.h = f.h WHERE x.doc_id > f.first_id GROUP BY 1),
c AS (SELECT doc_id, unnest(starts) AS k FROM g),
gone AS (SELECT DISTINCT doc_id, k + o.i AS k FROM c, (SELECT unnest(range(0, 50)) AS i) o),
r AS (SELECT doc_id, list(k) AS gone, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN r.n IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce((SELECT string_agg(t.v, ' ' ORDER BY t.k) FROM (SELECT unnest(d.w) AS v, unnest(range(1, len(d.w) + 1)) AS k) t WHERE NOT list_contains(r.gone, t.k)), '') END) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


def _op5() -> str:
    lengths = sorted({*quality.NGRAM_LIMITS, quality.BASE_WINDOW})
    parts = " UNION ALL ".join(f"SELECT doc_id, k, {n} AS n, array_to_string(list_slice(w, k, k + {n - 1}), ' ') AS g FROM p WHERE k + {n - 1} <= m" for n in lengths)
    limits = " OR ".join(f"(n = {n} AND chars > {limit} * word_chars)" for n, limit in quality.NGRAM_LIMITS.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
b AS (SELECT doc_id, w, len(w) AS m, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
p AS (SELECT doc_id, w, m, unnest(range(1, m + 1)) AS k FROM b),
win AS ({parts}),
seen AS (SELECT doc_id, n, k, count(*) OVER (PARTITION BY doc_id, n, g) AS times, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY k) AS place FROM win),
cov AS (SELECT DISTINCT doc_id, n, false AS later, k + i AS k FROM (SELECT doc_id, n, k, unnest(range(0, n)) AS i FROM seen WHERE times > 1 AND n = {quality.BASE_WINDOW})
  UNION ALL SELECT DISTINCT doc_id, n, true, k + i FROM (SELECT doc_id, n, k, unnest(range(0, n)) AS i FROM seen WHERE place > 1)),
cw AS (SELECT c.doc_id, c.n, c.later, count(*) AS words, sum(length(b.w[c.k])) AS chars FROM cov c JOIN b ON c.doc_id = b.doc_id GROUP BY 1, 2, 3),
rep AS (SELECT doc_id, words FROM cw WHERE NOT later),
bad AS (SELECT DISTINCT cw.doc_id FROM cw JOIN b ON cw.doc_id = b.doc_id WHERE later AND ({limits})),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT doc_id, line, count(*) AS c FROM l WHERE regexp_matches(line, '{_WORDS}') GROUP BY 1, 2),
ld AS (SELECT doc_id, sum(c - 1) AS dups, sum((c - 1) * strlen(line)) AS dup_bytes, sum(c * strlen(line)) AS bytes FROM lc GROUP BY 1),
m AS (SELECT b.doc_id, b.m AS n_words, b.word_chars, b.n_symbols, coalesce(ld.dups, 0) AS n_dup_lines, coalesce(rep.words, 0) AS n_repeat_words,
  coalesce(ld.dup_bytes > {quality.LINE_CHAR_LIMIT} * ld.bytes, false) OR bad.doc_id IS NOT NULL AS method
  FROM b LEFT JOIN ld ON b.doc_id = ld.doc_id LEFT JOIN rep ON b.doc_id = rep.doc_id LEFT JOIN bad ON b.doc_id = bad.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {quality.BASE_MIN_WORDS} OR 100 * n_repeat_words > {quality.BASE_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.BASE_MIN_WORDS} OR 100 * n_repeat_words > {quality.BASE_PERCENT} * n_words OR method) AS kept FROM m
"""


def _op8() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = f"translate({{}}, '{licenses.UPPER}', '{licenses.LOWER}')"
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licenses.PHRASES)
    templates = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))}, {len(t.split())})" for k, (t, label) in enumerate(licenses.TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({low.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
ph AS (SELECT * FROM (VALUES {phrases}) AS t(phrase, label, k)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')),
hit AS (SELECT pos.doc_id, pos.i - 1 AS i, ph.label FROM pos, ph WHERE array_to_string(list_slice(pos.w, pos.i, pos.i + ph.k - 1), ' ') = ph.phrase),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS labels FROM hit GROUP BY 1),
tp AS (SELECT * FROM (VALUES {templates}) AS t(number, label, tokens, k)),
cut AS (SELECT doc_id, w, unnest(range(len(list_filter(ls, lambda x: len(x) > 0)))) AS block, unnest(list_filter(ls, lambda x: len(x) > 0)) AS line
  FROM (SELECT doc_id, w, list_transform(string_split({low.format("text")}, chr(10)), lambda x: regexp_extract_all(x, '{word}')) AS ls FROM d)),
ln AS (SELECT doc_id, block, w, len(line) AS n, sum(len(line)) OVER (PARTITION BY doc_id ORDER BY block) - len(line) AS before FROM cut),
m AS (SELECT doc_id, block, number, label, size, len(list_intersect(list_slice(w, before + 1, before + n + k), tokens)) AS common FROM (SELECT *, len(tokens) AS size FROM ln, tp)
  WHERE len(list_intersect(list_slice(w, before + 1, before + n + k), tokens)) >= ceil({licenses.THRESHOLD} * size - 1e-9)),
best AS (SELECT doc_id, block, arg_max(label, common * 1000 + number) AS label, max(common / size) AS score FROM m GROUP BY 1, 2),
own AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM best GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a::BIGINT AS first_word, base.z::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n IS NOT NULL THEN 1.0 ELSE coalesce(own.score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base ON d.doc_id = base.doc_id LEFT JOIN own ON d.doc_id = own.doc_id
"""


OP5_SQL, OP8_SQL = _op5(), _op8()
