"""DuckDB SQL for the queries it can express, over whole tables."""

from __future__ import annotations

from .lm import BACKOFF, UNSEEN
from .mixing import EPOCHS, WEIGHTS
from .quality import CHANCE, LEAST_DOCS, METRICS, UNIT, reach
from .resampling import BUCKETS, LEAST_WORDS, PERCENT, SEED

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PER = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"), "word_length": ("word_chars", "n_words")}
_LOWEST = 100 - METRICS["word_length"]
_LEVELS = (("lang", "source"), ("lang",), ())


def _limit(name: str) -> str:
    return "coalesce(" + ", ".join(f"l{k}.{name}" for k in range(3)) + ")"


_EXCESS = f"(1000 * n_symbols::DOUBLE - coalesce({_limit('hi_symbols')}, symbols) * word_chars::DOUBLE)"
_CHANCE = f" OR {_EXCESS} * {_EXCESS} <= {CHANCE**2 * 1e6}::DOUBLE * n_symbols"


OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, text, lang, source, {WORDS} AS words FROM documents),
w AS (SELECT id, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM d),
t AS (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS n FROM (
  SELECT id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY id ORDER BY i)) WHERE c IS NOT NULL),
r AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY id),
l AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
s AS (SELECT id, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(coalesce(text, ''), '[^\p{{Lu}}]', '', 'g')) AS n_upper,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN l USING (id) LEFT JOIN r USING (id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"coalesce(1000 * {a} // nullif({b}, 0), 0) AS {m}" for m, (a, b) in _PER.items())} FROM s),
x AS (SELECT lang, source, metric, (v >> k) << k AS bucket FROM (SELECT *, greatest(length(bin(v)) - 7, 0) AS k FROM ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM m WHERE NOT base_failed" for m in METRICS)}))),
g AS (SELECT 0 AS level, lang, source, metric, bucket, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 1, lang, NULL, metric, bucket, count(*) FROM x GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, metric, bucket, count(*) FROM x GROUP BY ALL),
few AS (SELECT level, lang, source, metric, sum(n) AS total FROM g GROUP BY ALL HAVING sum(n) < {LEAST_DOCS}),
f2 AS (SELECT level, lang, source, metric, bucket, n * {UNIT} AS weight FROM g WHERE level = 2),
f1 AS (SELECT level, lang, source, metric, bucket, sum(weight)::BIGINT AS weight FROM (SELECT level, lang, source, metric, bucket, n * {UNIT} AS weight FROM g WHERE level = 1 UNION ALL
  SELECT few.level, few.lang, few.source, metric, bucket, floor(({LEAST_DOCS} - total) * {UNIT} * share)::BIGINT FROM few JOIN (SELECT metric, bucket, weight::DOUBLE / sum(weight) OVER (PARTITION BY metric) AS share FROM f2) USING (metric) WHERE few.level = 1) GROUP BY ALL),
f0 AS (SELECT level, lang, source, metric, bucket, sum(weight)::BIGINT AS weight FROM (SELECT level, lang, source, metric, bucket, n * {UNIT} AS weight FROM g WHERE level = 0 UNION ALL
  SELECT few.level, few.lang, few.source, few.metric, bucket, floor(({LEAST_DOCS} - total) * {UNIT} * share)::BIGINT FROM few JOIN (SELECT lang, metric, bucket, weight::DOUBLE / sum(weight) OVER (PARTITION BY lang, metric) AS share FROM f1) a ON a.metric = few.metric AND a.lang IS NOT DISTINCT FROM few.lang WHERE few.level = 0) GROUP BY ALL),
c AS (SELECT *, sum(weight) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS below, sum(weight) OVER (PARTITION BY level, lang, source, metric) AS total FROM (FROM f0 UNION ALL FROM f1 UNION ALL FROM f2)),
q AS (SELECT level, lang, source, metric, {", ".join(f"min(bucket) FILTER (100 * below >= {p} * total) AS q{p}" for p in sorted({50, _LOWEST, *METRICS.values()}))} FROM c WHERE total >= {(LEAST_DOCS - 1) * UNIT} GROUP BY ALL),
h AS (SELECT level, lang, source, {", ".join(f"max(floor(q50 + {reach(p)!r}::DOUBLE * (q{p} + (1 << greatest(length(bin(q{p})) - 7, 0)) - 1 - q50))::BIGINT) FILTER (metric = '{m}') AS hi_{m}" for m, p in METRICS.items())}, max(ceil(q50 - {reach(METRICS["word_length"])!r}::DOUBLE * (q50 - q{_LOWEST}))::BIGINT) FILTER (metric = 'word_length') AS lo_word_length FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_length >= coalesce({_limit("lo_word_length")}, 0) AND {" AND ".join(f"({m} <= coalesce({_limit(f'hi_{m}')}, {m}){_CHANCE if m == 'symbols' else ''})" for m in METRICS)} AS kept
FROM m {" ".join(f"LEFT JOIN h l{k} ON l{k}.level = {k}" + "".join(f" AND l{k}.{c} IS NOT DISTINCT FROM m.{c}" for c in cols) for k, cols in enumerate(_LEVELS))}
"""

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT id, i, w, lag(w) OVER (PARTITION BY id ORDER BY i) AS v FROM (SELECT id, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM d)),
u AS (SELECT id, w, count(*) AS own, sum(count(*)) OVER (PARTITION BY w) AS n FROM w GROUP BY id, w),
b AS (SELECT id, v, w, count(*) AS own, sum(count(*)) OVER (PARTITION BY v, w) AS n FROM w WHERE v IS NOT NULL GROUP BY id, v, w),
s AS (SELECT w.id, CASE WHEN b.n - b.own > 0 THEN (b.n - b.own)::DOUBLE / (c.n - c.own) ELSE (CASE WHEN w.v IS NULL THEN 1.0 ELSE {BACKOFF} END) * (CASE WHEN u.n > u.own THEN u.n - u.own ELSE {UNSEEN} END)::DOUBLE / greatest((SELECT count(*) FROM w) - len(d.words), 1) END AS p, (w.v IS NOT NULL AND b.n = b.own)::INT AS back
  FROM w JOIN d USING (id) JOIN u ON u.id = w.id AND u.w = w.w LEFT JOIN b ON b.id = w.id AND b.v = w.v AND b.w = w.w LEFT JOIN u c ON c.id = w.id AND c.w = w.v),
t AS (SELECT id, sum(ln(p)) AS log_score, sum(back) AS back FROM s GROUP BY id)
SELECT doc_id, len(words) AS n_words, coalesce(back, 0)::BIGINT AS n_backed_off, round(coalesce(log_score, 0.0), 4) AS log_score, round(log_score / nullif(len(words), 0), 6) AS mean_log_score FROM d LEFT JOIN t USING (id)
"""

OP4 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

# taken depends on the seeded draw, so the SQL says what doesn't: the query of the same targets is op7_targets
OP7_TARGETS = rf"""
WITH s AS (SELECT source, sum(len({WORDS}))::BIGINT AS source_size, count(*) AS n_documents FROM documents GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, list_element({list(WEIGHTS)}, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT) AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum({EPOCHS} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r WINDOW o AS (ORDER BY {EPOCHS} * source_size::DOUBLE / weight, rank))
SELECT source, source_size, n_documents, round(CASE WHEN {EPOCHS} * source_size > weight * level THEN weight * max(CASE WHEN {EPOCHS} * source_size > weight * level THEN level END) OVER () ELSE {EPOCHS} * source_size END::DOUBLE, 3) AS target FROM l
"""

OP11_SCATTER = """
WITH e AS (SELECT DISTINCT list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT len(v) AS width, v, generate_subscripts(v, 1) AS i FROM e),
p AS (SELECT width, i, unnest(v) AS b, generate_subscripts(v, 1) AS j, v[i] AS a FROM r),
c AS (SELECT width, i, j, count(*) AS n, sum((a * b)::HUGEINT) AS products, sum(a::HUGEINT) AS sa, sum(b::HUGEINT) AS sb FROM p WHERE j <= i GROUP BY ALL)
SELECT width::INTEGER AS width, i::INTEGER AS i, j::INTEGER AS j, n, (n * products - sa * sb)::VARCHAR AS entry FROM c
"""

# fixed value: 3988292384 is the reversed polynomial of CRC-32
OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT -row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (SELECT id, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM (SELECT id, words FROM d UNION ALL SELECT id, words FROM b)),
g AS (SELECT id, w AS f, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT id, f, count(*) FROM (SELECT id, w || ' ' || lead(w) OVER (PARTITION BY id ORDER BY i) AS f FROM w) WHERE f IS NOT NULL GROUP BY ALL),
z AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS z),
y AS (SELECT f, list_transform(range(len(h) // 2), lambda k: 16 * (instr('0123456789ABCDEF', h[2 * k + 1]) - 1) + instr('0123456789ABCDEF', h[2 * k + 2]) - 1) AS bytes FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM g)),
k AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(z.z[(xor(c, b) & 255) + 1], c >> 8))) % {BUCKETS} AS bucket FROM y, z),
c AS (SELECT bucket, coalesce(sum(n) FILTER (id > 0), 0) AS s, coalesce(sum(n) FILTER (id < 0), 0) AS t FROM g JOIN k USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM c),
m AS (SELECT id, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM g JOIN k USING (f) JOIN gains USING (bucket) GROUP BY id),
s AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (id)),
r AS (SELECT *, CASE WHEN n_words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM s WHERE n_words >= {LEAST_WORDS}) // 100 THEN place END AS rank FROM r
"""

SQL = {"op1_quality_rules": OP1, "op3_lm_scoring": OP3, "op4_exact_top_k": OP4, "op7_targets": OP7_TARGETS, "op11_scatter": OP11_SCATTER, "op13_importance_resampling": OP13}
