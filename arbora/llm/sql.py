"""DuckDB SQL for the rows of the corpus queries that SQL can express.

There is none for op2 to op5 (Viterbi, training, a tokenizer's merges, a flow with
a seeded order); these are held against brute force in the tests.
"""

from arbora.llm.op08_quality_rules import CLASS_PATTERNS, COMMON_WORDS, SYMBOLS, QualityRules

_OP1 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
g AS (SELECT page_id, payload_bytes, h, first_id, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS n FROM p JOIN f USING (h))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(n, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g"""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Components as smallest labels, spread along links until nothing changes.
_COMPONENTS = """
r(id, root) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.root FROM r JOIN links l ON r.id = l.a WHERE r.root < l.b),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""

_OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(v) = 0 THEN [] WHEN len(v) < 3 THEN [array_to_string(v, ' ')]
  ELSE list_transform(range(1, len(v) - 1), lambda i: v[i] || ' ' || v[i + 1] || ' ' || v[i + 2]) END) AS g FROM w),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM m JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * o >= 90 * (p.n + q.n - o)),
nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.root AS component_id FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id"""

_OP7 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, c.root AS component_id, e.vec_id = c.root AS kept FROM embeddings e JOIN c ON c.id = e.vec_id"""


def _quality(rules: QualityRules = QualityRules()) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda p: f"len(regexp_extract_all(t, {quote(p)}))"
    classes = ", ".join(count(p) for p in CLASS_PATTERNS.values())
    listed = ", ".join(quote(w) for w in COMMON_WORDS)
    known = " + ".join(count(p) for p in CLASS_PATTERNS.values())
    sums = lambda column, n: "[" + ", ".join(f"sum({column}[{i + 1}])" for i in range(n)) + "]"
    n_classes, n_hits = len(CLASS_PATTERNS) + 3, len(COMMON_WORDS) + 1

    def distance(p: str, q: str) -> str:
        a, b = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
        term = f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END + CASE WHEN {b} > 0 THEN {b} * log2(2 * {b} / ({a} + {b})) ELSE 0 END"
        return f"CASE WHEN list_sum({p}) = 0 OR list_sum({q}) = 0 THEN 0 ELSE sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term})) / 2)) END"

    return rf"""
WITH w AS (SELECT row_number() OVER () AS i, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS v FROM documents),
h AS (SELECT i, doc_id, lang, t, v, len(v) AS n_words, length(array_to_string(v, '')) AS word_chars, {count(SYMBOLS)} AS n_symbols, length(t) AS chars,
  list_transform([{listed}], lambda x: len(list_filter(v, lambda y: lower(y) = x))) AS hits FROM w),
k AS (SELECT *, [{classes}, n_symbols, chars - word_chars, word_chars - n_symbols - ({known})] AS cls, list_append(hits, n_words - list_sum(hits)) AS hist FROM h),
g AS (SELECT i, p, v[p] || chr(1) || v[p + 1] || chr(1) || v[p + 2] AS x FROM (SELECT i, v, unnest(range(1, len(v) - 1)) AS p FROM w)),
twice AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY i, x) AS c FROM g) WHERE c > 1),
rep AS (SELECT i, count(DISTINCT p + d) AS n FROM twice, (VALUES (0), (1), (2)) o(d) GROUP BY i),
lines AS (SELECT i, count(*) - count(DISTINCT l) AS n FROM (SELECT i, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY i),
a AS (SELECT k.*, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  n_words < {rules.min_words} OR 100 * coalesce(rep.n, 0) > {rules.max_repeat_percent} * n_words AS base_failed FROM k LEFT JOIN rep ON rep.i = k.i LEFT JOIN lines ON lines.i = k.i),
ref AS (SELECT lang AS rl, {sums('cls', n_classes)} AS rc, {sums('hist', n_hits)} AS rh FROM a WHERE NOT base_failed GROUP BY lang),
b AS (SELECT a.*, CASE WHEN rc IS NULL THEN 0 ELSE {distance('cls', 'rc')} END AS cd, CASE WHEN rh IS NULL THEN 0 ELSE {distance('hist', 'rh')} END AS hd
  FROM a LEFT JOIN ref ON a.lang IS NOT DISTINCT FROM rl)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (cd > {rules.max_class_distance} OR hd > {rules.max_common_distance}) AS kept FROM b"""


def _secrets() -> str:
    """Places come from the pieces between matches; what stands before a match is looked at apart, as there is no look-around."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    # The kinds in their order, their patterns, and what a match must fulfil besides.
    value = r"""["']?\x20*[:=]\x20*["']?"""
    patterns = [
        ("assign", rf"(?i:password|passwd|secret|token|api_?key){value}[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(x.m, {quote(f'^(?i:password|passwd|secret|token|api_?key){value}(.*)$')}, 1, 's')) >= 12"),
        ("access", "AKIA[A-Z0-9]{14,}", "true"),
        ("hex", "[0-9a-f]{16,}", "true"),
        ("endpoint", r"""(?:https?|ftp|jdbc:[a-z0-9]+|s3|redis|mongodb)://[^\x00-\x20"'<>]{2,}""", "true"),
        ("identifier", rf"(?i:user(?:name)?|login|client_id|account_id|access_key_id){value}[A-Za-z0-9@._-]{{3,}}", "x.s = 0 OR NOT regexp_matches(substr(t, x.s, 1), '[A-Za-z0-9_]')"),
        ("weak", "[A-Za-z0-9+/]{32,}={0,2}", "regexp_matches(x.m, '[A-Z]') AND regexp_matches(x.m, '[a-z]') AND regexp_matches(x.m, '[0-9]') AND (x.s = 0 OR NOT regexp_matches(substr(t, x.s, 1), '[A-Za-z0-9+/=_-]'))"),
    ]

    def found(k: int) -> str:
        name, pattern, holds = patterns[k]
        upto = lambda n: f"CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + list_sum(list_transform(list_prepend('', m[1:{n}]), lambda y: length(y))) AS INTEGER)"
        spans = f"list_transform(range(1, len(m) + 1), lambda i: {{'s': {upto('i - 1')}, 'e': {upto('i')}, 'm': m[i]}})"
        cut = f"SELECT i, t, regexp_extract_all(t, {quote(pattern)}) AS m, regexp_split_to_array(t, {quote(pattern)}) AS g FROM d"
        return f"SELECT i, x.s AS s, {k} AS k, x.e AS e, '{name}:' || x.s || ':' || x.e AS shown FROM (SELECT i, t, unnest({spans}) AS x FROM ({cut})) WHERE {holds}"

    near = lambda kinds, more="true": f"EXISTS (SELECT 1 FROM p b WHERE b.i = a.i AND b.k IN ({kinds}) AND abs(b.s - a.s) <= 200 AND {more})"
    secret = f"({near('0, 5')} OR {near('2', '(b.s < a.s OR b.s >= a.e)')})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
p AS MATERIALIZED ({' UNION ALL '.join(map(found, range(len(patterns))))}),
l AS (SELECT * FROM p a WHERE k < 3 OR (k = 3 AND {near('1, 4')} AND {secret}) OR (k = 4 AND {secret})
  OR (k = 5 AND {near('1, 4')} AND NOT EXISTS (SELECT 1 FROM p b WHERE b.i = a.i AND b.k = 0 AND b.s <= a.s AND a.s < b.e))),
o AS (SELECT i, CAST(sum((k = 0)::INT) AS BIGINT) AS x, CAST(sum((k = 1)::INT) AS BIGINT) AS y, CAST(sum((k = 2)::INT) AS BIGINT) AS z,
  string_agg(shown, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(shown, ',' ORDER BY s, k) AS spans FROM l GROUP BY i)
SELECT doc_id, coalesce(x, 0) AS n_assign, coalesce(y, 0) AS n_access, coalesce(z, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (i)"""


#: Windows as hex text; runs of repeated windows become spans, and what lies between them stays.
_OP10 = """
WITH d AS (SELECT row_number() OVER () AS i, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT i, p, md5(substr(h, 2 * p + 1, 400)) AS m FROM (SELECT i, h, unnest(range(0, n - 199)) AS p FROM d)),
s AS (SELECT i, p FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
g AS (SELECT i, p, CASE WHEN p <= lag(p) OVER (PARTITION BY i ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT i, p, sum(fresh) OVER (PARTITION BY i ORDER BY p) AS k FROM g),
runs AS (SELECT i, min(p) AS a, max(p) + 200 AS z FROM r GROUP BY i, k),
e AS (SELECT i, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS stops, sum(z - a) AS gone, count(*) AS spans FROM runs GROUP BY i),
f AS (SELECT d.*, list_append(coalesce(starts, []), n) AS starts, list_prepend(0, coalesce(stops, [])) AS stops, coalesce(gone, 0) AS gone, coalesce(spans, 0) AS spans FROM d LEFT JOIN e USING (i))
SELECT doc_id, n AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, spans + 2), lambda j: substr(h, 2 * stops[j] + 1, 2 * (starts[j] - stops[j]))), ''))) AS kept_sha256 FROM f"""

ORACLES: dict[str, str] = {
    "op1_warc": _OP1,
    "op6_ngram_join": _OP6,
    "op7_embedding_dedup": _OP7,
    "op8_quality_rules": _quality(),
    "op9_secret_scans": _secrets(),
    "op10_suffix_dedup": _OP10,
}
