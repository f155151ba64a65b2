"""SQL that DuckDB can run for the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import license_scan, source_audit, url_rules, vector_search

#: Words of a text, A-Z lower-cased, and its shingles of five words; a shorter text is one shingle.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_quote, words)) + "]"


def url_rules_sql() -> str:
    """Given rules, then the combinations of up to three tokens whose support and confidence suffice."""
    rule, verdict = "NULL::VARCHAR", "NULL::VARCHAR"
    for what, text in sorted(url_rules.RULES, key=lambda r: (len(r[1]), r[1])):
        host, path = text[: text.index("/")], text[text.index("/") :]
        fits = f"(host = {_quote(host)} OR ends_with(host, {_quote('.' + host)})) AND starts_with(path, {_quote(path)})"
        rule, verdict = f"CASE WHEN {fits} THEN {_quote(text)} ELSE {rule} END", f"CASE WHEN {fits} THEN {_quote(what)} ELSE {verdict} END"
    sized = {
        1: "SELECT [a.t] AS items, count(*) AS total, count(*) FILTER (v = 'block') AS block, count(*) FILTER (v = 'allow') AS allow FROM tk a GROUP BY a.t",
        2: "SELECT [a.t, b.t], count(*), count(*) FILTER (a.v = 'block'), count(*) FILTER (a.v = 'allow') FROM tk a JOIN tk b ON b.rid = a.rid AND b.t > a.t GROUP BY a.t, b.t",
        3: "SELECT [a.t, b.t, c.t], count(*), count(*) FILTER (a.v = 'block'), count(*) FILTER (a.v = 'allow') FROM tk a JOIN tk b ON b.rid = a.rid AND b.t > a.t JOIN tk c ON c.rid = a.rid AND c.t > b.t GROUP BY a.t, b.t, c.t",
    }
    return rf"""WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT rid, page_id, url, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r),
g AS (SELECT *, {rule} AS rule, {verdict} AS v, CASE WHEN host = '' THEN [] ELSE list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x), list_transform(regexp_extract_all(regexp_replace(path, '[0-9]+', '0', 'g'), '[^/._\-]+'), lambda x: 'p:' || x), list_transform(regexp_extract_all(regexp_extract(url, '\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1), lambda x: 'q:' || x))) END AS tokens FROM h),
tk AS (SELECT rid, v, unnest(tokens) AS t FROM g WHERE v IS NOT NULL),
n AS (SELECT count(*) AS n, count(*) FILTER (v = 'block') AS b FROM g WHERE v IS NOT NULL),
s AS ({sized[1]} UNION ALL {sized[2]} UNION ALL {sized[3]}),
c AS (SELECT items, 'block' AS v, block::DOUBLE / total AS conf, block::DOUBLE / n AS supp FROM s, n WHERE block >= greatest(ceil({url_rules.MIN_SUPPORT}::DOUBLE * n), 1) AND block::DOUBLE / total >= {url_rules.MIN_CONFIDENCE} AND b > 0 AND b < n
  UNION ALL SELECT items, 'allow', allow::DOUBLE / total, allow::DOUBLE / n FROM s, n WHERE allow >= greatest(ceil({url_rules.MIN_SUPPORT}::DOUBLE * n), 1) AND allow::DOUBLE / total >= {url_rules.MIN_CONFIDENCE} AND b > 0 AND b < n),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.v = c.v AND len(q.items) < len(c.items) AND q.conf >= c.conf AND list_has_all(c.items, q.items))),
m AS (SELECT rid, array_to_string(items, ' & ') AS mined_rule, k.v AS mv, conf FROM g JOIN k ON list_has_all(g.tokens, k.items) WHERE g.v IS NULL QUALIFY row_number() OVER (PARTITION BY rid ORDER BY conf DESC, supp DESC, k.v <> 'block', array_to_string(items, ' & ')) = 1)
SELECT page_id, host, path, rule, coalesce(g.v, mv, 'allow') AS verdict, mined_rule, conf AS confidence FROM g LEFT JOIN m USING (rid)"""


def jaccard_join_sql() -> str:
    """Sets, their links, and the smallest doc_id reachable."""
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct({_SHINGLES})) AS s FROM d),
c AS MATERIALIZED (SELECT row_number() OVER () AS cls, s, len(s) AS n, min(doc_id) AS rep, count(*) AS copies FROM s WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT cls, n, unnest(s) AS h FROM c),
l AS MATERIALIZED (SELECT a.cls AS a, b.cls AS b FROM e a JOIN e b ON a.h = b.h AND a.cls <> b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT cls, cls AS seen FROM c UNION SELECT r.cls, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT r.cls, min(c.rep) AS component FROM r JOIN c ON c.cls = r.seen GROUP BY r.cls),
k AS (SELECT l.a AS cls, sum(c.copies) AS linked FROM l JOIN c ON c.cls = l.b GROUP BY l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, coalesce(c.copies - 1 + coalesce(k.linked, 0), 0)::BIGINT AS n_links
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m ON m.cls = c.cls LEFT JOIN k ON k.cls = c.cls"""


def license_scan_sql() -> str:
    """Base places, and the templates' starts where their key phrase stands."""
    rows = []
    for number, t in enumerate(license_scan.templates()):
        at = next(j for j in range(len(t.words)) if t.words[j : j + len(t.key)] == t.key)
        rows += [f"({number}, {_quote(t.label)}, {t.exact}, {j}, {_quote(w)}, {at <= j < at + len(t.key)}, {len(t.words)})" for j, w in enumerate(t.words)]
    return rf"""WITH tw(tid, label, base, j, w, in_key, size) AS (VALUES {', '.join(rows)}),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS MATERIALIZED (SELECT rid, i - 1 AS i, w FROM (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE w IN (SELECT w FROM tw)),
df AS (SELECT w, count(DISTINCT rid) AS df FROM p GROUP BY w),
idf AS (SELECT v.w, ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 0.01::DOUBLE AS idf FROM (SELECT DISTINCT w FROM tw) v LEFT JOIN df ON df.w = v.w),
t AS (SELECT tw.*, idf, sum(idf) OVER (PARTITION BY tid) AS whole, count(*) FILTER (in_key) OVER (PARTITION BY tid) AS key_size FROM tw JOIN idf ON idf.w = tw.w),
st AS (SELECT DISTINCT p.rid, tid, label, base, size, whole, key_size, p.i - t.j AS s FROM p JOIN t ON t.w = p.w AND t.in_key WHERE p.i >= t.j),
hit AS (SELECT st.rid, st.label, st.base, st.s, CASE WHEN st.base THEN 1.0::DOUBLE ELSE sum(t.idf) / any_value(st.whole) END AS share FROM st JOIN t ON t.tid = st.tid JOIN p ON p.rid = st.rid AND p.i = st.s + t.j AND p.w = t.w GROUP BY st.rid, st.tid, st.label, st.base, st.s, st.key_size HAVING count(*) FILTER (t.in_key) = st.key_size),
f AS (SELECT rid, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS a, max(s) FILTER (base) AS z, array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS bl, array_to_string(list_sort(list_distinct(list(label))), ',') AS al, least(max(share), 1) AS score FROM hit WHERE share >= {license_scan.LEAST} GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, a AS first_word, z AS last_word, coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN f USING (rid)"""


def decontamination_sql() -> str:
    """Every start of every item's length, with the weighted similarity of its shingles."""
    return f"""WITH b AS (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0 GROUP BY w),
i AS MATERIALIZED (SELECT item_id, {_SHINGLES} AS hs FROM b),
d AS MATERIALIZED (SELECT doc_id, {_SHINGLES} AS hs FROM (SELECT DISTINCT doc_id, text, {_WORDS} AS w FROM documents)),
ih AS MATERIALIZED (SELECT item_id, len(hs) AS m, h, count(*) AS c FROM (SELECT item_id, hs, unnest(hs) AS h FROM i) GROUP BY ALL),
dh AS (SELECT doc_id, len(hs) AS n, unnest(hs) AS h, unnest(range(len(hs))) AS p FROM d),
x AS MATERIALIZED (SELECT doc_id, n, item_id, m, h, c, p FROM dh JOIN ih USING (h)),
many AS (SELECT doc_id, item_id FROM x GROUP BY ALL HAVING 100 * count(*) >= 80 * any_value(m)),
s AS (SELECT doc_id, n, item_id, m, h, c, unnest(range(p - m + 1, p + 1)) AS start FROM x JOIN many USING (doc_id, item_id)),
o AS (SELECT doc_id, n, item_id, m, start, h, least(count(*), any_value(c)) AS shared FROM s WHERE start < n GROUP BY doc_id, n, item_id, m, start, h),
v AS (SELECT doc_id, item_id, greatest(start, 0) AS first_word, sum(shared) AS common, least(start + m, n) - greatest(start, 0) + m - sum(shared) AS all_of FROM o GROUP BY doc_id, n, item_id, m, start)
SELECT doc_id, item_id, count(*) AS n_windows, arg_min(first_word, (-(common / all_of), first_word)) AS first_word, max(common / all_of) AS similarity FROM v WHERE 100 * common >= 80 * all_of GROUP BY doc_id, item_id"""


def vector_search_sql() -> str:
    """All inner products of the queries."""
    return f"""WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % {vector_search.QUERY_STEP} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= {vector_search.K}"""


def source_audit_sql() -> str:
    """Shares of the kept terms in every group, their distances, and the terms that stand out."""
    share = "(1 + (1000000000::HUGEINT * ({0} + 2)) // ({1} + 2 * v))::BIGINT"
    apart = "(((p - q)::HUGEINT * (p - q)) // (p + q))::BIGINT"
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS MATERIALIZED (SELECT lang, source, rid, term, count(*) AS c FROM (SELECT lang, source, rid, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(c)::BIGINT AS lc FROM t GROUP BY lang, term HAVING count(*) >= {source_audit.LEAST_DOCS}),
v AS MATERIALIZED (SELECT lang, count(*) AS v, sum(lc)::BIGINT AS ln FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, sum(c)::BIGINT AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
n AS MATERIALIZED (SELECT lang, source, coalesce(sum(c), 0)::BIGINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(c, 0) AS c, lc, ln, v, {share.format("coalesce(c, 0)", "n")} AS p FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({apart.replace("p", "a.p").replace("q", "b.p")})::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
q AS (SELECT lang, source, term, p, {share.format("lc", "ln")} AS q FROM p WHERE c > 0),
tr AS (SELECT lang, source, 'term' AS part, term AS item, {apart} AS value FROM q WHERE p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT * FROM r WHERE part = 'pair' OR rank <= {source_audit.TOP}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_rules": url_rules_sql(),
        "op3_ngram_jaccard_join": jaccard_join_sql(),
        "op4_license_scan": license_scan_sql(),
        "op5_decontamination": decontamination_sql(),
        "op10_vector_search": vector_search_sql(),
        "op12_source_audit": source_audit_sql(),
    }
