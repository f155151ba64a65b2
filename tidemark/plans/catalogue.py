"""The engine's own queries over the driver's tables, with the SQL that DuckDB can run.

The tables hold no capture time, digest or header, so captures are derived from
``pages`` by arithmetic, and the text categories run over ``pages`` together with a
few fixture pages that show them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import host_of, month_of, path_norm
from tidemark.operators import fold as folding
from tidemark.operators import health, history, native_extract, report, search, selection, text_index
from tidemark.operators.fold import ALL_CATEGORIES, fold
from tidemark.operators.highlights import highlights
from tidemark.plans.cases import CASES, case_query, case_sql
from tidemark.plans.fixtures import fixture_pages, fixture_sql
from tidemark.sources import sinks
from tidemark.sources.index_source import fetch_index, record_index
from tidemark.sources.store import KeyedTable
from tidemark.sources.captures import captures_of_pages, site_index, stamp_of
from tidemark.streaming import live
from tidemark.streaming.incremental import FindingsTable
from tidemark.session import PIECES, scratch, spread, table

LINK = '<a href="([^"]+)"'
TITLE = "(?s)<title>(.*?)</title>"


# --- inputs --------------------------------------------------------------------------


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures_of_pages(table(spark, sf_dir, "pages"))


def all_pages(spark: SparkSession, sf_dir: str, pieces: int = 1) -> DataFrame:
    """``pages`` and the fixture pages as the extractors take them, in smaller ``pieces`` where much is asked of each page."""
    both = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"), pieces).unionByName(fixture_pages(spark))
    domain = F.regexp_extract(host_of(F.col("url")), r"([^.]+\.[^.]+)$", 1)
    return both.select(F.col("page_id").alias("page_seq"), stamp_of(F.col("page_id")).alias("timestamp"), "url", "html", domain.alias("domain"))


def link_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that every page has: its links and its title."""
    pages = table(spark, sf_dir, "pages")
    rows = captures_of_pages(pages).join(pages.select(F.col("page_id").alias("page_seq"), "html"), "page_seq")
    link = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.struct(F.lit("links").alias("category"), x.alias("key")))
    title = F.transform(F.regexp_extract_all("html", F.lit(TITLE), F.lit(1)), lambda x: F.struct(F.lit("titles").alias("category"), x.alias("key")))
    source = F.concat(F.lit("https://web.archive.org/web/"), "timestamp", F.lit("/"), "url")
    each = rows.select("page_seq", month_of(F.col("timestamp")).alias("month"), source.alias("source_url"), F.posexplode_outer(F.concat(title, link)).alias("hit_seq", "h")).where("h is not null")
    return each.select("page_seq", F.col("hit_seq").cast("long").alias("hit_seq"), "h.category", "h.key", "month", "source_url", F.create_map(F.lit("value"), F.col("h.key")).alias("attrs"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(link_hits(spark, sf_dir))


def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folding.ranked(findings(spark, sf_dir))


_CAPTURES = """caps AS (SELECT page_id AS page_seq, (2010 + page_id % 12)::VARCHAR || lpad((1 + (page_id * 7) % 12)::VARCHAR, 2, '0') || lpad((1 + page_id % 28)::VARCHAR, 2, '0') || '120000' AS timestamp, url, md5(html) AS digest, html,
  CASE WHEN regexp_replace(lower(regexp_extract(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '^([^?#]*)', 1)), '/+$', '') = '' THEN '/' ELSE regexp_replace(lower(regexp_extract(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '^([^?#]*)', 1)), '/+$', '') END AS path FROM pages)"""
_FINDINGS = (
    _CAPTURES
    + """, raw AS (SELECT page_seq, timestamp, url, 'links' AS category, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS key FROM caps
  UNION ALL SELECT page_seq, timestamp, url, 'titles', unnest(regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1)) FROM caps),
hits AS (SELECT *, substr(timestamp, 1, 4) || '-' || substr(timestamp, 5, 2) AS month, 'https://web.archive.org/web/' || timestamp || '/' || url AS source_url FROM raw),
f AS (SELECT category, key, min(month) AS first_seen, max(month) AS last_seen, count(*) AS occurrences, arg_min(source_url, page_seq) AS source_url, min(page_seq) AS first_page FROM hits GROUP BY ALL),
b AS (SELECT min(first_seen) AS lo, max(last_seen) AS hi FROM f)"""
)


#: Shares of a cap of 100 by year, from ``y(year, n)``.
_YEARS = """g AS (SELECT *, greatest(0, least(least(n, 3), 100 - coalesce(sum(least(n, 3)) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS given FROM y),
i AS (SELECT *, (100 - sum(given) OVER ()) AS budget, n - given AS room FROM g), j AS (SELECT *, CASE WHEN sum(room) OVER () > 0 THEN budget * room::DOUBLE / sum(room) OVER () ELSE 0 END AS ideal FROM i),
k AS (SELECT *, least(room, floor(ideal)) AS base FROM j), l AS (SELECT *, budget - sum(base) OVER () AS spare, row_number() OVER (ORDER BY (given + base < n) DESC, ideal - floor(ideal) DESC, year DESC) AS place FROM k),
years AS (SELECT year, n, least(n, given + base + CASE WHEN given + base < n AND place <= spare THEN 1 ELSE 0 END)::BIGINT AS allocated FROM l)"""
#: Shares of a group's cap by score times volume, from ``p(g, path, n, score, cap)``.
_DEALT = """s1 AS (SELECT *, count(*) OVER w AS paths, sum(n) OVER w AS total, row_number() OVER (PARTITION BY g ORDER BY score DESC, n DESC, path) AS best, score * n AS weight, cap * (score * n)::DOUBLE / sum(score * n) OVER w AS ideal FROM p WINDOW w AS (PARTITION BY g)),
s2 AS (SELECT *, greatest(1, floor(ideal)) AS held FROM s1),
s3 AS (SELECT *, cap - sum(held) OVER (PARTITION BY g) AS rest, row_number() OVER (PARTITION BY g ORDER BY ideal - held DESC, path DESC) AS place, coalesce(sum(held - 1) OVER (PARTITION BY g ORDER BY weight, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lighter FROM s2),
s4 AS (SELECT *, held - greatest(0, least(held - 1, -rest - lighter)) + (place <= rest)::INT AS given FROM s3),
s5 AS (SELECT *, sum(greatest(0, given - n)) OVER (PARTITION BY g) AS spare, least(given, n) AS kept FROM s4),
s6 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY (kept < n) DESC, ideal - kept DESC, path DESC) AS taker FROM s5),
dealt AS (SELECT g, path, n, score, (CASE WHEN cap >= total THEN n WHEN cap < paths THEN (best <= cap)::INT ELSE kept + (kept < n AND taker <= spare)::INT END)::BIGINT AS allocated FROM s6)"""


# --- extraction -------------------------------------------------------------------------


def _counted(hits: DataFrame) -> DataFrame:
    return hits.groupBy("category", "key").agg(F.count("*").alias("n"))


def _ext(category: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _counted(native_extract.native_hits(all_pages(spark, sf_dir), [category]))

    return run


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(map(_quote, words)) + ")"


def _matches(pattern: str) -> str:
    return f"SELECT page_id, unnest(regexp_extract_all(html, {_quote(pattern)}, 0)) AS m FROM p"


def _over(body: str) -> str:
    return f"WITH p AS (SELECT page_id, url, html FROM pages UNION ALL {fixture_sql()}) {body}"


def _grouped(category: str, parts: list[str]) -> str:
    return _over(f"SELECT {_quote(category)} AS category, key, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY key")


def _ids_sql(category: str, table_, deny_x: bool) -> str:
    parts = []
    for kind, pattern, group in table_:
        more = " AND NOT regexp_matches(replace(regexp_replace(v, '^[^-]*-', ''), '-', ''), '^[Xx]+$')" if deny_x else ""
        parts.append(f"SELECT {_quote(kind + ':')} || v AS key FROM (SELECT regexp_extract(m, {_quote(pattern)}, {group}) AS v FROM ({_matches(pattern)})) WHERE v NOT IN {_in(rules.ID_DENYLIST)}{more}")
    return _grouped(category, parts)


def _tenant_sql(category: str, table_, reserved, missing: str = "") -> list[str]:
    parts = []
    for platform, pattern in table_:
        tries = ", ".join(f"nullif(regexp_extract(m, {_quote(pattern)}, {g}), '')" for g in range(1, pattern.count("([") + 1))
        slug = f"lower(coalesce({tries + ', ' if tries else ''}{_quote(missing)}))"
        keep = f"(length(s) >= 2 AND s NOT IN {_in(reserved)})" + (f" OR s = {_quote(missing)}" if missing else "")
        parts.append(f"SELECT {_quote(platform + ':')} || s AS key FROM (SELECT {slug} AS s FROM ({_matches(pattern)})) WHERE {keep}")
    return parts


def _handles(pattern: str) -> str:
    """The groups ``h`` of a pattern of the form (boundary)(prefix)(words that must not follow)(group): DuckDB's patterns cannot look around."""
    flags, edge, prefix, banned, group = re.fullmatch(r"(\(\?i\))?(\(\?<!\[[^\]]*\]\)|\\b)(.*?)(?:\(\?!(.*?)\))?(\(\[[^()]*\]\{\d+,\d+\}\))(?:\\b)?", pattern).groups()
    start = "\\b" if edge == "\\b" else f"(?:^|[^{edge[5:-2]}])"
    tails = f"SELECT page_id, unnest(regexp_extract_all(html, {_quote((flags or '') + start + prefix + '([A-Za-z0-9_./?%@-]{0,120})')}, 1)) AS t FROM p"
    allowed = f" WHERE NOT regexp_matches(t, {_quote((flags or '') + '^(?:' + banned + ')')})" if banned else ""
    return f"SELECT * FROM (SELECT page_id, regexp_extract(t, {_quote((flags or '') + '^' + group)}, 1) AS h FROM ({tails}){allowed}) WHERE h <> ''"


def _wholes(pattern: str) -> str:
    """The matches ``m`` of a pattern that may begin and end with a character that must not stand there."""
    flags, before, body, after = re.fullmatch(r"(\(\?i\))?(?:\(\?<!\[([^\]]*)\]\))?(.*?)(?:\(\?!\[([^\]]*)\]\))?", pattern).groups()
    start, end = f"(?:^|[^{before}])" if before else "", f"(?:$|[^{after}])" if after else ""
    return f"SELECT page_id, unnest(regexp_extract_all(html, {_quote((flags or '') + start + '(' + body + ')' + end)}, 1)) AS m FROM p"


def _merge_sql() -> str:
    """Trackers widened by the analytics ids of the same identifier, and the ids without one."""
    month = "(2010 + page_id % 12)::VARCHAR || '-' || lpad((1 + (page_id * 7) % 12)::VARCHAR, 2, '0')"
    found = lambda pattern, group: f"SELECT page_id, {month} AS month, regexp_extract(m, {_quote(pattern)}, {group}) AS v FROM ({_matches(pattern)})"
    trackers = " UNION ALL ".join(f"SELECT {_quote(kind)} AS kind, * FROM ({found(pattern, group)}) WHERE NOT regexp_matches(replace(regexp_replace(v, '^[^-]*-', ''), '-', ''), '^[Xx]+$')" for kind, pattern, group in rules.TRACKERS)
    ids = []
    for platform, pattern, group in rules.ANALYTICS:
        before, _, after = rules.ANALYTICS_PIVOTS[platform].partition("{}")
        pivot = f"{_quote(before)} || v || {_quote(after)}" if "{}" in rules.ANALYTICS_PIVOTS[platform] else _quote(before)
        ids.append(f"SELECT {_quote(platform)} AS kind, *, {pivot} AS link FROM ({found(pattern, group)}) WHERE v <> ''")
    kept = f"v NOT IN {_in(rules.ID_DENYLIST)}"
    return _over("")[:-1] + f""", t AS (SELECT kind, v AS id, upper(trim(v)) AS u, min(month) AS f, max(month) AS l, count(*) AS o, min(page_id) AS pg FROM ({trackers}) WHERE {kept} GROUP BY kind, v),
i AS (SELECT kind, v AS id, upper(trim(v)) AS u, min(month) AS f, max(month) AS l, count(*) AS o, min(page_id) AS pg, any_value(link) AS link FROM ({' UNION ALL '.join(ids)}) WHERE {kept} GROUP BY kind, v),
b AS (SELECT u, min(f) AS f, max(l) AS l, max(o) AS o, arg_min(link, pg) AS link, arg_min(id, pg) AS id FROM i GROUP BY u),
x AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY o DESC, pg) AS n FROM t)
SELECT 'analytics_trackers' AS category, x.id, coalesce(least(x.f, b.f), x.f) AS first_seen, coalesce(greatest(x.l, b.l), x.l) AS last_seen, greatest(x.o, coalesce(b.o, 0)) AS occurrences, b.link AS pivot_url FROM x LEFT JOIN b ON b.u = x.u AND x.n = 1
UNION ALL SELECT 'analytics_trackers', id, f, l, o, link FROM b WHERE u NOT IN (SELECT u FROM t)"""


def _lookaround_sql() -> dict[str, str]:
    social = []
    for platform, pattern in rules.SOCIAL:
        denied = rules.SOCIAL_EXCLUDE + rules.SOCIAL_RESERVED.get(platform, ())
        anonymous = f" AND NOT regexp_matches(h, {_quote(rules.LINKEDIN_ANONYMOUS)})" if platform == "linkedin" else ""
        social.append(f"SELECT {_quote(platform + ':')} || lower(h) AS key FROM ({_handles(pattern)}) WHERE length(h) >= 2 AND lower(h) NOT IN {_in(denied)}{anonymous}")
    bounties = [f"SELECT {_quote(platform + ':')} || lower(h) AS key FROM ({_handles(pattern)}) WHERE length(h) >= 2 AND lower(h) NOT IN {_in(rules.BUG_BOUNTY_RESERVED)}" for platform, pattern in rules.BUG_BOUNTIES]
    keys = [f"SELECT m AS key FROM ({_wholes(pattern)})" for kind, pattern in rules.API_KEYS if kind != "Twilio"]
    urls = f"SELECT DISTINCT page_id, regexp_replace(m, '[.,;:''\")\\]}}>]+$', '') AS m FROM ({_wholes(rules.CONNECTION)})"
    authority = "regexp_extract(m, '://([^/?#]*)', 1)"
    user = f"CASE WHEN contains({authority}, '@') THEN regexp_extract({authority}, '^(.*)@', 1) ELSE '' END"
    host = f"lower(regexp_replace(regexp_replace({authority}, '^.*@', ''), ':[^:]*$', ''))"
    connections = [f"SELECT regexp_replace(m, '(://[^:@/]*):([^@]+)@', '\\1:****@') AS key FROM ({urls}) WHERE NOT ({host} IN ('localhost', '127.0.0.1') AND {user} IN ('', ':'))"]
    part = lambda n: f"try(decode(from_base64(rpad(translate(split_part(m, '.', {n}), '-_', '+/'), (ceil(length(split_part(m, '.', {n})) / 4.0) * 4)::INT, '='))))"
    tokens = f"SELECT DISTINCT page_id, m FROM (SELECT page_id, unnest(list_concat(regexp_extract_all(url, {_quote(rules.JWT)}), regexp_extract_all(html, {_quote(rules.JWT)}))) AS m FROM p)"
    jwt = [f"SELECT m AS key FROM ({tokens}) WHERE json_valid({part(1)}) AND json_extract_string({part(1)}, '$.alg') IN {_in(rules.JWT_ALGORITHMS)} AND starts_with(trim({part(2)}), '{{') AND json_valid(trim({part(2)}))"]
    return {f"ext_{c}": _grouped(c, parts) for c, parts in (("social_profiles", social), ("bug_bounty_programs", bounties), ("api_keys", keys), ("connection_strings", connections), ("jwt_tokens", jwt))}


def _ext_sql() -> dict[str, str]:
    out = {
        "ext_analytics_trackers": _ids_sql("analytics_trackers", rules.TRACKERS, True),
        "ext_analytics_ids": _ids_sql("analytics_ids", rules.ANALYTICS, False),
        "ext_cloud_buckets": _grouped("cloud_buckets", [f"SELECT lower(m) AS key FROM ({_matches(p)})" for p in rules.CLOUD_BUCKETS]),
        "ext_adsense_ids": _grouped("adsense_ids", [f"SELECT DISTINCT page_id, {_quote(k + ':')} || regexp_extract(m, {_quote(p)}, {g}) AS key FROM ({_matches(p)})" for k, p, g in rules.ADSENSE]),
        "ext_job_boards": _grouped("job_boards", _tenant_sql("job_boards", rules.JOB_BOARDS, rules.JOB_BOARD_RESERVED)),
        "ext_auth_providers": _grouped("auth_providers", _tenant_sql("auth_providers", rules.AUTH_PROVIDERS, rules.AUTH_RESERVED, "_")),
        "ext_status_pages": _grouped("status_pages", [*_tenant_sql("status_pages", rules.STATUS_PAGES, rules.STATUS_PAGE_RESERVED), f"SELECT 'custom-domain:' || regexp_replace(lower(regexp_extract(m, {_quote(rules.STATUS_CUSTOM)}, 1)), '\\.+$', '') AS key FROM ({_matches(rules.STATUS_CUSTOM)})"]),
        "ext_hosting": _grouped("hosting", [f"SELECT {_quote(n)} AS key FROM p WHERE regexp_matches(html, {_quote(x)})" for n, _, x in rules.HOSTING]),
    }
    consent = []
    for platform, pattern in rules.COOKIE_CONSENT:
        account = f"regexp_extract(html, {_quote(rules.COOKIE_ACCOUNTS[platform])}, 1)" if platform in rules.COOKIE_ACCOUNTS else "''"
        consent.append(f"SELECT CASE WHEN a = '' THEN {_quote(platform)} ELSE {_quote(platform + ':')} || a END AS key FROM (SELECT {account} AS a FROM p WHERE regexp_matches(html, {_quote(pattern)}))")
    out["ext_cookie_consent"] = _grouped("cookie_consent", consent)
    repos = []
    for n, pattern in enumerate(rules.GITHUB_URLS):
        repo = f"regexp_extract(m, {_quote(pattern)}, 2)"
        owner = f"regexp_extract(m, {_quote(pattern)}, 1)"
        repo = f"CASE WHEN {repo} = '' THEN {owner} || '.github.io' ELSE {repo} END" if n == 2 else repo
        repos.append(f"SELECT lower(o) || '/' || lower(r) AS key FROM (SELECT {owner} AS o, regexp_replace({repo}, '\\.git$', '') AS r FROM ({_matches(pattern)})) WHERE r <> '' AND lower(o) NOT IN {_in(rules.GITHUB_RESERVED_OWNERS)} AND lower(r) NOT IN {_in(rules.GITHUB_RESERVED_REPOS)}")
    out["ext_github_repos"] = _grouped("github_repos", repos)
    bad = " OR ".join([f"contains(split_part(e, '@', 1), {_quote(w)})" for w in rules.EMAIL_EXCLUDE] + [f"ends_with(e, {_quote(x)})" for x in rules.IMAGE_EXTENSIONS + rules.ASSET_EXTENSIONS])
    out["ext_emails"] = _grouped("emails", [f"SELECT DISTINCT page_id, e AS key FROM (SELECT page_id, lower(m) AS e FROM ({_matches(rules.EMAIL)})) WHERE NOT ({bad}) AND split_part(e, '@', 2) NOT IN {_in(rules.EMAIL_PLACEHOLDER_DOMAINS)} AND NOT regexp_matches(split_part(e, '@', 2), '^[0-9]+\\.[0-9]+') AND NOT regexp_matches(e, '^u00[0-9a-f]{{2}}')"])
    noise = " OR ".join([f"starts_with(lower(c), {_quote(x)})" for x in rules.COMMENT_EXCLUDE] + [f"contains(lower(c), {_quote(x)})" for x in ("wayback", *rules.COMMENT_NOISE)])
    out["ext_html_comments"] = _grouped("html_comments", [f"SELECT lower(substr(c, 1, 80)) AS key FROM (SELECT regexp_replace(regexp_extract(m, {_quote(rules.COMMENT)}, 1), '^\\s+|\\s+$', '', 'g') AS c FROM ({_matches(rules.COMMENT)})) WHERE length(c) BETWEEN 10 AND 500 AND NOT ({noise})"])
    listing = " ".join(f"WHEN regexp_matches(html, {_quote(x)}) THEN {_quote(n)}" for x, n in rules.LISTINGS)
    out["ext_directory_listings"] = _grouped("directory_listings", [f"SELECT regexp_extract(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '^([^?#]*)', 1) AS key FROM (SELECT url, CASE {listing} END AS kind FROM p) WHERE kind IS NOT NULL"])
    host = "lower(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), ':[0-9]*$', ''))"
    out["ext_url_subdomains"] = _over(f"SELECT 'subdomains' AS category, h AS key, count(*) AS n FROM (SELECT {host} AS h FROM p) WHERE h <> regexp_extract(h, '([^.]+\\.[^.]+)$', 1) AND h <> 'www.' || regexp_extract(h, '([^.]+\\.[^.]+)$', 1) AND regexp_matches(h, '^[a-z0-9.-]+$') GROUP BY h")
    out["ext_titles_links"] = f"WITH {_FINDINGS} SELECT category, key, count(*) AS n FROM hits GROUP BY ALL"
    return out


#: Captures with host and sort key.
_KEYED = "hosted AS (SELECT *, lower(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), ':[0-9]*$', '')) AS host, lower(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '#.*$', '')) AS rest FROM caps), keyed AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS key FROM hosted)"
_MIT = ["x = 'under'", "x = 'the'", "x = 'mit'", "starts_with(x, 'lic')"]
#: Ranked findings, from ``f`` and their first hits.
_RANKED = "o AS (SELECT category, key, min(page_seq * 100000 + spot) AS first_hit FROM (SELECT page_seq, 'links' AS category, unnest(l) AS key, unnest(range(len(t), len(t) + len(l))) AS spot FROM (SELECT page_seq, regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1) AS l, regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1) AS t FROM caps) UNION ALL SELECT page_seq, 'titles', unnest(t), unnest(range(len(t))) FROM (SELECT page_seq, regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1) AS t FROM caps)) GROUP BY ALL), ranked AS (SELECT f.*, o.first_hit, row_number() OVER (PARTITION BY f.category ORDER BY occurrences DESC, o.first_hit, f.key)::INT AS rank FROM f JOIN o ON o.category = f.category AND o.key = f.key)"


def _folded_sql(text: str) -> str:
    return f"translate(lower({text}), {_quote(search._ACCENTED)}, {_quote(search._PLAIN)})"


def _word_sql(piece: str) -> str:
    return f"regexp_extract({piece}, '[\\p{{L}}\\p{{N}}]+')"


def _spaced(allocated: str, group: str, rows: str = "caps") -> str:
    """Captures with their place ``i`` of ``k`` in their group."""
    return f"r AS (SELECT page_seq, timestamp, {allocated} AS allocated, row_number() OVER (PARTITION BY {group} ORDER BY timestamp, url) - 1 AS i, count(*) OVER (PARTITION BY {group}) AS k FROM {rows})"


def _bm25_sql(tests: list[str], limit: int) -> str:
    """BM25 over ``documents`` with one test of a word ``x`` for each of the query's words."""
    fold = f"translate(lower(coalesce(text, '')), {_quote(search._ACCENTED)}, {_quote(search._PLAIN)})"
    every = range(len(tests))
    tf = ", ".join((test if test.startswith("len(") else f"len(list_filter(t, lambda x: {test}))") + f" AS tf{i}" for i, test in enumerate(tests))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in every)
    score = " ".join(f"- greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al))" for i in every)
    return f"WITH d AS (SELECT doc_id AS doc, regexp_extract_all({fold}, '[\\p{{L}}\\p{{N}}]+') AS t FROM documents), c AS (SELECT doc, len(t) AS l, {tf} FROM d), f AS (SELECT count(*) AS n, avg(l) AS al, {df} FROM c) SELECT doc, round(0 {score}, 9) AS score FROM c, f WHERE {' AND '.join(f'tf{i} > 0' for i in every)} ORDER BY score, doc LIMIT {limit}"


# --- queries --------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category over the pages and fixtures, folded, reconciled and ranked."""
    found = folding.findings_of(all_pages(spark, sf_dir, PIECES))
    return found.select("category", "key", folding.value_of().alias("value"), "first_seen", "last_seen", "occurrences", "source_url", "source_page_id", "rank")


def ext_all_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


def ext_url_subdomains(spark, sf_dir):
    return _counted(folding.url_subdomains(all_pages(spark, sf_dir)))


def ext_titles_links(spark, sf_dir):
    return _counted(link_hits(spark, sf_dir))


def sel_preflight(spark, sf_dir):
    return selection.preflight_summary(captures(spark, sf_dir))


def sel_path_groups(spark, sf_dir):
    rows = captures(spark, sf_dir).withColumn("path", path_norm(F.col("url")))
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).withColumn("score", selection.path_score(F.col("path")))


def sel_host_groups(spark, sf_dir):
    return captures(spark, sf_dir).groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


def sel_year_histogram(spark, sf_dir):
    return report.year_histogram(captures(spark, sf_dir))


def sel_day_density(spark, sf_dir):
    return captures(spark, sf_dir).groupBy(F.substring("timestamp", 1, 8).alias("day")).agg(F.count("*").alias("n"))


def sel_date_range(spark, sf_dir):
    return selection.in_months(captures(spark, sf_dir), "2012-03", "2018-10").select("page_seq", "timestamp", "url")


def sel_exclude_keywords(spark, sf_dir):
    return selection.without_keywords(captures(spark, sf_dir), ("casino", "/fr/")).select("page_seq", "url")


def sel_content_dedup(spark, sf_dir):
    return selection.first_of_content(captures(spark, sf_dir)).select("page_seq", "timestamp", "digest")


def sel_month_collapse(spark, sf_dir):
    return selection.collapse_month(captures(spark, sf_dir)).select("page_seq", "timestamp", "url")


def sel_year_allocation(spark, sf_dir):
    return selection.year_allocation(captures(spark, sf_dir), 100)


def sel_evenly_by_year(spark, sf_dir):
    rows = captures(spark, sf_dir).withColumn("year", F.substring("timestamp", 1, 4))
    groups = rows.select("year").distinct().withColumn("allocated", F.lit(5))
    return selection.evenly(rows, groups, ["year"]).select("page_seq", "timestamp")


def sel_score_allocation(spark, sf_dir):
    return selection.score_allocation(captures(spark, sf_dir), 60).select(F.col("_path").alias("path"), "n", "score", "allocated")


def sel_full_selection(spark, sf_dir):
    return selection.select_captures(captures(spark, sf_dir), selection.ScanConfig(cap=100)).select("page_seq", "timestamp", "url")


def sel_stats(spark, sf_dir):
    return selection.selection_stats(captures(spark, sf_dir), selection.ScanConfig(cap=100))


def rep_hosts_by_depth(spark, sf_dir):
    host = host_of(F.col("url"))
    hosts = table(spark, sf_dir, "pages").select(host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"))
    return report.hosts_by_depth(hosts.where("host <> ''"))


def _scans(spark, sf_dir):
    """Orders as scans of their customer's domain, and the time of the newest as a column."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "running").otherwise("failed")
    now = orders.agg(F.max("o_orderdate").alias("now"))
    rows = orders.select(F.col("o_orderkey").alias("url_id"), F.col("o_custkey").alias("domain"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("interval 1800 days")).alias("expires_at"))
    return rows.crossJoin(F.broadcast(now))  # one row


def ops_scan_history(spark, sf_dir):
    """The 50 newest scans (its feature)."""
    return history.recent_scans(_scans(spark, sf_dir), F.col("now")).select("url_id", "domain", "status")


def ops_scan_reuse(spark, sf_dir):
    """What each customer's request for a scan is answered with."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("domain"))
    return history.reused(asked, _scans(spark, sf_dir), F.col("now"))


def fold_findings(spark, sf_dir):
    return fold(link_hits(spark, sf_dir)).select("category", "key", "first_seen", "last_seen", "occurrences", "source_url")


def fold_page_ids(spark, sf_dir):
    pages = captures(spark, sf_dir).withColumn("html", F.lit(""))
    return folding.page_ids(pages)


def rep_summary(spark, sf_dir):
    return report.summary(findings(spark, sf_dir))


def rep_presence(spark, sf_dir):
    return report.with_presence(findings(spark, sf_dir)).groupBy("category", "live").agg(F.count("*").alias("n"))


def rep_change_feed(spark, sf_dir):
    return report.change_feed(findings(spark, sf_dir))


def rep_lanes(spark, sf_dir):
    return report.lanes(findings(spark, sf_dir))


def rep_category_rail(spark, sf_dir):
    return report.category_rail(findings(spark, sf_dir), ("titles", "links", "emails"))


def rep_co_occurrence(spark, sf_dir):
    found = findings(spark, sf_dir)
    return found.join(found.where("category = 'titles'").select("source_url", F.col("key").alias("title")), "source_url").where("category = 'links'").groupBy("title").agg(F.count("*").alias("links"))


def rep_top_links(spark, sf_dir):
    return report.top_of_category(findings(spark, sf_dir), text="a", rows=20).select("category", "key", "occurrences", "place")


def rep_highlights(spark, sf_dir):
    return highlights(folding.findings_of(all_pages(spark, sf_dir, PIECES)), "acme-corp.test")


def merge_analytics(spark, sf_dir):
    found = fold(native_extract.native_hits(all_pages(spark, sf_dir), ["analytics_trackers", "analytics_ids"]))
    merged = folding.merge_analytics(found)
    return merged.select("category", F.coalesce(F.col("attrs")["id"], F.col("attrs")["id_value"]).alias("id"), "first_seen", "last_seen", "occurrences", F.col("attrs")["pivot_url"].alias("pivot_url"))


def search_bm25(spark, sf_dir):
    return search.bm25(spread(table(spark, sf_dir, "documents")), "doc_id", "text", "under the mit lic", 50)


def search_accent_fold(spark, sf_dir):
    return search.bm25(spread(table(spark, sf_dir, "documents")), "doc_id", "text", "être", 20)


def search_postings(spark, sf_dir):
    """Over every turn: a document is one conversation."""
    found = search.postings(table(spark, sf_dir, "conversations"), "conv_id", "text")
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def search_postings_turns(spark, sf_dir):
    """``search_postings`` over every turn: a document is one (conv_id, turn)."""
    found = search.postings(table(spark, sf_dir, "conversations"), F.struct("conv_id", "turn"), "text")
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _searched(spark, sf_dir, query: str, limit: int = 50):
    """Writes the positional index of all documents, then searches it."""
    return text_index.write_index(spread(table(spark, sf_dir, "documents")), "doc_id", "text", scratch(spark)).search(query, limit)


def search_index(spark, sf_dir):
    return _searched(spark, sf_dir, "under the mit lic")


def search_index_phrase(spark, sf_dir):
    return _searched(spark, sf_dir, "under-the mit-lic")


def search_index_prefix(spark, sf_dir):
    return _searched(spark, sf_dir, "der keit", 20)


def snk_upsert_purge(spark, sf_dir):
    """A partitioned copy of the orders: some written anew with their status kept and new ones added, then old ones expired."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    kept = KeyedTable(spark, scratch(spark), "o_orderkey", "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp", buckets=16)
    kept.replace(orders)
    news = orders.where("o_orderkey % 97 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"), "o_orderdate")
    kept.upsert(news.unionByName(news.withColumn("o_orderkey", -F.col("o_orderkey") - 1)), preserve=("o_orderstatus",))
    kept.delete(F.col("o_orderdate") < "1994-01-01")
    return kept.rows()


def export_csv_rows(spark, sf_dir):
    return sinks.csv_rows(ranked_findings(spark, sf_dir))


def export_json(spark, sf_dir):
    return sinks.json_rows(ranked_findings(spark, sf_dir))


def export_markdown(spark, sf_dir):
    return sinks.markdown_rows(ranked_findings(spark, sf_dir))


def stream_running_counts(spark, sf_dir):
    return live.running_counts(table(spark, sf_dir, "events"), "event_type")


def stream_windows(spark, sf_dir):
    return live.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", "2 hours")


def stream_sessions(spark, sf_dir):
    return live.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", "2 hours")


def stream_governor(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "error", "refused").otherwise("ok")
    return live.governor(table(spark, sf_dir, "events").select(F.col("event_type").alias("_"), (F.col("user_id") % 50).cast("string").alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), outcome.alias("outcome")).select("host", (F.col("us") / 1e6).alias("at"), "outcome"))


_STREAMED = ("analytics_trackers", "cloud_buckets", "job_boards", "html_comments")


def stream_findings(spark, sf_dir):
    """All pages as a stream of files, extracted and merged batch by batch."""
    path = scratch(spark)
    pages = spread(all_pages(spark, sf_dir), PIECES)
    pages.write.parquet(f"{path}/in")
    found = FindingsTable(spark, f"{path}/out", list(_STREAMED))
    # two batches, each of as many files as half the table fills: files stay of one size however large it is
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", -(-pages.rdd.getNumPartitions() // 2)).parquet(f"{path}/in")
    found.follow(stream, f"{path}/checkpoint").awaitTermination()
    return found.folded().select("category", "key", F.col("occurrences").alias("n"))


def ops_recent(spark, sf_dir):
    """Events of the last seven days before the newest."""
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("top"))
    return events.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("top") - F.expr("interval 7 days")).groupBy("event_type").agg(F.count("*").alias("n"))


def ops_fair_queue(spark, sf_dir):
    """The next order of each priority: owners with the fewest open orders first, then arrival."""
    orders = table(spark, sf_dir, "orders")
    active = orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("active"))
    waiting = orders.where("o_orderstatus = 'P'").join(active, "o_custkey", "left").withColumn("active", F.coalesce("active", F.lit(0)))
    best = waiting.groupBy("o_orderpriority").agg(F.min(F.struct("active", "o_orderdate", "o_orderkey")).alias("b"))
    return best.select("o_orderpriority", F.col("b.o_orderkey").alias("o_orderkey"), F.col("b.active").alias("active"))


def ops_latest_per_owner(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return orders.withColumn("n", place).where("n = 1").select("o_custkey", "o_orderkey")


def src_site_index(spark, sf_dir):
    return site_index(captures(spark, sf_dir), "example.com", limit=100).select("page_seq", "timestamp", "url")


def src_index_fetch(spark, sf_dir):
    """The index's answers for all captures, recorded as pages with resume keys, one in three refused once, and read through the data source."""
    path = scratch(spark)
    record_index(captures(spark, sf_dir), path, rows_each=7, refused_every=3)
    return fetch_index(spark, path=path, buckets=8, retries=2, wait=0)


def src_urlkey_collapse(spark, sf_dir):
    return site_index(captures(spark, sf_dir), "example.net", collapse="urlkey").select("page_seq", "url")


def sel_density(spark, sf_dir):
    return selection.density_sample(captures(spark, sf_dir), "fast").select("page_seq", "timestamp")


def sel_picks_under_ceiling(spark, sf_dir):
    return selection.picks_under_ceiling(captures(spark, sf_dir), 100).select("page_seq", "timestamp")


def sel_scope(spark, sf_dir):
    return selection.in_scope(captures(spark, sf_dir), without_paths=("/",), without_words=("casino",), day_from="20120310", day_to="20190520").select("page_seq", "url")


def sel_estimate(spark, sf_dir):
    rows = captures(spark, sf_dir)
    return selection.scan_estimate(rows, selection.density_sample(rows, "light"))


def valued_findings(spark, sf_dir):
    return ranked_findings(spark, sf_dir).withColumn("value", folding.value_of())


def rep_axis_ticks(spark, sf_dir):
    return report.axis_ticks(findings(spark, sf_dir))


def rep_pivots(spark, sf_dir):
    return report.pivots(valued_findings(spark, sf_dir), ("titles", "links")).select("category", "value", "first_seen", "last_seen")


def rep_category_activity(spark, sf_dir):
    return report.category_activity(ranked_findings(spark, sf_dir), "links")


def rep_composed_activity(spark, sf_dir):
    chosen = ranked_findings(spark, sf_dir).where("category = 'titles' and rank <= 3").select("category", F.col("key").alias("value"))
    return report.composed_activity(valued_findings(spark, sf_dir), ("titles", "links"), chosen)


def rep_co_occurrence_block(spark, sf_dir):
    """What the page of the first title by rank shows besides it."""
    found = ranked_findings(spark, sf_dir)
    top = found.where("category = 'titles' and rank = 1").first()
    return report.co_occurrence(found, "titles", top.key if top else "")


def search_snippets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    best = search.bm25(docs, "doc_id", "text", "under the mit lic", 50)
    return docs.join(F.broadcast(best), docs["doc_id"] == best["doc"]).select("doc_id", search.snippet(F.col("text"), "under the mit lic").alias("snippet"))


def search_index_rows(spark, sf_dir):
    """The index rows of a scan whose pages are the documents."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_seq"), stamp_of(F.col("doc_id")).alias("timestamp"), F.concat(F.lit("https://acme.test/"), "doc_id").alias("url"), "text")
    return search.index_rows(pages, "s1").select("scan", "timestamp", "url", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def export_client_csv(spark, sf_dir):
    return sinks.client_csv(valued_findings(spark, sf_dir).withColumn("severity", F.lit("CONTEXT")))


def ops_outcomes(spark, sf_dir):
    return health.outcome_counts(table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("error")))


def ops_moving_average(spark, sf_dir):
    return health.moving_average(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("event_id", F.round("average", 6).alias("average"))


def ops_latency(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("host"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 100).alias("at"), (F.col("value") / 20).alias("seconds"))
    return health.latency_state(calls).select("event_id", "samples", F.round("median", 9).alias("median"), "state")


def ops_service_state(spark, sf_dir):
    """The events as calls of five hosts, errors being failures."""
    calls = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("host"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 100).alias("at"), (F.col("value") / 20).alias("seconds"), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("failed"))
    return health.service_state(calls, order=("at", "event_id")).select("event_id", "samples", F.round("median", 9).alias("median"), "state")


_NATIVE = ("analytics_trackers", "analytics_ids", "cloud_buckets", "adsense_ids", "job_boards", "auth_providers", "status_pages", "hosting", "cookie_consent", "github_repos", "emails", "html_comments", "directory_listings", "social_profiles", "api_keys", "connection_strings", "jwt_tokens", "bug_bounty_programs")
_PLAIN = (
    ext_all_categories, ext_url_subdomains, ext_titles_links, sel_preflight, sel_path_groups, sel_host_groups, sel_year_histogram, sel_day_density, sel_date_range, sel_exclude_keywords, sel_content_dedup, sel_month_collapse, sel_year_allocation, sel_evenly_by_year, sel_score_allocation, sel_full_selection,
    fold_findings, fold_page_ids, rep_summary, rep_presence, rep_change_feed, rep_lanes, rep_category_rail, rep_co_occurrence, rep_top_links, rep_highlights, merge_analytics, search_bm25, search_accent_fold, search_index, search_index_phrase, search_index_prefix, search_postings, search_postings_turns, snk_upsert_purge, export_csv_rows, export_json, export_markdown,
    src_site_index, src_index_fetch, src_urlkey_collapse, sel_density, sel_picks_under_ceiling, sel_scope, sel_estimate, rep_axis_ticks, rep_pivots, rep_category_activity, rep_composed_activity, rep_co_occurrence_block, search_snippets, search_index_rows, export_client_csv, ops_outcomes, ops_moving_average, ops_latency, ops_service_state,
    stream_running_counts, stream_windows, stream_sessions, stream_findings, stream_governor, sel_stats, rep_hosts_by_depth, ops_scan_history, ops_scan_reuse, ops_recent, ops_fair_queue, ops_latest_per_owner,
)


def queries() -> dict:
    return {f"ext_{c}": _ext(c) for c in _NATIVE} | {f"case_{c}": case_query(c) for c in CASES} | {f.__name__: f for f in _PLAIN}


def oracle_sql() -> dict[str, str]:
    caps, found = f"WITH {_CAPTURES}", f"WITH {_FINDINGS}"
    score = "CASE WHEN regexp_matches(path, '" + "|".join(selection.HIGH_VALUE) + "') THEN 3 WHEN path = '/' THEN 2 ELSE 1 END"
    selected = f"""{caps}, kept AS (SELECT *, substr(timestamp, 1, 4) AS year FROM caps QUALIFY row_number() OVER (PARTITION BY path, digest ORDER BY timestamp, url) = 1),
y AS (SELECT year, count(*) AS n FROM kept GROUP BY 1), {_YEARS}, p AS (SELECT kept.year AS g, path, count(*) AS n, {score} AS score, any_value(years.allocated) AS cap FROM kept JOIN years USING (year) GROUP BY 1, 2), {_DEALT},
r AS (SELECT *, row_number() OVER (PARTITION BY year, path ORDER BY timestamp, url) - 1 AS i, count(*) OVER (PARTITION BY year, path) AS k FROM kept)
SELECT page_seq, timestamp, url FROM r JOIN dealt ON dealt.g = r.year AND dealt.path = r.path WHERE (SELECT count(*) FROM kept) <= 100 OR allocated >= k OR (allocated = 1 AND i = 0) OR (allocated > 1 AND list_contains(list_transform(range(allocated), lambda j: round_even(j * ((k - 1)::DOUBLE / (allocated - 1)), 0)), i))"""
    scans = "s AS (SELECT o_orderkey AS url_id, o_custkey AS domain, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS made, o_orderdate + INTERVAL 1800 DAY > (SELECT max(o_orderdate) FROM orders) AS held FROM orders)"
    return _ext_sql() | _lookaround_sql() | {f"case_{c}": case_sql(c) for c in CASES} | {
        "sel_preflight": f"{caps}, s AS (SELECT count(*) AS captures, count(DISTINCT path) AS paths, count(DISTINCT (path, digest)) AS contents, min(substr(timestamp, 1, 4) || '-' || substr(timestamp, 5, 2)) AS first_month, max(substr(timestamp, 1, 4) || '-' || substr(timestamp, 5, 2)) AS last_month FROM caps) SELECT *, greatest(CASE WHEN paths <= 30 THEN least(contents, 100) WHEN paths <= 200 THEN least(3 * paths, 500) WHEN paths <= 1000 THEN least(floor(1.5 * paths), 1000) ELSE 1500 END, least(contents, 50))::BIGINT AS suggested_cap FROM s",
        "sel_path_groups": f'{caps} SELECT path, count(*) AS n, min(timestamp) AS "first", max(timestamp) AS "last", {score} AS score FROM caps GROUP BY path',
        "sel_host_groups": f"{caps} SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, count(*) AS n, count(DISTINCT url) AS urls FROM caps GROUP BY 1",
        "sel_year_histogram": f"{caps}, y AS (SELECT substr(timestamp, 1, 4)::INT AS year, count(*) AS n FROM caps GROUP BY 1), e AS (SELECT unnest(range(min(year), max(year) + 1)) AS year, max(n) AS top FROM y) SELECT e.year::INT AS year, coalesce(n, 0) AS n, greatest(2, round(100.0 * coalesce(n, 0) / top))::INT AS pct FROM e LEFT JOIN y ON e.year = y.year",
        "sel_day_density": f"{caps} SELECT substr(timestamp, 1, 8) AS day, count(*) AS n FROM caps GROUP BY 1",
        "sel_date_range": f"{caps} SELECT page_seq, timestamp, url FROM caps WHERE timestamp BETWEEN '20120301000000' AND '20181031235959'",
        "sel_exclude_keywords": f"{caps} SELECT page_seq, url FROM caps WHERE NOT contains(lower(url), 'casino') AND NOT contains(lower(url), '/fr/')",
        "sel_content_dedup": f"{caps} SELECT page_seq, timestamp, digest FROM caps QUALIFY row_number() OVER (PARTITION BY path, digest ORDER BY timestamp, url) = 1",
        "sel_month_collapse": f"{caps} SELECT page_seq, timestamp, url FROM caps QUALIFY row_number() OVER (PARTITION BY url, substr(timestamp, 1, 6) ORDER BY timestamp) = 1",
        "sel_year_allocation": f"""{caps}, y AS (SELECT substr(timestamp, 1, 4) AS year, count(*) AS n FROM caps GROUP BY 1),
g AS (SELECT *, greatest(0, least(least(n, 3), 100 - coalesce(sum(least(n, 3)) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS given FROM y),
i AS (SELECT *, (100 - sum(given) OVER ()) AS budget, n - given AS room FROM g), j AS (SELECT *, CASE WHEN sum(room) OVER () > 0 THEN budget * room::DOUBLE / sum(room) OVER () ELSE 0 END AS ideal FROM i),
k AS (SELECT *, least(room, floor(ideal)) AS base FROM j), l AS (SELECT *, budget - sum(base) OVER () AS spare, row_number() OVER (ORDER BY (given + base < n) DESC, ideal - floor(ideal) DESC, year DESC) AS place FROM k)
SELECT year, n, least(n, given + base + CASE WHEN given + base < n AND place <= spare THEN 1 ELSE 0 END)::BIGINT AS allocated FROM l""",
        "sel_evenly_by_year": f"""{caps}, r AS (SELECT page_seq, timestamp, substr(timestamp, 1, 4) AS year, row_number() OVER (PARTITION BY substr(timestamp, 1, 4) ORDER BY timestamp, url) - 1 AS i, count(*) OVER (PARTITION BY substr(timestamp, 1, 4)) AS k FROM caps)
SELECT page_seq, timestamp FROM r WHERE k <= 5 OR i IN (round_even(0 * (k - 1) / 4.0, 0), round_even(1 * (k - 1) / 4.0, 0), round_even(2 * (k - 1) / 4.0, 0), round_even(3 * (k - 1) / 4.0, 0), round_even(4 * (k - 1) / 4.0, 0))""",
        "sel_score_allocation": f"{caps}, p AS (SELECT 0 AS g, path, count(*) AS n, {score} AS score, 60 AS cap FROM caps GROUP BY path), {_DEALT} SELECT path, n, score, allocated FROM dealt",
        "sel_full_selection": selected,
        "sel_stats": f"""{caps}, k AS (SELECT count(DISTINCT (path, digest)) AS n FROM caps) SELECT count(*) AS total_snapshots_found, (SELECT count(*) FROM ({selected})) AS snapshots_selected, count(*) - (SELECT n FROM k) AS pages_deduped,
  min(substr(timestamp, 1, 4) || '-' || substr(timestamp, 5, 2)) AS date_first_seen, max(substr(timestamp, 1, 4) || '-' || substr(timestamp, 5, 2)) AS date_last_seen FROM caps""",
        "rep_hosts_by_depth": r"""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages), d AS (SELECT host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain FROM h WHERE host <> '')
SELECT host, domain, greatest(0, least(3, len(string_split(host, '.')) - len(string_split(domain, '.'))))::INT AS depth, row_number() OVER (ORDER BY array_to_string(list_reverse(string_split(host, '.')), '.'), domain) AS place FROM d""",
        "ops_scan_history": f"WITH {scans} SELECT url_id, domain, status FROM s WHERE held ORDER BY made DESC, url_id LIMIT 50",
        "ops_scan_reuse": f"""WITH {scans}, p AS (SELECT *, status = 'running' AS live FROM s WHERE status = 'running' OR (status = 'completed' AND held)),
a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY domain ORDER BY live DESC, CASE WHEN live THEN made END, made DESC, url_id) = 1)
SELECT c_custkey AS request_id, c_custkey AS domain, url_id, status, live FROM customer LEFT JOIN a ON a.domain = c_custkey""",
        "fold_findings": f"{found} SELECT category, key, first_seen, last_seen, occurrences, source_url FROM f",
        "fold_page_ids": f"{caps} SELECT 'https://web.archive.org/web/' || timestamp || '/' || url AS source_url, row_number() OVER (ORDER BY min(page_seq)) AS source_page_id FROM caps GROUP BY 1",
        "rep_summary": f"{found} SELECT count(*) AS findings, count(DISTINCT category) AS categories, count(*) FILTER (last_seen >= hi) AS live, count(*) FILTER (last_seen < hi) AS gone FROM f, b",
        "rep_presence": f"{found} SELECT category, last_seen >= hi AS live, count(*) AS n FROM f, b GROUP BY ALL",
        "rep_change_feed": f"{found} SELECT first_seen AS month, 'up' AS kind, category, key FROM f UNION ALL SELECT last_seen, 'down', category, key FROM f, b WHERE last_seen < hi",
        "rep_lanes": f"{found}, m AS (SELECT category, key, last_seen < hi AS disappeared, substr(first_seen, 1, 4)::INT * 12 + substr(first_seen, 6, 2)::INT AS a, substr(last_seen, 1, 4)::INT * 12 + substr(last_seen, 6, 2)::INT AS z, substr(lo, 1, 4)::INT * 12 + substr(lo, 6, 2)::INT AS l, substr(hi, 1, 4)::INT * 12 + substr(hi, 6, 2)::INT AS h FROM f, b) SELECT category, key, round(100.0::DOUBLE * (a - l) / greatest(h - l, 1), 6) AS left_pct, round(greatest(100.0::DOUBLE * (z - a) / greatest(h - l, 1), 1.5), 6) AS width_pct, disappeared FROM m",
        "rep_category_rail": f"{found} SELECT c.category, coalesce(n, 0) AS n FROM (VALUES ('titles'), ('links'), ('emails')) c(category) LEFT JOIN (SELECT category, count(*) AS n FROM f GROUP BY 1) x ON x.category = c.category",
        "rep_co_occurrence": f"{found} SELECT t.key AS title, count(*) AS links FROM f JOIN f t ON t.source_url = f.source_url AND t.category = 'titles' WHERE f.category = 'links' GROUP BY 1",
        "search_postings": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT conv_id, term, count(*) AS tf FROM (SELECT conv_id, unnest(regexp_extract_all(translate(lower(text), '" + search._ACCENTED + "', '" + search._PLAIN + "'), '[\\p{L}\\p{N}]+')) AS term FROM conversations) GROUP BY ALL) GROUP BY term",
        "search_postings_turns": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(regexp_extract_all(translate(lower(text), '" + search._ACCENTED + "', '" + search._PLAIN + "'), '[\\p{L}\\p{N}]+')) AS term FROM conversations) GROUP BY ALL) GROUP BY term",
        "merge_analytics": _merge_sql(),
        "rep_top_links": f"{found}, {_RANKED} SELECT category, key, occurrences, (row_number() OVER (PARTITION BY category ORDER BY occurrences DESC, first_hit, key))::INT AS place FROM ranked WHERE contains(lower(key), 'a') QUALIFY place <= 20",
        "export_markdown": f"{found}, {_RANKED} SELECT category, rank AS place, '- ' || key || ' (' || first_seen || ' to ' || last_seen || ', ' || occurrences || 'x)' AS line FROM ranked WHERE key <> ''",
        "export_json": f"{found}, {_RANKED} SELECT category, ((rank - 1) // 1000)::BIGINT AS part, '[' || array_to_string(list(to_json({{'key': key, 'first_seen': first_seen, 'last_seen': last_seen, 'occurrences': occurrences, 'attrs': {{'value': key}}, 'source_url': source_url}})::VARCHAR ORDER BY rank), ',') || ']' AS items FROM ranked GROUP BY ALL",
        "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM s GROUP BY user_id, no",
        "search_bm25": _bm25_sql(_MIT, 50),
        "search_index": _bm25_sql(_MIT, 50),
        "search_index_phrase": _bm25_sql(["len(list_filter(range(1, len(t)), lambda i: t[i] = 'under' AND t[i + 1] = 'the'))", "len(list_filter(range(1, len(t)), lambda i: t[i] = 'mit' AND starts_with(t[i + 1], 'lic')))"], 50),
        "search_index_prefix": _bm25_sql(["x = 'der'", "starts_with(x, 'keit')"], 20),
        "search_accent_fold": _bm25_sql(["starts_with(x, 'etre')"], 20),
        "export_csv_rows": f"{found} SELECT category, key AS value, first_seen, last_seen, occurrences, source_url AS source FROM f WHERE key <> ''",
        "src_site_index": f"{caps}, {_KEYED} SELECT page_seq, timestamp, url FROM (SELECT * FROM keyed WHERE host = 'example.com' OR ends_with(host, '.example.com') QUALIFY row_number() OVER (PARTITION BY url, substr(timestamp, 1, 6) ORDER BY timestamp, url) = 1) ORDER BY key, timestamp, url LIMIT 100",
        "stream_findings": " UNION ALL ".join(f"SELECT * FROM ({_ext_sql()[f'ext_{c}']})" for c in _STREAMED),
        "snk_upsert_purge": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 97 = 0 THEN 1.5::DOUBLE ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= '1994-01-01' UNION ALL SELECT -o_orderkey - 1, 'X', 1.5::DOUBLE, o_orderdate FROM orders WHERE o_orderkey % 97 = 0 AND o_orderdate >= '1994-01-01'",
        "src_index_fetch": "SELECT (2010 + page_id % 12)::VARCHAR || lpad((1 + (page_id * 7) % 12)::VARCHAR, 2, '0') || lpad((1 + page_id % 28)::VARCHAR, 2, '0') || '120000' AS timestamp, url, '200' AS status, 'text/html' AS mimetype, md5(html) AS digest FROM pages",
        "src_urlkey_collapse": f"{caps}, {_KEYED} SELECT page_seq, url FROM keyed WHERE host = 'example.net' OR ends_with(host, '.example.net') QUALIFY row_number() OVER (PARTITION BY key ORDER BY timestamp, url) = 1",
        "sel_density": f"{caps}, {_spaced('6', 'substr(timestamp, 1, 4)')} SELECT page_seq, timestamp FROM r WHERE k <= 6 OR list_contains(list_transform(range(6), lambda j: floor(j * ((k - 1)::DOUBLE / 5) + 0.5)), i)",
        "sel_picks_under_ceiling": f"{caps}, y AS (SELECT substr(timestamp, 1, 4) AS year, count(*) AS n FROM caps GROUP BY 1), {_YEARS}, {_spaced('allocated', 'year', 'caps JOIN years ON years.year = substr(timestamp, 1, 4)')} SELECT page_seq, timestamp FROM r WHERE (SELECT count(*) FROM caps) <= 100 OR allocated >= k OR (allocated = 1 AND i = 0) OR (allocated > 1 AND list_contains(list_transform(range(allocated), lambda j: round_even(j * ((k - 1)::DOUBLE / (allocated - 1)), 0)), i))",
        "sel_scope": f"{caps} SELECT page_seq, url FROM caps WHERE path <> '/' AND NOT contains(lower(url), 'casino') AND substr(timestamp, 1, 8) BETWEEN '20120310' AND '20190520'",
        "sel_estimate": f"{caps}, c AS (SELECT sum(least(k, 2)) AS n, sum(k) AS available FROM (SELECT count(*) AS k FROM caps GROUP BY substr(timestamp, 1, 4))) SELECT n::BIGINT AS n, floor(n * 0.36 + 15.5)::BIGINT AS seconds, CASE WHEN available > 5000 OR n >= 5000 THEN 'capped' WHEN n < 25 THEN 'thin' ELSE 'good' END AS level FROM c",
        "rep_axis_ticks": f"{found}, e AS (SELECT substr(lo, 1, 4)::INT AS a, substr(hi, 1, 4)::INT AS z FROM b), s AS (SELECT *, CASE WHEN greatest(z - a, 1) <= 4 THEN 1 ELSE ceil(greatest(z - a, 1) / 4.0)::INT END AS step FROM e) SELECT DISTINCT unnest(list_append(generate_series(a, z, step), z))::INT AS year FROM s",
        "rep_pivots": f"{found} SELECT category, key AS value, first_seen, last_seen FROM f",
        "rep_category_activity": f"{found}, {_RANKED}, m AS (SELECT key, rank, last_seen < hi AS faded, substr(first_seen, 1, 4)::INT * 12 + substr(first_seen, 6, 2)::INT AS a, substr(last_seen, 1, 4)::INT * 12 + substr(last_seen, 6, 2)::INT AS z FROM ranked, b WHERE category = 'links'), x AS (SELECT min(a) AS l, max(z) AS h FROM m) SELECT key, rank, round(100.0::DOUBLE * (a - l) / greatest(h - l, 1), 6) AS left_pct, round(greatest(100.0::DOUBLE * (z - a) / greatest(h - l, 1), 1.5), 6) AS width_pct, faded FROM m, x WHERE rank <= 24",
        "rep_composed_activity": f"{found}, {_RANKED} SELECT category AS label, min(first_seen) AS \"first\", max(last_seen) AS \"last\", false AS pivot FROM f GROUP BY category UNION ALL SELECT key, first_seen, last_seen, true FROM ranked WHERE category = 'titles' AND rank <= 3",
        "rep_co_occurrence_block": f"{found}, {_RANKED}, t AS (SELECT source_url FROM ranked WHERE category = 'titles' AND rank = 1), p AS (SELECT category, key, row_number() OVER (PARTITION BY category ORDER BY first_page, first_hit, key) AS place, count(*) OVER (PARTITION BY category) AS total FROM ranked WHERE source_url = (SELECT source_url FROM t) AND NOT (category = 'titles' AND rank = 1)) SELECT * FROM p WHERE place <= 8",
        "search_snippets": f"WITH best AS ({_bm25_sql(_MIT, 50)}), d AS (SELECT doc_id, regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}]+') AS ps FROM documents JOIN best ON doc = doc_id), h AS (SELECT *, list_transform(ps, lambda p: {_folded_sql(_word_sql('p'))} IN ('under', 'the', 'mit') OR starts_with({_folded_sql(_word_sql('p'))}, 'lic')) AS hits FROM d), c AS (SELECT *, list_transform(range(greatest(len(ps) - 12, 0) + 1), lambda s: len(list_filter(hits[s + 1:s + 12], lambda x: x))) AS n FROM h), w AS (SELECT *, list_position(n, list_max(n)) - 1 AS spot FROM c) SELECT doc_id, (CASE WHEN spot > 0 THEN ' … ' ELSE '' END) || regexp_replace(array_to_string(list_transform(range(spot + 1, least(spot + 12, len(ps)) + 1), lambda j: CASE WHEN hits[j] THEN regexp_replace(ps[j], '([\\p{{L}}\\p{{N}}]+)$', '<mark>\\1</mark>') ELSE ps[j] END), ''), '^\\s+', '') || (CASE WHEN spot + 12 < len(ps) THEN ' … ' ELSE '' END) AS snippet FROM w",
        "search_index_rows": "SELECT 's1' AS scan, (2010 + doc_id % 12)::VARCHAR || lpad((1 + (doc_id * 7) % 12)::VARCHAR, 2, '0') || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '120000' AS timestamp, 'https://acme.test/' || doc_id AS url, length(substr(text, 1, 40000)) AS chars, md5(substr(text, 1, 40000)) AS digest FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 600) WHERE text <> ''",
        "export_client_csv": f"{found}, {_RANKED}, q AS (SELECT *, CASE WHEN regexp_matches(key, '[\",\\n]') THEN '\"' || replace(key, '\"', '\"\"') || '\"' ELSE key END AS v, CASE WHEN regexp_matches(source_url, '[\",\\n]') THEN '\"' || replace(source_url, '\"', '\"\"') || '\"' ELSE source_url END AS u FROM ranked) SELECT 0::BIGINT AS place, 'category,value,severity,first_seen,last_seen,occurrences,type,provider,service,domain,source_url,source_page_id,md5,sha256,shodan' AS line UNION ALL SELECT row_number() OVER (ORDER BY category, rank), category || ',' || v || ',CONTEXT,' || first_seen || ',' || last_seen || ',' || occurrences || ',,,,,' || u || ',,,,' FROM q",
        "ops_outcomes": "SELECT CASE WHEN event_type <> 'view' THEN event_type ELSE 'ok' END AS outcome, count(*) AS n FROM events GROUP BY 1",
        "ops_moving_average": "SELECT event_id, round(list_reduce(list_prepend(180.0::DOUBLE, v), lambda s, x: 0.9::DOUBLE * s + (1 - 0.9::DOUBLE) * x), 6) AS average FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS v FROM events)",
        "ops_service_state": f"WITH c AS (SELECT event_id, user_id % 5 AS host, epoch_us(ts) / 1e6 / 100 AS spot, value / 20 AS seconds, coalesce(event_type = 'error', false) AS failed FROM events), w AS (SELECT *, list({{'spot': spot, 's': seconds}}) FILTER (NOT failed) OVER (PARTITION BY host ORDER BY spot, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, lag(failed) OVER p AND failed AND lag(spot) OVER p > spot - {health.FAIL_WINDOW} AS failing FROM c WINDOW p AS (PARTITION BY host ORDER BY spot, event_id)), m AS (SELECT event_id, failing, list_transform(list_filter(coalesce(l[-{health.SAMPLES}:], []), lambda x: x.spot > spot - {health.WINDOW}), lambda x: x.s) AS f FROM w), r AS (SELECT event_id, coalesce(failing, false) AS failing, len(f) AS samples, list_median(f) AS median FROM m) SELECT event_id, samples::INT AS samples, round(median, 9) AS median, CASE WHEN (failing OR (samples >= {health.LEAST_SAMPLES} AND median >= {health.SLOW})) AND median >= 2 * {health.SLOW} THEN 'very slow' WHEN failing OR (samples >= {health.LEAST_SAMPLES} AND median >= {health.SLOW}) THEN 'slow' ELSE 'ok' END AS state FROM r",
        "ops_latency": "WITH c AS (SELECT event_id, user_id % 5 AS host, epoch_us(ts) / 1e6 / 100 AS spot, value / 20 AS seconds FROM events), w AS (SELECT event_id, spot, list({'spot': spot, 's': seconds}) OVER (PARTITION BY host ORDER BY spot ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS l FROM c), m AS (SELECT event_id, list_transform(list_filter(l, lambda x: x.spot > spot - 300), lambda x: x.s) AS f FROM w), r AS (SELECT event_id, len(f) AS samples, list_median(f) AS median FROM m) SELECT event_id, samples::INT AS samples, round(median, 9) AS median, CASE WHEN samples >= 3 AND median >= 16 THEN 'very slow' WHEN samples >= 3 AND median >= 8 THEN 'slow' ELSE 'ok' END AS state FROM r",
        "stream_running_counts": "SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1",
        "stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL",
        "ops_recent": "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1",
        "ops_fair_queue": "WITH a AS (SELECT o_custkey, count(*) AS active FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), w AS (SELECT o.*, coalesce(active, 0) AS active FROM orders o LEFT JOIN a USING (o_custkey) WHERE o_orderstatus = 'P') SELECT o_orderpriority, o_orderkey, active FROM w QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY active, o_orderdate, o_orderkey) = 1",
        "ops_latest_per_owner": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    }
