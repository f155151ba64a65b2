"""Text categories as native expressions: one array of hits per page, exploded once.

A category is a column of ``array<struct<key, attrs>>`` over a page row with
``html`` (archive artefacts removed), ``raw_html`` and ``url``. Building only the
requested categories prunes the plan, and no row leaves the JVM. A pattern is tried
only on pages that hold one of the words it needs (``rules.WORDS_OF``). Words are
looked for in bytes: ``{text}_bytes`` and, in lower case for patterns that ignore case,
``{text}_low``; most of them in ``short``, the page without its prose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import mask_password, month_of, path_of, template, without_artefacts

HIT = "struct<key:string,attrs:map<string,string>>"
_NONE = f"array<{HIT}>"


def _all(pattern: str, group: int = 0, text: str = "html") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _may(pattern: str, text: str = "html") -> Column:
    """Whether the text holds a word without which the pattern finds nothing."""
    low = pattern.startswith(("(?i)", "(?is)"))  # such patterns fold ASCII letters only, and these have one lower case

    def holds(word: str) -> str:
        place = "short" if text == "html" and not rules.in_prose(word) else text
        return f"contains({place}_{'low' if low else 'bytes'}, X'{rules.rare_part(word).encode().hex()}')"

    return F.expr(" OR ".join(map(holds, rules.WORDS_OF[pattern])))  # as text, since a column for each word takes long to build


def _if(may: Column, hits: Column) -> Column:
    return F.when(may, hits.cast(_NONE)).otherwise(F.array().cast(_NONE))


def _hit(key: Column, **attrs: Column) -> Column:
    pairs = [x for name, value in attrs.items() for x in (F.lit(name), value.cast("string"))]
    return F.struct(key.alias("key"), F.create_map(*pairs).alias("attrs"))


def _join(parts: list[Column]) -> Column:
    return F.concat(*[p.cast(_NONE) for p in parts]) if parts else F.array().cast(_NONE)


def emails() -> Column:
    """Plain addresses, once a page."""
    found = F.array_distinct(F.transform(_all(rules.EMAIL), F.lower))

    def kept(e: Column) -> Column:
        local, domain = F.substring_index(e, "@", 1), F.get(F.split(e, "@"), F.lit(1))
        bad = local.rlike("^u00[0-9a-f]{2}") | domain.isin(*rules.EMAIL_PLACEHOLDER_DOMAINS) | domain.rlike(r"^\d+\.\d+")
        for word in rules.EMAIL_EXCLUDE:
            bad |= local.contains(word)
        for end in rules.IMAGE_EXTENSIONS + rules.ASSET_EXTENSIONS:
            bad |= e.endswith(end)
        return ~bad

    return _if(_may(rules.EMAIL), F.transform(F.filter(found, kept), lambda e: _hit(e, value=e)))


def analytics_trackers() -> Column:
    def part(kind: str, pattern: str, group: int) -> Column:
        body = lambda t: F.regexp_replace(F.regexp_replace(t, "^[^-]*-", ""), "-", "")
        kept = F.filter(_all(pattern, group), lambda t: ~t.isin(*rules.ID_DENYLIST) & ~body(t).rlike("^[Xx]+$"))
        return _if(_may(pattern), F.transform(kept, lambda t: _hit(F.concat(F.lit(f"{kind}:"), t), type=F.lit(kind), id=t)))

    return _join([part(*rule) for rule in rules.TRACKERS])


def analytics_ids() -> Column:
    def part(platform: str, pattern: str, group: int) -> Column:
        kept = F.filter(_all(pattern, group), lambda t: ~t.isin(*rules.ID_DENYLIST) & (t != ""))
        return _if(_may(pattern), F.transform(kept, lambda t: _hit(F.concat(F.lit(f"{platform}:"), t), platform=F.lit(platform), id_value=t, pivot_url=template(rules.ANALYTICS_PIVOTS[platform], t))))

    return _join([part(*rule) for rule in rules.ANALYTICS])


def social_profiles() -> Column:
    def part(platform: str, pattern: str) -> Column:
        found = F.transform(F.arrays_zip(_all(pattern, 1).alias("h"), _all(pattern, 0).alias("m")), lambda z: F.struct(z["h"].alias("h"), z["m"].alias("m")))
        denied = rules.SOCIAL_EXCLUDE + rules.SOCIAL_RESERVED.get(platform, ())

        def kept(z: Column) -> Column:
            ok = (F.length(z["h"]) >= 2) & ~F.lower(z["h"]).isin(*denied)
            return ok & ~z["h"].rlike(rules.LINKEDIN_ANONYMOUS) if platform == "linkedin" else ok

        def url(z: Column) -> Column:
            if platform != "linkedin":
                return template(rules.SOCIAL_URLS[platform], z["h"])
            return F.concat(F.lit("https://linkedin.com/"), F.when(z["m"].contains("/company/"), "company/").otherwise("in/"), z["h"])

        return _if(_may(pattern), F.transform(F.filter(found, kept), lambda z: _hit(F.concat(F.lit(f"{platform}:"), F.lower(z["h"])), platform=F.lit(platform), handle=z["h"], url=url(z))))

    return _join([part(*rule) for rule in rules.SOCIAL])


def cloud_buckets() -> Column:
    return _join([_if(_may(p), F.transform(_all(p), lambda m: _hit(F.lower(m), value=F.lower(m)))) for p in rules.CLOUD_BUCKETS])


def api_keys() -> Column:
    """Every key type but the one that needs its surroundings (see ``page_extract``)."""

    def part(kind: str, pattern: str) -> Column:
        def tier(k: Column) -> Column:
            if kind == "Stripe":
                return F.when(k.startswith("pk_"), "public").otherwise("secret")
            return F.lit("public" if kind in rules.PUBLIC_KEY_TYPES else "secret")

        may = F.col("html").rlike(rules.API_KEY_SHAPES[kind]) if kind in rules.API_KEY_SHAPES else _may(pattern)
        return _if(may, F.transform(_all(pattern), lambda k: _hit(k, type=F.lit(kind), value=k, tier=tier(k))))

    return _join([part(*rule) for rule in rules.API_KEYS if rule[0] != "Twilio"])


def _tenants(table, reserved, pivots, names: tuple[str, str], missing: str = "") -> Column:
    """Tenants of several platforms; the first group that matched is the slug."""

    def part(platform: str, pattern: str) -> Column:
        groups = pattern.count("([")
        zipped = F.arrays_zip(*[_all(pattern, g).alias(f"g{g}") for g in range(groups + 1)])

        def slug(z: Column) -> Column:
            tries = [F.when(z[f"g{g}"] != "", z[f"g{g}"]) for g in range(1, groups + 1)]
            return F.lower(F.coalesce(*tries, F.lit(missing)))

        found = F.transform(zipped, slug)
        kept = F.filter(found, lambda s: (F.lit(missing != "") & (s == missing)) | ((F.length(s) >= 2) & ~s.isin(*reserved)))
        shown = lambda s: F.when(s == missing, "").otherwise(s) if missing else s
        return _if(_may(pattern), F.transform(kept, lambda s: _hit(F.concat(F.lit(f"{platform}:"), s), **{names[0]: F.lit(platform), names[1]: shown(s), "pivot_url": template(pivots[platform], s)})))

    return _join([part(*rule) for rule in table])


def job_boards() -> Column:
    return _tenants(rules.JOB_BOARDS, rules.JOB_BOARD_RESERVED, rules.JOB_BOARD_PIVOTS, ("platform", "slug"))


def auth_providers() -> Column:
    return _tenants(rules.AUTH_PROVIDERS, rules.AUTH_RESERVED, rules.AUTH_PIVOTS, ("platform", "tenant"), "_")


def bug_bounty_programs() -> Column:
    return _tenants(rules.BUG_BOUNTIES, rules.BUG_BOUNTY_RESERVED, rules.BUG_BOUNTY_PIVOTS, ("platform", "handle"))


def status_pages() -> Column:
    hosted = _tenants(rules.STATUS_PAGES, rules.STATUS_PAGE_RESERVED, rules.STATUS_PAGE_PIVOTS, ("provider", "slug"))
    own = F.transform(_all(rules.STATUS_CUSTOM, 1), lambda h: F.regexp_replace(F.lower(h), r"\.+$", ""))
    custom = F.transform(own, lambda h: _hit(F.concat(F.lit("custom-domain:"), h), provider=F.lit("custom-domain"), slug=h, pivot_url=template(rules.STATUS_PAGE_PIVOTS["custom-domain"], h)))
    return _join([hosted, _if(_may(rules.STATUS_CUSTOM), custom)])


def adsense_ids() -> Column:
    def part(kind: str, pattern: str, group: int) -> Column:
        return _if(_may(pattern), F.transform(F.array_distinct(_all(pattern, group)), lambda v: _hit(F.concat(F.lit(f"{kind}:"), v), type=F.lit(kind), id=v)))

    return _join([part(*rule) for rule in rules.ADSENSE])


def _present(pattern: str, hit: Column, text: str = "html") -> Column:
    return _if(_may(pattern, text) & F.col(text).rlike(pattern), F.array(hit))


def cookie_consent() -> Column:
    parts = []
    for platform, pattern in rules.COOKIE_CONSENT:
        account = F.regexp_extract("html", rules.COOKIE_ACCOUNTS[platform], 1) if platform in rules.COOKIE_ACCOUNTS else F.lit("")
        key = F.when(account == "", platform).otherwise(F.concat(F.lit(f"{platform}:"), account))
        pivot = F.lit(rules.COOKIE_PIVOTS[platform])
        if platform in rules.COOKIE_ACCOUNT_PIVOTS:
            pivot = F.when(account == "", pivot).otherwise(template(rules.COOKIE_ACCOUNT_PIVOTS[platform], account))
        parts.append(_present(pattern, _hit(key, platform=F.lit(platform), account_id=account, pivot_url=pivot)))
    return _join(parts)


def hosting() -> Column:
    """Text signals, then response headers; the first signal of a provider counts."""
    text = [_present(pattern, _hit(F.lit(name), provider=F.lit(name), signal=F.lit(signal))) for name, signal, pattern in rules.HOSTING]
    of_text = {name: pattern for name, _, pattern in rules.HOSTING}
    seen: dict[str, list[Column]] = {}
    headers = []
    for header, pattern, name in rules.HEADER_HOSTING:
        value = F.coalesce(F.try_element_at("response_headers", F.lit(header)), F.lit(""))
        here = value.rlike(pattern) & (value != "")
        before = _may(of_text[name]) & F.col("html").rlike(of_text[name]) if name in of_text else F.lit(False)
        for other in seen.get(name, []):
            before |= other
        signal = f"header:{header}"
        headers.append(F.when(here & ~before, F.array(_hit(F.lit(name), provider=F.lit(name), signal=F.lit(signal)))).otherwise(F.array().cast(_NONE)))
        seen.setdefault(name, []).append(here)
    return _join(text + headers)


def github_repos() -> Column:
    def part(pattern: str, of_pages: bool) -> Column:
        zipped = F.arrays_zip(_all(pattern, 1).alias("o"), _all(pattern, 2).alias("r"), _all(pattern, 0).alias("u"))

        def parsed(z: Column) -> Column:
            repo = F.when(z["r"] == "", F.concat(z["o"], F.lit(".github.io"))).otherwise(z["r"]) if of_pages else z["r"]
            return F.struct(z["o"].alias("o"), F.regexp_replace(repo, r"\.git$", "").alias("r"), z["u"].alias("u"))

        def kept(z: Column) -> Column:
            return (z["r"] != "") & ~F.lower(z["o"]).isin(*rules.GITHUB_RESERVED_OWNERS) & ~F.lower(z["r"]).isin(*rules.GITHUB_RESERVED_REPOS)

        found = F.filter(F.transform(zipped, parsed), kept)
        return _if(_may(pattern), F.transform(found, lambda z: _hit(F.lower(F.concat_ws("/", z["o"], z["r"])), owner=z["o"], repo=z["r"], raw_url=z["u"], pivot_url=F.concat(F.lit("https://github.com/"), z["o"], F.lit("/"), z["r"]))))

    *urls, pages = rules.GITHUB_URLS
    return _join([*(part(p, False) for p in urls), part(pages, True)])


def html_comments() -> Column:
    found = F.transform(_all(rules.COMMENT, 1), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))

    def kept(c: Column) -> Column:
        low = F.lower(c)
        bad = low.contains("wayback")
        for start in rules.COMMENT_EXCLUDE:
            bad |= low.startswith(start)
        for noise in rules.COMMENT_NOISE:
            bad |= low.contains(noise)
        return (F.length(c) >= 10) & (F.length(c) <= 500) & ~bad

    return _if(_may(rules.COMMENT), F.transform(F.filter(found, kept), lambda c: _hit(F.lower(F.substring(c, 1, 80)), comment=F.substring(c, 1, 300))))


def directory_listings() -> Column:
    """One a page at most; sees the page as it was stored."""
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(rules.LISTINGS):
        kind = F.when(_may(pattern, "raw_html") & F.col("raw_html").rlike(pattern), name).otherwise(kind)
    path = F.when(path_of(F.col("url")) == "", "/").otherwise(path_of(F.col("url")))
    return F.when(kind.isNotNull(), F.array(_hit(path, path=path, server_type=kind, url=F.col("url")))).otherwise(F.array().cast(_NONE))


def connection_strings() -> Column:
    found = F.array_distinct(F.transform(_all(rules.CONNECTION), lambda m: F.regexp_replace(m, r"[.,;:'\")\]}>]+$", "")))
    authority = lambda m: F.regexp_extract(m, r"://([^/?#]*)", 1)
    user = lambda m: F.when(authority(m).contains("@"), F.regexp_extract(authority(m), r"^(.*)@", 1)).otherwise("")
    host = lambda m: F.lower(F.regexp_replace(F.regexp_replace(authority(m), r"^.*@", ""), r":[^:]*$", ""))
    kept = F.filter(found, lambda m: ~(host(m).isin("localhost", "127.0.0.1") & user(m).isin("", ":")))
    return _if(_may(rules.CONNECTION), F.transform(kept, lambda m: _hit(mask_password(m), type=F.lower(F.substring_index(m, "://", 1)), value=mask_password(m), has_credentials=~user(m).isin("", ":"))))


def jwt_tokens() -> Column:
    """Signed tokens of the URL, then of the stored page, once each; header and payload must be JSON objects."""

    def decoded(token: Column, part: int) -> Column:
        raw = F.translate(F.get(F.split(token, r"\."), F.lit(part)), "-_", "+/")
        padded = F.rpad(raw, (F.ceil(F.length(raw) / 4) * 4).cast("int"), "=")
        return F.try_to_binary(padded, F.lit("base64")).cast("string")

    found = F.array_distinct(F.concat(_all(rules.JWT, 0, "url"), _all(rules.JWT, 0, "raw_html")))
    in_url = _all(rules.JWT, 0, "url")

    def kept(t: Column) -> Column:
        alg = F.get_json_object(decoded(t, 0), "$.alg")
        payload = F.trim(decoded(t, 1))
        return alg.isin(*rules.JWT_ALGORITHMS) & payload.startswith("{") & F.json_object_keys(payload).isNotNull()

    def sensitive(t: Column) -> Column:
        keys = F.array_intersect(F.json_object_keys(F.trim(decoded(t, 1))), F.array(*map(F.lit, rules.JWT_SENSITIVE)))
        return F.array_join(F.array_sort(keys), ",")

    shown = lambda t: F.when(F.length(t) > 50, F.concat(F.substring(t, 1, 50), F.lit("..."))).otherwise(t)
    may = _may(rules.JWT, "url") | _may(rules.JWT, "raw_html")
    return _if(may, F.transform(F.filter(found, kept), lambda t: _hit(t, token=shown(t), claims=F.trim(decoded(t, 1)), sensitive_claims=sensitive(t), source=F.when(F.array_contains(in_url, t), "url").otherwise("html"))))


CATEGORIES: dict[str, Callable[[], Column]] = {
    f.__name__: f
    for f in (emails, analytics_trackers, social_profiles, cloud_buckets, api_keys, html_comments, jwt_tokens, directory_listings, adsense_ids, connection_strings, hosting, analytics_ids, cookie_consent, github_repos, bug_bounty_programs, status_pages, job_boards, auth_providers)
}


def prepared(pages: DataFrame) -> DataFrame:
    """Pages as the categories expect them: (page_seq, timestamp, month, url, source_url, html, raw_html, response_headers).

    Missing optional columns become nulls; a null ``html`` (failed download) stays in
    the table, its categories find nothing.
    """
    has = set(pages.columns)
    stamp = F.col("timestamp").cast("string")
    default = F.concat(F.lit("https://web.archive.org/web/"), stamp, F.lit("/"), F.col("url"))
    source = F.coalesce(F.col("source_url"), default) if "source_url" in has else default
    headers = F.col("response_headers") if "response_headers" in has else F.lit(None)
    domain = F.col("domain") if "domain" in has else F.lit(None)
    return pages.select(
        F.col("page_seq").cast("long").alias("page_seq"),
        stamp.alias("timestamp"),
        month_of(stamp).alias("month"),
        F.col("url").cast("string").alias("url"),
        source.alias("source_url"),
        domain.cast("string").alias("domain"),
        without_artefacts(F.col("html").cast("string")).alias("html"),
        F.col("html").cast("string").alias("raw_html"),
        headers.cast("map<string,string>").alias("response_headers"),
    )


def native_hits(pages: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """(page_seq, hit_seq, category, key, month, source_url, attrs) of the native categories."""
    wanted = [c for c in CATEGORIES if categories is None or c in categories]
    rows = prepared(pages).where("raw_html is not null")
    rows = rows.withColumn("short", F.regexp_replace("html", rules.PROSE, ""))
    texts = {k: F.col(k) for k in ("html", "short", "raw_html", "url")}
    rows = rows.withColumns({f"{k}_bytes": c.cast("binary") for k, c in texts.items()} | {f"{k}_low": F.lower(c).cast("binary") for k, c in texts.items()})
    if not wanted:
        wanted_hits = F.array().cast("array<struct<category:string,hits:" + _NONE + ">>")
    else:
        wanted_hits = F.array(*[F.struct(F.lit(c).alias("category"), CATEGORIES[c]().cast(_NONE).alias("hits")) for c in wanted])
    each = rows.select("page_seq", "month", "source_url", F.explode(wanted_hits).alias("c"))
    each = each.select("page_seq", "month", "source_url", "c.category", F.posexplode("c.hits").alias("hit_seq", "h"))
    return each.select("page_seq", F.col("hit_seq").cast("long").alias("hit_seq"), "category", F.col("h.key").alias("key"), "month", "source_url", F.col("h.attrs").alias("attrs"))
