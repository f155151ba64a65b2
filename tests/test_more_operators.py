"""Selection bounds, exports, search index, icons, pacing."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.checksums import icon_hash
from tidemark.operators import fold, health, report, search, selection
from tidemark.session import numbered, running
from tidemark.sources import captures, sinks
from tidemark.streaming import live


def test_ceiling_and_picks(spark):
    config = selection.ScanConfig
    assert selection.under_ceiling(config()).cap == 3000 and selection.under_ceiling(config(cap=5000)).cap == 3000
    assert selection.under_ceiling(config(cap=20)).cap == 20 and selection.under_ceiling(config(), 0).cap is None
    rows = [(f"{2010 + i % 3}0101{i:06d}", f"https://a.acme.test/{i}") for i in range(60)]
    picks = spark.createDataFrame(rows, "timestamp string, url string")
    assert selection.picks_under_ceiling(picks, 12).count() == 12 and selection.picks_under_ceiling(picks, 60).count() == 60
    assert selection.checked_picks(picks, "Acme.test").count() == 60
    for url in ("https://notacme.test/", "https://acme.test.evil.test/", None):
        with pytest.raises(ValueError, match="not on"):
            selection.checked_picks(picks.unionByName(spark.createDataFrame([("20200101000000", url)], picks.schema)), "acme.test")


def test_density(spark, monkeypatch):
    rows = [(f"{year}01{i:02d}000000", f"https://a.test/{year}/{i}") for year in (2011, 2012, 2013) for i in range(1, 10)]
    found = spark.createDataFrame(rows, "timestamp string, url string")
    monkeypatch.setitem(selection.DENSITIES, "one", 1)
    assert sorted(r.timestamp[6:8] for r in selection.density_sample(found, "one").collect()) == ["05"] * 3  # the middle
    assert sorted(r.timestamp[6:8] for r in selection.density_sample(found, "light").collect()) == ["01"] * 3 + ["09"] * 3
    assert selection.density_sample(found, "max", ceiling=10).count() == 10
    one_year = found.where("timestamp < '2012'")
    assert sorted(r.timestamp[6:8] for r in selection.density_sample(one_year, "max", ceiling=4).collect()) == ["01", "02", "03", "04"]
    assert selection.in_scope(found, hosts=("b.test",)).count() == 0 and selection.in_scope(found, hosts=("a.test",), day_from="20120102", day_to="20120104").count() == 3
    assert tuple(selection.scan_estimate(found, found.limit(10)).first()) == (10, 19, "thin")


def test_numbering_by_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert sorted((r.x, r.n) for r in numbered(df.repartition(5), "n", F.col("x")).collect()) == [(i, i + 1) for i in range(1000)]
    assert numbered(df.limit(0), "n", F.col("x")).count() == 0


def test_exports(spark):
    scans = spark.createDataFrame([("u1", "acme.test", None, '{"pages":2}', '{"emails":["</script>"]}', None), ("u2", "b.test", "2024", None, None, "2020-01-01")], "url_id string, domain string, completed_at string, meta string, results string, expires_at string")
    out = {r.url_id: r.json for r in sinks.json_export(scans, "tidemark", "2025").collect()}
    assert out["u1"] == '{"tool":"tidemark","domain":"acme.test","url_id":"u1","exported_at":"2025","meta":{"pages":2},"results":{"emails":["</script>"]}}'
    assert out["u2"].endswith('"completed_at":"2024","meta":null,"results":{}}')
    html = {r.url_id: r.html for r in sinks.html_pages(sinks.json_export(scans, "t", "2025"), "<head></head><body></body>", "DATA").collect()}
    assert html["u1"].startswith("<head><script>window.DATA = {") and '"<\\/script>"' in html["u1"] and html["u1"].endswith("</head><body></body>")
    index = spark.createDataFrame([("u1", "t"), ("u2", "t"), ("u3", "t")], "scan string, text string")
    kept, rows = sinks.without_expired(scans, index, "2024-01-01")
    assert [r.url_id for r in kept.collect()] == ["u1"] and [r.scan for r in rows.collect()] == ["u1"]
    kept, rows = sinks.without_scan(scans, index, "u1")
    assert [r.url_id for r in kept.collect()] == ["u2"] and rows.count() == 2


def test_client_csv(spark):
    df = spark.createDataFrame([("emails", 'a"b,c', "PIVOT", "2020-01", "2021-01", 3, {"type": "x\ny", "md5": "m"}, "s", 1)], "category string, value string, severity string, first_seen string, last_seen string, occurrences long, attrs map<string,string>, source_url string, rank int")
    lines = [r.line for r in sinks.client_csv(df).orderBy("place").collect()]
    assert lines[0].split(",") == list(sinks.CLIENT_COLUMNS)
    assert lines[1] == 'emails,"a""b,c",PIVOT,2020-01,2021-01,3,"x\ny",,,,s,,m,,'


def test_search_index(spark):
    text = "un deux trois quatre cinq six sept huit neuf dix onze douze Écrire à admin@x.com, puis la cybersécurité avancée et la suite de tout ce texte encore"
    pages = spark.createDataFrame([(1, "2020", "https://a.test/1", text), (2, "2021", "https://a.test/2", "careers page"), (3, "2021", "https://a.test/3", ""), (4, "2021", "https://a.test/4", "x" * 50_000)], "page_seq long, timestamp string, url string, text string")
    index = search.reindex(search.index_rows(pages, "old").unionByName(search.index_rows(pages, "s")), pages.where("page_seq < 3"), "s")
    assert index.where("scan = 's'").count() == 2 and index.where("scan = 'old'").selectExpr("max(length(text))").first()[0] == 40_000
    got = search.search_scan(index, "s", "admin@x.com cyber").collect()
    assert [r.url for r in got] == ["https://a.test/1"]
    assert "<mark>admin</mark>@<mark>x</mark>.<mark>com</mark>" in got[0].snippet and "<mark>cybersécurité</mark>" in got[0].snippet
    assert got[0].snippet.startswith(" … ") and got[0].snippet.endswith(" … ")
    assert search.search_scan(index, "other", "careers").count() == 0 and search.search_scan(index, "s", " ").count() == 0
    assert [r.snippet for r in search.search_scan(index, "s", "CAR").collect()] == ["<mark>careers</mark> page"]


def test_icons(spark):
    body = bytes(range(200))
    icons = [("favicons", f"k{i}", f"20{10 + i}-01", {"url": f"https://a.test/{i}.ico"}) for i in range(20)] + [("favicons", "d", "2040-01", {"url": "data:x"}), ("emails", "e", "2040-01", {})]
    found = spark.createDataFrame(icons, "category string, key string, first_seen string, attrs map<string,string>")
    blobs = spark.createDataFrame([(f"https://a.test/{i}.ico", bytearray(body if i != 19 else b"tiny")) for i in range(20)], "url string, content binary")
    got = {r.key: r for r in health.hashed_favicons(found, blobs).collect()}
    assert len(got) == 21 and got["k18"].md5 == hashlib.md5(body).hexdigest() and got["k18"].shodan == icon_hash(body) and got["k18"].sha256 == hashlib.sha256(body).hexdigest()
    assert got["k19"].md5 is None and got["k4"].md5 is not None and got["k3"].md5 is None and got["d"].md5 is None
    strip = found.withColumns({"rank": F.lit(1), "last_seen": F.lit("2041-01"), "source_url": F.lit("https://web.archive.org/web/2020/https://a.test/"), "attrs": F.create_map(F.lit("md5"), F.lit("0123456789"))})
    one = report.favicon_strip(strip).first()
    assert (one.image, one.hash) == ("https://web.archive.org/web/2020im_/https://a.test/", "01234567")


def test_chips(spark):
    rows = [("technologies", "x", {"version": "1.2", "type": "t"}), ("subdomains", "dev.acme.com", {}), ("subdomains", "www.acme.com", {"type": ""}), ("emails", "a@dev.test", {})]
    got = spark.createDataFrame(rows, "category string, value string, attrs map<string,string>").select(report.chip().alias("c")).collect()
    assert [r.c for r in got] == ["1.2", "dev", "", ""]


def test_outcomes_and_pacing(spark):
    pages = spark.createDataFrame([("x", None), ("y", ""), (None, "blocked"), (None, "http_404")], "html string, error string")
    assert {r.outcome: r.n for r in health.outcome_counts(pages).collect()} == {"ok": 2, "blocked": 1, "http_404": 1}
    assert tuple(health.scan_totals(pages).first()) == (2, 2, 1)
    asked = spark.createDataFrame([("h", 0.0, 60.0)] * 8 + [("g", 5.0, 60.0)], "host string, at double, rate double")
    granted = sorted(r.granted for r in live.pacing(asked).where("host = 'h'").collect())
    assert granted == [0.0] * 6 + [1.0, 2.0]


def test_page_ids_and_ranks(spark):
    hits = spark.createDataFrame([(p, 0, "emails", f"k{p % 4}", "2020-01", f"s{p}", {"value": "v"}) for p in range(50)], "page_seq long, hit_seq long, category string, key string, month string, source_url string, attrs map<string,string>")
    got = sorted((r.key, r.rank) for r in fold.ranked(fold.fold(hits)).collect())
    assert got == [("k0", 1), ("k1", 2), ("k2", 3), ("k3", 4)]


def test_downloads(spark):
    selected = spark.createDataFrame([("1", f"u{i}") for i in range(8)], "timestamp string, url string")
    answers = [("1", "u0", 200, bytearray("é".encode()), None), ("1", "u1", 404, None, None), ("1", "u2", 410, None, None), ("1", "u3", 503, None, None), ("1", "u4", 502, None, None), ("1", "u5", None, None, "conn"), ("1", "u6", 200, bytearray(b"a\xffb"), None)]
    got = {r.url: (r.html, r.error) for r in captures.downloads(selected, spark.createDataFrame(answers, "timestamp string, url string, status int, body binary, failure string")).collect()}
    assert got == {"u0": ("é", None), "u1": (None, "http_404"), "u2": (None, "http_4xx"), "u3": (None, "http_503"), "u4": (None, "http_5xx"), "u5": (None, "conn"), "u6": ("a\ufffdb", None), "u7": (None, "exhausted")}


def test_index_cache_and_size(spark):
    cache = spark.createDataFrame([("a.test", 1000.0, "x"), ("a.test", 90_000.0, "y"), ("b.test", 90_000.0, "z")], "domain string, cached_at double, row string")
    assert [r.row for r in captures.cached_index(cache, "a.test", 100_000.0).collect()] == ["y"]
    assert spark.range(1).select(captures.size_estimate(F.lit(4))).first()[0] == 12_000
    rows = [("20200101", "https://www.A.test/x?q=1#top", "200", "text/html"), ("20200102", "https://a.test", "200", "text/html"), ("20200103", "https://nota.test/", "200", "text/html"), ("20200104", "https://a.test/p", "404", "text/html")]
    index = captures.site_index(spark.createDataFrame(rows, "timestamp string, url string, status string, mimetype string"), "a.test", limit=5, collapse="urlkey")
    assert sorted(r.timestamp for r in index.collect()) == ["20200101", "20200102"]
    assert spark.range(1).select(captures.url_key(F.lit("https://www.A.test/x?q=1#top"))).first()[0] == "test,a,www)/x?q=1"


def test_running_sums_by_ranges(spark):
    rng = random.Random(5)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i * 7919 % 1009, rng.randrange(9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, x int, v int").repartition(5)
    got = {(r.g, r.x): (r.place, r.total) for r in running(df, ["g"], [F.desc("x")], place=F.lit(1), total=F.col("v")).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        total = 0
        for k, (_, x, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])):
            total += v
            want[g, x] = (k + 1, total)
    assert got == want
    assert running(df.limit(0), ["g"], [F.col("x")], place=F.lit(1)).count() == 0
