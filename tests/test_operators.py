import random

from pyspark.sql import functions as F

from tidemark.operators import fold as folding
from tidemark.operators import native_extract, report, search, selection
from tidemark.plans.catalogue import all_pages
from tidemark.plans.fixtures import fixture_pages
from tidemark.sources import captures, sinks
from tidemark.streaming import live

HITS = "page_seq long, hit_seq long, category string, key string, month string, source_url string, attrs map<string,string>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_seq long, timestamp string, url string, html string, domain string")


def test_fold_equals_a_plain_fold(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(9), i, rng.choice("ab"), rng.choice("xyz"), f"20{rng.randrange(10, 20)}-0{rng.randrange(1, 9)}", f"u{i}", {"v": str(i)}) for i in range(200)]
    want = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        e = want.setdefault((r[2], r[3]), [r[4], r[4], 0, r[6], r[5]])
        e[0], e[1], e[2] = min(e[0], r[4]), max(e[1], r[4]), e[2] + 1
    got = {(r.category, r.key): [r.first_seen, r.last_seen, r.occurrences, r.attrs, r.source_url] for r in folding.fold(spark.createDataFrame(rows, HITS)).collect()}
    assert got == want


def test_script_only_captcha_counts_once_and_only_before_a_key(spark):
    def hit(page, key):
        return (page, 0, "captcha_providers", key, "2020-01", "u", {"provider": key.split(":")[0]})

    rows = [hit(1, "a:_script_only"), hit(2, "a:_script_only"), hit(3, "a:k"), hit(1, "b:k"), hit(2, "b:_script_only"), (1, 0, "emails", "x", "2020-01", "u", {})]
    got = sorted((r.key, r.page_seq) for r in folding.settle_captchas(spark.createDataFrame(rows, HITS)).collect())
    assert got == [("a:_script_only", 1), ("a:k", 3), ("b:k", 1), ("x", 1)]


def test_findings_of_pages(spark):
    rows = [
        (1, "20200101000000", "https://a.acme.test/x", '<a href="https://twitter.com/acme">t</a><a href="https://reddit.com/r1">r</a>', "acme.test"),
        (2, "20210101000000", "https://acme.test/y", None, "acme.test"),
        (3, "20220101000000", "https://acme.test/z", '<a href="https://twitter.com/acme">t</a>', "acme.test"),
    ]
    got = {(r.category, r.key): r for r in folding.findings_of(pages(spark, rows), ["social_profiles", "outgoing_links", "subdomains"]).collect()}
    assert set(got) == {("social_profiles", "twitter:acme"), ("social_profiles", "reddit:r1"), ("subdomains", "a.acme.test")}
    top = got["social_profiles", "twitter:acme"]
    assert (top.first_seen, top.last_seen, top.occurrences, top.source_page_id, top.rank) == ("2020-01", "2022-01", 2, 1, 1)
    assert got["subdomains", "a.acme.test"].source_url is None
    assert folding.findings_of(pages(spark, rows), []).count() == 0


def test_every_category_runs_without_errors(spark):
    hits = folding.all_hits(all_pages(spark, "/root/testdata/sf0.001"))
    assert hits.where("category = '_errors'").count() == 0
    names = {r.category for r in hits.select("category").distinct().collect()}
    assert names <= set(folding.ALL_CATEGORIES)
    assert len(folding.ALL_CATEGORIES) == 43


def test_native_attributes(spark):
    df = fixture_pages(spark).select(F.col("page_id").alias("page_seq"), F.lit("20200102000000").alias("timestamp"), "url", "html")
    got = {(r.category, r.key): r.attrs for r in native_extract.native_hits(df).collect()}
    assert got["api_keys", "pk_live_abcdefghijklmnopqrstuvwx"]["tier"] == "public"
    assert got["connection_strings", "postgres://bob:****@db.acme.test:5432/app"]["has_credentials"] == "true"
    assert ("social_profiles", "twitter:fake") not in got and ("social_profiles", "x:home") not in got
    assert got["social_profiles", "linkedin:acme"]["url"] == "https://linkedin.com/company/acme"
    jwt = next(v for k, v in got.items() if k[0] == "jwt_tokens")
    assert jwt["sensitive_claims"] == "email" and jwt["token"].endswith("...")
    assert ("bug_bounty_programs", "hackerone:acme") in got and ("bug_bounty_programs", "bugcrowd:faq") not in got


def test_merge_analytics(spark):
    rows = [(1, 0, "analytics_trackers", "GTM:GTM-ABC123", "2020-01", "u", {"type": "GTM", "id": "GTM-ABC123"}), (2, 0, "analytics_ids", "gtm:GTM-ABC123", "2021-01", "u", {"platform": "gtm", "id_value": "gtm-abc123", "pivot_url": "p"}), (2, 1, "analytics_ids", "ua:UA-1", "2021-01", "v", {"platform": "ua", "id_value": "UA-1", "pivot_url": "q"})]
    got = {r.attrs["id"]: r for r in folding.merge_analytics(folding.fold(spark.createDataFrame(rows, HITS))).collect()}
    assert set(got) == {"GTM-ABC123", "UA-1"}
    assert (got["GTM-ABC123"].last_seen, got["GTM-ABC123"].attrs["pivot_url"]) == ("2021-01", "p")


def test_dealing_by_score(spark):
    rng = random.Random(5)
    groups = {"a": ([("/", 5, 2), ("/admin", 5, 3)], 10), "b": ([("/", 5, 2), ("/admin", 5, 3), ("/x", 9, 1)], 2)}
    for g in range(200):
        paths = [(f"/{i}", rng.randrange(1, 30), rng.choice((1, 2, 3))) for i in range(rng.randrange(1, 8))]
        groups[f"g{g}"] = paths, rng.randrange(1, sum(n for _, n, _ in paths) + 3)
    rows = [(g, p, n, score, cap) for g, (paths, cap) in groups.items() for p, n, score in paths]
    got = {}
    for r in selection.dealt_by_score(spark.createDataFrame(rows, "_by string, _path string, n long, score int, cap long")).collect():
        got.setdefault(r["_by"], {})[r["_path"]] = r.allocated
    assert got["a"] == {"/": 5, "/admin": 5} and got["b"] == {"/": 1, "/admin": 1, "/x": 0}
    for g, (paths, cap) in groups.items():
        # what a full path cannot take is offered to each other path once
        assert sum(got[g].values()) <= min(cap, sum(n for _, n, _ in paths)) and all(0 <= got[g][p] <= n for p, n, _ in paths)


def test_selection_fills_the_cap(spark):
    rows = [(i, f"{2010 + i % 7}{1 + i % 12:02d}{1 + i % 28:02d}000000", f"https://a.test/{'contact' if i % 3 else 'p'}{i % 5}", "200", "text/html", None if i % 50 == 0 else f"d{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_seq long, timestamp string, url string, status string, mimetype string, digest string")
    assert selection.select_captures(df, selection.ScanConfig(cap=60)).count() == 60
    assert selection.select_captures(df, selection.ScanConfig()).count() == 400
    assert selection.select_captures(df.limit(0), selection.ScanConfig(cap=5)).count() == 0
    same = df.withColumn("digest", F.lit("one")).withColumn("url", F.lit("https://a.test/"))
    assert selection.first_of_content(same).count() == 1
    assert selection.first_of_content(same.withColumn("digest", F.lit(None).cast("string"))).count() == 400


def test_postings_cover_every_turn(spark):
    rows = [(1, 0, "one word"), (1, 1, "Word word"), (2, 0, None), (2, 1, "late")]
    found = search.postings(spark.createDataFrame(rows, "conv_id long, turn int, text string"), F.struct("conv_id", "turn"), "text")
    got = {(tuple(r.doc), r.term): r.tf for r in found.collect()}
    assert got == {((1, 0), "one"): 1, ((1, 0), "word"): 1, ((1, 1), "word"): 2, ((2, 1), "late"): 1}


def test_search(spark):
    df = spark.createDataFrame([(1, "La cybersécurité avancée, écrire à admin@x.com"), (2, "careers page: caring people"), (3, None), (4, "com x admin")], "id int, t string")
    ask = lambda q: [r.doc for r in search.bm25(df, "id", "t", q).collect()]
    assert ask("careers") == [2] and ask("cybersecurite") == [1] and ask("care") == [2] and ask("admin@x.com") == [1] and ask("  ") == []
    assert all(r.score < 0 for r in search.bm25(df, "id", "t", "careers").collect())


def test_index_payloads(spark):
    head = '[["timestamp","original","statuscode","mimetype","digest"],["20200101000000","http://a/","200","text/html","D"],["short"]'
    rows = [(head + ',["com,a)/ 20200101000000 resume"]]',), (head + ',["20210101000000","http://b/","200","text/html","E"],["2022',), ("[]",), (None,), ("nonsense",)]
    df = spark.createDataFrame(rows, "payload string")
    assert sorted(r.url for r in captures.parse_index(df).collect()) == ["http://a/", "http://a/", "http://b/"]
    keys = df.select(captures.resume_key(captures.salvaged(F.col("payload")))).collect()
    assert keys[0][0].startswith("com,a)") and keys[1][0] is None
    headers = spark.createDataFrame([({"X-Archive-Orig-Server": "nginx", "date": "x"},)], "h map<string,string>")
    assert headers.select(captures.original_headers(F.col("h"))).first()[0] == {"server": "nginx"}


def test_sinks(spark):
    old = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "id string, n int, public boolean")
    new = spark.createDataFrame([("b", 5, True), ("c", 6, False)], "id string, n int, public boolean")
    assert sorted(map(tuple, sinks.upsert(old, new, "id", ["public"]).collect())) == [("a", 1, True), ("b", 5, False), ("c", 6, False)]
    assert sorted(map(tuple, sinks.live_scans(old, new, "id").collect())) == [("a", 1, True), ("b", 5, True), ("c", 6, False)]


def test_report(spark):
    rows = [("a", "k1", "2010-01", "2020-01", 3), ("a", "k2", "2012-01", "2015-01", 1)]
    df = spark.createDataFrame(rows, "category string, key string, first_seen string, last_seen string, occurrences long")
    assert tuple(report.summary(df).first()) == (2, 1, 1, 1)
    assert [(r.kind, r.key) for r in report.change_feed(df, 2).collect()] == [("down", "k2"), ("up", "k2")]
    assert report.summary(df.limit(0)).first().findings == 0


def test_governor():
    state = {}
    for t in range(5):
        state = live.governor_step(state, float(t), "fail")
    assert state["soft_until"] == 4.0 + 180
    assert live.governor_step(state, 5.0, "ok")["soft_until"] == 0
    state = live.governor_step({}, 0.0, "refused")
    assert state["rate"] == 60.0 and state["hard_until"] == 0
    state = live.governor_step(state, 1.0, "refused")
    assert state["hard_until"] == 121.0 and state["streak"] == 1
    assert live.governor_step({"rate": 70.0, "clean": 0.0}, 95.0, "ok")["rate"] == 80.0


def test_stream_equals_batch(spark, tmp_path):
    src = spark.createDataFrame([(f"h{i % 3}", float(i), "refused" if i % 4 == 0 else "ok") for i in range(40)], "host string, at double, outcome string")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    query = live.governor_stream(stream).writeStream.format("memory").queryName("gov").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("gov").collect())) == sorted(map(tuple, live.governor(src).collect()))
