import datetime

from pyspark.sql import functions as F

from tidemark.operators import history, report, selection


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_reuse_prefers_the_oldest_live_scan(spark):
    rows = [
        (1, "a", "completed", day(1), day(90)), (2, "a", "running", day(5), day(90)), (3, "a", "queued", day(4), day(90)), (4, "a", "queued", day(4), day(90)),
        (5, "b", "completed", day(1), day(90)), (6, "b", "completed", day(2), day(90)), (7, "b", "failed", day(9), day(90)), (8, "b", "completed", day(3), day(20)),
        (9, "c", "completed", day(1), day(5)), (10, None, "completed", day(1), day(90)), (12, "e", "completed", day(1), day(90)), (11, "e", "completed", day(1), day(90)),
    ]
    scans = spark.createDataFrame(rows, "url_id long, domain string, status string, created_at timestamp, expires_at timestamp")
    asked = spark.createDataFrame([(k, d) for k, d in enumerate(["a", "b", "c", None, "d", "e", "a"])], "request_id int, domain string")
    got = {r.request_id: (r.url_id, r.status, r.live) for r in history.reused(asked, scans, F.lit(day(30))).collect()}
    none = (None, None, None)
    assert got == {0: (3, "queued", True), 1: (6, "completed", False), 2: none, 3: none, 4: none, 5: (11, "completed", False), 6: (3, "queued", True)}
    assert history.reused(asked, scans.limit(0), F.lit(day(30))).where("url_id is null").count() == 7
    assert [r.url_id for r in history.recent_scans(scans, F.lit(day(30)), 0).collect()] == [7]
    assert history.recent_scans(scans, F.lit(day(30)), 1000).count() == 10


def test_hosts_by_depth(spark):
    rows = [(h, "x.org") for h in ("b.x.org", "a.b.x.org", "x.org", "a.x.org", "a.x.org", "p.q.r.s.t.x.org", None)]
    got = report.hosts_by_depth(spark.createDataFrame(rows, "host string, domain string")).orderBy("place").collect()
    assert [(r.host, r.depth) for r in got] == [("x.org", 0), ("a.x.org", 1), ("b.x.org", 1), ("a.b.x.org", 2), ("p.q.r.s.t.x.org", 3)]


def test_selection_stats(spark):
    rows = [("20200101000000", "http://a.com/x", "text/html", "d1"), ("20210301000000", "http://a.com/x", "text/html", "d1"), ("20220101000000", "http://a.com/y", "text/html", None), ("20230101000000", "http://a.com/z", "image/png", "d2")]
    captures = spark.createDataFrame(rows, "timestamp string, url string, mimetype string, digest string")
    assert tuple(selection.selection_stats(captures, selection.ScanConfig(cap=10)).first()) == (4, 2, 1, "2020-01", "2022-01")
    assert tuple(selection.selection_stats(captures.limit(0), selection.ScanConfig()).first()) == (0, 0, 0, None, None)
