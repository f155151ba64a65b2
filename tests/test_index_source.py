"""The index data source: pages, resume keys, refusals, broken answers."""

import http.server
import json
import threading

import pytest
from oracle import spark_rows
from pyspark.sql import functions as F

from tidemark.sources import index_source
from tidemark.sources.captures import parse_index


@pytest.fixture(scope="module")
def captures(spark):
    rows = [(f"20{10 + i % 3}0101{i:06d}", f"https://{'www.' if i % 2 else ''}site{i % 4}.test/{i % 9}", "200", "text/html", f"d{i}") for i in range(200)]
    rows += [rows[0], ("20110101000000", None, "200", "text/html", None)]
    return spark.createDataFrame(rows, "timestamp string, url string, status string, mimetype string, digest string").repartition(5)


@pytest.mark.parametrize(("each", "refused"), [(1, 0), (7, 2), (1000, 1)])
def test_all_pages_are_fetched(spark, captures, tmp_path, each, refused):
    index_source.record_index(captures, str(tmp_path), rows_each=each, buckets=3, refused_every=refused)
    got = index_source.fetch_index(spark, path=str(tmp_path), buckets=3, retries=1, wait=0)
    assert spark_rows(got) == spark_rows(captures)
    raw = spark.read.format("capture_index").options(path=f"file://{tmp_path}", buckets=3, retries=1, wait=0).load()
    assert raw.rdd.getNumPartitions() == 3
    assert raw.agg(F.max("attempts")).first()[0] == (2 if refused else 1)
    assert all(len(json.loads(r.payload)) <= each + 1 for r in raw.collect())


def test_a_chain_goes_on_at_its_key_and_ends_at_its_budget(spark, captures, tmp_path):
    one = captures.where("url like '%site1.test/%' and timestamp like '2011%'")
    index_source.record_index(one, str(tmp_path), rows_each=4, buckets=1)
    pages = spark.read.format("capture_index").options(path=str(tmp_path), buckets=1, wait=0).load().orderBy("page").collect()
    key, _ = index_source.next_key(pages[1].payload)
    rest = spark.read.format("capture_index").options(path=str(tmp_path), buckets=1, wait=0, resumeKey=key).load().orderBy("page").collect()
    assert [r.payload for r in rest] == [r.payload for r in pages[2:]]
    assert index_source.fetch_index(spark, path=str(tmp_path), buckets=1, wait=0, mostRows=5).count() == 8


def test_a_lost_page_fails_the_read(spark, captures, tmp_path):
    index_source.record_index(captures, str(tmp_path), rows_each=5, buckets=2, refused_every=1)
    with pytest.raises(Exception, match="index unreachable after 1 attempts"):
        index_source.fetch_index(spark, path=str(tmp_path), buckets=2, retries=0, wait=0).count()


class Answers(http.server.BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        Answers.asked.append(self.path)
        key = "a resume key of the next page"
        if len(Answers.asked) == 1:
            self.send_error(429)
            return
        if "resumeKey" not in self.path:
            body = json.dumps([["timestamp", "original", "statuscode", "mimetype", "digest"], ["20100101000000", "https://a.test/", "200", "text/html", "x"], [key]])
        else:  # cut off in its last row
            body = json.dumps([["20110101000000", "https://a.test/b", "200", "text/html", "y"], ["20120101000000", "https://a.te"]])[:-9]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


def test_live_index_with_a_refusal_and_a_broken_page(spark):
    Answers.asked.clear()
    server = http.server.HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(index_source.CaptureIndex)
        read = spark.read.format("capture_index").options(url=f"http://127.0.0.1:{server.server_port}/", chains="a.test 2010", buckets=1, retries=1, wait=0).load()
        got = parse_index(read).collect()
    finally:
        server.shutdown()
    assert [(r.timestamp, r.url) for r in got] == [("20100101000000", "https://a.test/"), ("20110101000000", "https://a.test/b")]
    assert "from=2010" in Answers.asked[0] and "statuscode%3A200" in Answers.asked[0]
