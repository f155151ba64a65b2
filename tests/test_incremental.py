"""Findings from streams against findings of all pages at once."""

import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from tidemark.operators import fold
from tidemark.plans.catalogue import all_pages
from tidemark.streaming import incremental

SF = "/root/testdata/sf0.001"
SCRIPT = '<script src="https://www.google.com/recaptcha/api.js"></script>'
KEYED = '<div class="g-recaptcha" data-sitekey="6LeIxAcTAAAAAJcZVRqyHh71UMIEGNQ_MXjiZKhI"></div>' + SCRIPT
CATEGORIES = ["captcha_providers", "emails", "analytics_trackers", "social_profiles", "outgoing_links", "html_titles", "subdomains"]


def as_rows(df):
    """Maps as sorted pairs, so that rows compare."""
    flat = df.withColumn("attrs", F.array_sort(F.map_entries("attrs")))
    return rows_of(flat.columns, [tuple(r) for r in flat.collect()])


@pytest.fixture(scope="module")
def pages(spark):
    own = all_pages(spark, SF).where("page_seq % 4 = 0")
    columns = "page_seq long, timestamp string, url string, html string, domain string"
    extra = [(900 + i, f"2015010{1 + i}120000", f"https://a.acme.test/{i}", html, "acme.test") for i, html in enumerate([None, SCRIPT, SCRIPT + SCRIPT, KEYED, SCRIPT, ""])]
    return own.unionByName(spark.createDataFrame(extra, columns))


@pytest.mark.parametrize("deal", ["2 - page_seq % 3"])
def test_batches_in_any_order_give_the_findings_of_all_pages(spark, pages, tmp_path, deal):
    table = incremental.FindingsTable(spark, str(tmp_path), CATEGORIES)
    parts = pages.withColumn("part", F.expr(f"cast({deal} as int)"))
    numbers = sorted(r.part for r in parts.select("part").distinct().collect())
    for n in [*reversed(numbers), numbers[0]]:  # the last one is a replay
        table.take(parts.where(F.col("part") == n).drop("part"), n)
    assert as_rows(table.findings()) == as_rows(fold.findings_of(pages, CATEGORIES))
    assert [r.pages for r in table.progress().orderBy("batch").collect()] == [parts.where(F.col("part") == n).count() for n in numbers]


def test_script_only_captchas_are_taken_back(spark, tmp_path):
    columns = "page_seq long, timestamp string, url string, html string, domain string"
    page = lambda k, html: spark.createDataFrame([(k, "20150101120000", f"https://a.acme.test/{k}", html, "acme.test")], columns)
    table = incremental.FindingsTable(spark, str(tmp_path), ["captcha_providers"])
    table.take(page(5, SCRIPT), 0)
    assert [r.key.partition(":")[2] for r in table.folded().collect()] == ["_script_only"]
    table.take(page(3, KEYED), 1)
    keys = [r.key for r in table.folded().collect()]
    assert len(keys) == 1 and not keys[0].endswith("_script_only")
    table.take(page(1, SCRIPT), 2)
    assert table.folded().count() == 2


def test_a_stream_of_files(spark, pages, tmp_path):
    source = str(tmp_path / "in")
    pages.repartition(3).write.parquet(source)
    table = incremental.FindingsTable(spark, str(tmp_path / "out"), CATEGORIES)
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = table.follow(stream, str(tmp_path / "checkpoint"))
    assert query.awaitTermination(120)
    assert table.progress().count() == 3 and table.progress().agg(F.max("pages_so_far")).first()[0] == pages.count()
    assert as_rows(table.findings()) == as_rows(fold.findings_of(pages, CATEGORIES))


def test_captcha_verdicts_of_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("captcha_providers", "a:_script_only", 7), ("captcha_providers", "b:k1", 2), ("emails", "x:y", 1)], [("captcha_providers", "a:k", 9), ("captcha_providers", "b:_script_only", 1), ("captcha_providers", "c:k", 4)], [("captcha_providers", "a:k2", 6), ("captcha_providers", "c:_script_only", 4)]
    source, schema = str(tmp_path / "in"), "category string, key string, page_seq long"
    stream = spark.readStream.schema(schema).parquet(source + "*")
    seen = []
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{source}{k}")
        query = incremental.captcha_verdicts(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append({r.provider: (r.script_page, r.keyed_page, r.script_stays) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    seen = [x for x in seen if x]
    assert seen == [{"a": (7, None, True), "b": (None, 2, False)}, {"a": (7, 9, True), "b": (1, 2, True), "c": (None, 4, False)}, {"a": (7, 6, False), "c": (4, 4, False)}]


