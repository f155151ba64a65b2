"""Tables written in place."""

import os

import pytest
from oracle import spark_rows
from pyspark.sql import functions as F

from tidemark.sources.store import KeyedTable

SCHEMA = "url_id string, title string, published boolean, expires_at string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


@pytest.fixture
def table(spark, tmp_path):
    own = KeyedTable(spark, str(tmp_path / "scans"), "url_id", SCHEMA, buckets=8)
    assert own.rows().count() == 0
    own.upsert(spark.createDataFrame([(f"u{i}", f"t{i}", i % 2 == 0, None if i % 3 else f"2020-01-{1 + i:02d}") for i in range(20)], SCHEMA))
    return own


def test_upsert_touches_its_buckets_only(spark, table):
    before = files(table.path)
    new = spark.createDataFrame([("u4", "new", False, None), ("u99", "a", None, None), ("u99", "b", None, None)], SCHEMA)
    table.upsert(new, preserve=("published",))
    assert table.get("u4").collect() == [("u4", "new", True, None)] and table.get("u99").collect() == [("u99", "b", None, None)]
    assert table.rows().count() == 21
    after = files(table.path)
    touched = {f"bucket={b}" for b in table._touched(new)}
    assert {f for f in before if f.split("/")[-2] not in touched} == {f for f in after if f.split("/")[-2] not in touched} and before != after
    again = files(table.path)
    table.upsert(new.limit(0))
    assert files(table.path) == again


def test_a_failed_write_can_be_repeated(spark, table):
    before = spark_rows(table.rows())
    bad = spark.createDataFrame([("u1", "x", True, None)], SCHEMA).withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad)
    assert spark_rows(table.rows()) == before
    table.upsert(spark.createDataFrame([("u1", "x", True, None)], SCHEMA))
    table.upsert(spark.createDataFrame([("u1", "x", True, None)], SCHEMA))
    assert table.get("u1").first().title == "x" and table.rows().count() == 20


def test_deletion_expiry_orphans_and_replacement(spark, table):
    table.delete(F.col("expires_at") <= "2020-01-10")
    assert {r.url_id for r in table.rows().collect()} == {f"u{i}" for i in range(20) if i % 3 or i > 9}
    table.keep_only(spark.createDataFrame([("u1",), ("u2",), ("u5",)], "url_id string"))
    assert {r.url_id for r in table.rows().collect()} == {"u1", "u2", "u5"}
    table.replace(spark.createDataFrame([("u1", "p1", None, None), ("u1", "p2", None, None)], SCHEMA))
    assert sorted(r.title for r in table.rows().collect()) == ["p1", "p2", "t2", "t5"]
    table.delete(F.lit(True))
    assert table.rows().count() == 0
