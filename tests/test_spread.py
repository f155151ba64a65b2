"""Heavy work on pages is dealt over tasks whose number follows the scanned partitions."""

import os

from tidemark.plans import catalogue
from tidemark.session import PIECES, spread

SF = "/root/testdata/sf0.001"


def test_each_scanned_partition_is_dealt_over_pieces(spark):
    cores = spark.sparkContext.defaultParallelism
    large = spark.range(1000).repartition(3 * cores)
    dealt = spread(large, PIECES)
    assert dealt.rdd.getNumPartitions() == PIECES * 3 * cores and dealt.count() == 1000
    assert spread(large) is large and spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores


def test_the_streams_files_follow_the_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "scratch", lambda _: str(tmp_path))
    assert catalogue.stream_findings(spark, SF).count() > 0
    files = [f for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")]
    batches = [f for f in os.listdir(tmp_path / "out" / "progress") if f.startswith("batch=")]
    assert len(files) > 4 and len(batches) == 2
