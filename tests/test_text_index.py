"""The positional index against the scan that needs none."""

import pytest
from oracle import spark_rows

from tidemark.operators import search, text_index

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(None, "under the mit license"), (7, None), (8, ""), (9, "under the mit license"), (9, "under the mit license"), (10, "Été mit-Licence, mit LICENCE")]
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return texts.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return text_index.write_index(docs, "doc_id", "text", str(tmp_path_factory.mktemp("index")), block_docs=16)


@pytest.mark.parametrize(("query", "limit"), [("under the mit lic", 50), ("th", 3), ("der keit", 50), ("under-the mit-lic", 3), ("mit-lic mit-lic", 50), ("zzz", 50), ("", 50), ("the", 3), ("été", 50)])
def test_search_equals_the_scan(index, docs, query, limit):
    assert spark_rows(index.search(query, limit)) == spark_rows(search.bm25(docs, "doc_id", "text", query, limit))


def test_only_the_terms_folders_are_read(index):
    rows = index.postings(search.parse_query("under the mit lic"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [lead" in plan and "PushedFilters: [Or(In(term" in plan
    assert {r.term[0] for r in rows.select("term").distinct().collect()} == {"u", "t", "m", "l"}


def test_bounds_hold(index):
    """No document of a block scores beyond the block's bounds, and no block has more documents of a term than its postings."""
    rows = index.postings([(["the"], False)])
    for r in rows.collect():
        assert r.n == len(r.doc) == len(r.row) == len(r.len) and r.max_tf == max(map(len, r.pos)) and r.min_len == min(r.len)


def test_index_of_nothing(spark, tmp_path):
    empty = text_index.write_index(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", str(tmp_path))
    assert empty.search("the").count() == 0
