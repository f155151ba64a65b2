"""The index is written where its words met: postings are not dealt again."""

import os

from oracle import spark_rows

from tidemark.operators import search, text_index

SF = "/root/testdata/sf0.001"


def test_tasks_follow_the_text_and_write_few_folders(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(text_index, "TASK_TEXT", 1 << 16)
    index = text_index.write_index(docs, "doc_id", "text", str(tmp_path), block_docs=8)
    folders = [f for f in os.listdir(tmp_path / "postings") if f.startswith("lead=")]
    assert len(folders) <= text_index.LEADS
    tasks = {name.split("-")[1] for f in folders for name in os.listdir(tmp_path / "postings" / f) if name.endswith(".parquet")}
    assert len(tasks) > 1
    for query in ("the", "under-the mit-lic", "der keit"):
        assert spark_rows(index.search(query)) == spark_rows(search.bm25(docs, "doc_id", "text", query))
