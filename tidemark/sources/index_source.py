"""The capture index as a Spark data source: ``spark.read.format("capture_index")``.

An index answers a request with a page of rows and, while there are more, a last row
with the key that the next request names. Such a chain of pages is followed one by one,
so chains are what can be read side by side: one for each domain and year. Partitions are
planned over buckets of chains; rows are the answers as they came, which
:func:`tidemark.sources.captures.parse_index` takes apart in expressions.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.text import host_of
from tidemark.session import numbered
from tidemark.sources.captures import parse_index, url_key

#: Attempts after the first one, seconds before the second attempt (then doubled), seconds of a chain, rows of a chain at most.
RETRIES, WAIT, DEADLINE, MOST_ROWS = 3, 5.0, 270.0, 50_000
#: Fixed value: the fields asked for, in the order of an answer's rows.
FIELDS = "timestamp,original,statuscode,mimetype,digest"


class Refused(Exception):
    """An attempt without an answer."""


class RecordedIndex:
    """Answers that :func:`record_index` has written; each has as many refusals before it as were recorded."""

    def __init__(self, path: str, bucket: int) -> None:
        import pyarrow.dataset as ds
        import pyarrow.fs as fs

        files, inner = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        self.rows = ds.dataset(inner, filesystem=files, format="parquet", partitioning="hive").filter(ds.field("bucket") == bucket)
        self.tries: dict[tuple[str, str], int] = {}
        self.chain, self.answers = None, {}

    def chains(self) -> Iterator[str]:
        """The bucket's chains; a file holds whole chains, one after the other."""
        seen = None
        for batch in self.rows.to_batches(columns=["chain"]):
            for name in batch.column("chain").to_pylist():
                if name != seen:
                    seen = name
                    yield name

    def get(self, chain: str, key: str) -> str:
        if chain != self.chain:
            import pyarrow.compute as pc

            found = self.rows.filter(pc.field("chain") == chain).to_table(columns=["key", "payload", "refusals"]).to_pylist()
            self.chain, self.answers = chain, {r["key"]: r for r in found}
        tried = self.tries[chain, key] = self.tries.get((chain, key), 0) + 1
        answer = self.answers.get(key)
        if answer is None or tried <= answer["refusals"]:
            raise Refused(f"no answer for {chain} at {key!r}")
        return answer["payload"]


class HttpIndex:
    """A live index at ``base``; chains are given as ``domain`` or ``domain year``."""

    def __init__(self, base: str, chains: list[str], timeout: float = 120.0) -> None:
        self.base, self.names, self.timeout = base, chains, timeout

    def chains(self) -> Iterator[str]:
        yield from self.names

    def get(self, chain: str, key: str) -> str:
        domain, _, year = chain.partition(" ")
        asked = [("url", f"*.{domain}/*"), ("output", "json"), ("fl", FIELDS), ("filter", "statuscode:200"), ("filter", "mimetype:text/html"), ("collapse", "timestamp:6"), ("showResumeKey", "true")]
        asked += [("from", year), ("to", year)] if year else []
        asked += [("resumeKey", key)] if key else []
        try:
            with urllib.request.urlopen(f"{self.base}?{urllib.parse.urlencode(asked)}", timeout=self.timeout) as answer:
                return answer.read().decode("utf-8", "replace")
        except (urllib.error.URLError, TimeoutError) as failure:
            raise Refused(repr(failure)) from failure


def next_key(payload: str) -> tuple[str, int]:
    """(key that the next request names or '', rows) of an answer; a broken one raises ValueError."""
    rows = json.loads(payload)
    last = rows[-1] if rows else []
    return (last[0], len(rows) - 1) if len(last) == 1 and len(last[0]) > 20 else ("", len(rows))


@dataclass
class Bucket(InputPartition):
    bucket: int
    chains: tuple[str, ...] = ()


class IndexReader(DataSourceReader):
    """Follows the chains of each partition, with a budget of attempts, seconds and rows for a chain."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.retries, self.wait = int(options.get("retries", RETRIES)), float(options.get("wait", WAIT))
        self.deadline, self.most = float(options.get("deadline", DEADLINE)), int(options.get("mostrows", MOST_ROWS))
        self.key = options.get("resumekey", "")

    def partitions(self) -> list[Bucket]:
        n = int(self.options.get("buckets", 8))
        names = [x for x in self.options.get("chains", "").split(",") if x]
        return [Bucket(k, tuple(names[k::n])) for k in range(n)]

    def read(self, partition: Bucket) -> Iterator[tuple]:
        base = self.options.get("url")
        index = HttpIndex(base, list(partition.chains)) if base else RecordedIndex(self.options["path"], partition.bucket)
        for chain in index.chains():
            yield from self._follow(index, chain)

    def _follow(self, index, chain: str) -> Iterator[tuple]:
        key, page, rows, until = self.key, 0, 0, time.monotonic() + self.deadline
        while True:
            payload, following, count, attempts = self._page(index, chain, key, until)
            yield chain, page, payload, attempts
            page, rows = page + 1, rows + count
            if not following or rows >= self.most:
                return
            key = following

    def _page(self, index, chain: str, key: str, until: float) -> tuple[str, str, int, int]:
        """One page after as many attempts as it takes. A last answer that is broken is kept for salvage and ends the chain."""
        broken, reason = None, "out of time"
        for attempt in range(1 + self.retries):
            if attempt and time.monotonic() > until:
                break
            if attempt and self.wait:
                time.sleep(self.wait * 2 ** (attempt - 1))
            try:
                payload = index.get(chain, key)
                return payload, *next_key(payload), attempt + 1
            except Refused as failure:
                reason = str(failure)
            except ValueError:
                broken = payload
        if broken is not None:
            return broken, "", 0, 1 + self.retries
        raise RuntimeError(f"index unreachable after {1 + self.retries} attempts: {reason}")


class CaptureIndex(DataSource):
    """Options: ``path`` of recorded answers or ``url`` of a live index with ``chains``; ``buckets``, ``retries``, ``wait``, ``deadline``, ``mostRows``, ``resumeKey`` (where a single chain goes on)."""

    @classmethod
    def name(cls) -> str:
        return "capture_index"

    def schema(self) -> str:
        return "chain string, page int, payload string, attempts int"

    def reader(self, schema) -> IndexReader:
        return IndexReader(dict(self.options))


def record_index(captures: DataFrame, path: str, rows_each: int = 1000, buckets: int = 8, refused_every: int = 0) -> None:
    """Writes answers for ``captures(timestamp, url, status, mimetype, digest)`` as an index would give them, ``rows_each`` rows a page.

    Chains are (domain, year), ordered by URL key and time; places are found by ranges, so
    that no chain is sorted in one task. Every ``refused_every``-th page is refused once.
    """
    order = ["chain", "url_key", "timestamp", "url", "digest"]
    domain = F.regexp_extract(host_of(F.coalesce(F.col("url"), F.lit(""))), r"([^.]+\.[^.]+)$", 1)
    rows = captures.select(F.concat_ws(" ", domain, F.substring("timestamp", 1, 4)).alias("chain"), F.coalesce(url_key(F.col("url")), F.lit("")).alias("url_key"), "timestamp", "url", "status", "mimetype", "digest")
    placed = numbered(rows, "_place", *order)
    first = placed.groupBy("chain").agg(F.min("_place").alias("_first"), F.max("_place").alias("_last"))
    placed = placed.join(first, "chain").withColumn("page", F.floor((F.col("_place") - F.col("_first")) / rows_each)).withColumn("pages", F.floor((F.col("_last") - F.col("_first")) / rows_each) + 1)
    row = F.array("timestamp", "url", "status", "mimetype", "digest")
    answers = placed.groupBy("chain", "page", "pages").agg(F.array_sort(F.collect_list(F.struct("_place", row.alias("r")))).alias("rows"))
    key = F.concat(F.lit("after page "), F.lpad(F.col("page").cast("string"), 12, "0"))
    then = F.concat(F.lit("after page "), F.lpad((F.col("page") + 1).cast("string"), 12, "0"))
    body = F.transform("rows", lambda x: x["r"])
    payload = F.to_json(F.when(F.col("page") + 1 < F.col("pages"), F.concat(body, F.array(F.array(then)))).otherwise(body))
    refusals = (F.col("page") % refused_every == 0).cast("int") if refused_every else F.lit(0)
    out = answers.select("chain", F.when(F.col("page") > 0, key).otherwise("").alias("key"), payload.alias("payload"), refusals.alias("refusals"), F.pmod(F.xxhash64("chain"), F.lit(buckets)).cast("int").alias("bucket"))
    out.repartition("bucket", "chain").sortWithinPartitions("bucket", "chain", "key").write.mode("overwrite").partitionBy("bucket").parquet(path)


def fetch_index(spark: SparkSession, **options) -> DataFrame:
    """(timestamp, url, status, mimetype, digest) of all chains of an index."""
    spark.dataSource.register(CaptureIndex)
    return parse_index(spark.read.format("capture_index").options(**options).load())
