"""Findings kept up to date from a stream of pages.

Each micro-batch is extracted and folded by itself, and its partial findings are written
under its number: a batch that is replayed writes the same folder again, so nothing counts
twice, and pages may come in any order. Partials merge as the fold does, so the findings
are those of :func:`tidemark.operators.fold.findings_of` over all pages that have come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators.fold import finished, fold, raw_hits
from tidemark.operators.native_extract import prepared
from tidemark.session import discard, materialise, numbered

SCRIPT = ":_script_only"
_HIT = "struct<page_seq: bigint, hit_seq: bigint>"
PARTIALS = f"category string, key string, first_seen string, last_seen string, occurrences bigint, attrs map<string, string>, source_url string, first_hit {_HIT}, batch bigint"


def _is_script() -> F.Column:
    return (F.col("category") == "captcha_providers") & F.col("key").endswith(SCRIPT)


def partial_findings(hits: DataFrame) -> DataFrame:
    """The fold of one batch. Of a captcha provider's script-only hits those of its first page in the batch count: only the first page of all can stay."""
    script = _is_script()
    firsts = hits.where(script).groupBy(F.col("key").alias("_key")).agg(F.min("page_seq").alias("_page"))
    own = hits.join(F.broadcast(firsts), script & (F.col("key") == F.col("_key")), "left")  # a row for each provider of a fixed list
    return fold(own.where(~script | (F.col("page_seq") == F.col("_page"))).drop("_key", "_page"))


def merged_findings(partials: DataFrame) -> DataFrame:
    """The findings of all batches. A script-only captcha stays with the counts of its first page, and only if the provider has no key on that page or before."""
    order = F.col("first_hit")
    script = _is_script()
    merged = partials.groupBy("category", "key").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("occurrences").alias("occurrences"),
        F.min_by("attrs", order).alias("attrs"),
        F.min_by("source_url", order).alias("source_url"),
        F.min(order).alias("first_hit"),
        F.min_by(F.struct("first_seen", "last_seen", "occurrences"), order).alias("_first"),
    )
    provider = F.substring_index("key", ":", 1)
    keyed = merged.where((F.col("category") == "captcha_providers") & ~script).groupBy(provider.alias("_p")).agg(F.min("first_hit.page_seq").alias("_k"))
    settled = merged.join(F.broadcast(keyed), script & (provider == F.col("_p")), "left").where(~script | F.col("_k").isNull() | (F.col("first_hit.page_seq") < F.col("_k")))
    return settled.withColumns({c: F.when(script, F.col("_first")[c]).otherwise(F.col(c)) for c in ("first_seen", "last_seen", "occurrences")}).drop("_first", "_p", "_k")


@dataclass
class FindingsTable:
    """Partial findings, sources and progress under a folder, by micro-batch."""

    spark: SparkSession
    path: str
    categories: list[str] | None = None

    def take(self, pages: DataFrame, batch: int) -> None:
        """Extracts a batch of pages and writes what it adds, in place of what the batch has written before. Progress comes last: a batch with it is whole."""
        pages = materialise(pages)
        hits = materialise(raw_hits(pages, self.categories))
        self._write(partial_findings(hits).where("category <> '_errors'"), "partials", batch)
        self._write(prepared(pages).where("html is not null").groupBy("source_url").agg(F.min("page_seq").alias("at")), "sources", batch)
        counts = pages.agg(F.count("*").alias("pages"), F.count_if(F.col("html").isNull()).alias("failed"))
        found = hits.agg(F.count_if(F.col("category") != "_errors").alias("hits"), F.count_if(F.col("category") == "_errors").alias("errors"))
        self._write(counts.join(F.broadcast(found)), "progress", batch)  # one row each
        discard(hits, pages)

    def follow(self, pages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Takes the batches of a stream of pages as they come."""
        return pages.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def folded(self) -> DataFrame:
        return merged_findings(self._read("partials", PARTIALS))

    def findings(self) -> DataFrame:
        """The findings of all pages that have come, as :func:`tidemark.operators.fold.findings_of` gives them."""
        sources = self._read("sources", "source_url string, at bigint, batch bigint").groupBy("source_url").agg(F.min("at").alias("at"))
        ids = numbered(sources, "source_page_id", F.col("at"), F.col("source_url")).select("source_url", F.col("source_page_id").cast("int").alias("source_page_id"))
        return finished(materialise(self.folded()), ids, self.categories)

    def progress(self) -> DataFrame:
        """(batch, pages, failed, hits, errors, pages_so_far) of each batch; a row for each batch."""
        rows = self._read("progress", "pages bigint, failed bigint, hits bigint, errors bigint, batch bigint")
        from pyspark.sql import Window as W

        return rows.withColumn("pages_so_far", F.sum("pages").over(W.orderBy("batch")))


def captcha_firsts(keep_ms: int | None) -> StatefulProcessor:
    """The first pages of a provider's script and of its keys, kept between micro-batches.

    The class is made here, so that it travels by value to workers that import nothing else.
    """

    class CaptchaFirsts(StatefulProcessor):
        """State of one provider."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.firsts = handle.getValueState("firsts", "script bigint, keyed bigint", keep_ms)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            script, keyed = self.firsts.get() if self.firsts.exists() else (None, None)
            for batch in rows:
                for is_script, page in zip(batch["script"], batch["page_seq"], strict=True):
                    if is_script:
                        script = page if script is None else min(script, page)
                    else:
                        keyed = page if keyed is None else min(keyed, page)
            script, keyed = (None if x is None else int(x) for x in (script, keyed))
            self.firsts.update((script, keyed))
            stays = script is not None and (keyed is None or script < keyed)
            yield pd.DataFrame({"provider": [key[0]], "script_page": pd.array([script], "Int64"), "keyed_page": pd.array([keyed], "Int64"), "script_stays": [stays]})

        def close(self) -> None:
            pass

    return CaptchaFirsts()


def captcha_verdicts(hits: DataFrame, keep_days: int | None = None) -> DataFrame:
    """(provider, script_page, keyed_page, script_stays) as a stream of updates, from a stream of captcha hits.

    Needs the RocksDB state store. A later update of a provider takes the place of an
    earlier one; a late page may take a script-only finding back. With ``keep_days`` a
    provider without news is forgotten after so long; the stream then wakes by the clock.
    """
    mine = hits.where("category = 'captcha_providers'")
    rows = mine.select(F.substring_index("key", ":", 1).alias("provider"), F.col("key").endswith(SCRIPT).alias("script"), "page_seq")
    return rows.groupBy("provider").transformWithStateInPandas(captcha_firsts(keep_days and keep_days * 86_400_000), "provider string, script_page bigint, keyed_page bigint, script_stays boolean", "Update", "ProcessingTime" if keep_days else "None")
