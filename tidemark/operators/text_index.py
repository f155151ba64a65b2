"""A positional index on disk, and BM25 search that reads only the query's terms.

Postings lie in a table partitioned by a term's first character (dealt over ``LEADS`` folders)
and sorted by term in its files, so that a word or a prefix prunes folders first and row
groups then. Each task writes the files of its blocks, so postings are never shuffled. A row holds
the postings of one term in one block of documents, a block being about
``BLOCK_DOCS`` of them by hash, with the largest frequency and the least length there: bounds
of every score in the block, which are read without the postings.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import let
from tidemark.operators.search import K1, WORD, B, folded, parse_query
from tidemark.session import materialise

#: Documents of a block, on average.
BLOCK_DOCS = 1024
#: Blocks that are scored before the others, to learn which score a hit needs.
FIRST_BLOCKS = 8
#: Characters of text whose words meet in one task, about: few enough to be sorted in memory.
TASK_TEXT = 16 << 20
#: Folders of postings at most, so that a task writes few files.
LEADS = 16


def _lead(term: Column) -> Column:
    return F.ascii(term) % LEADS


def _places(words: Column) -> Column:
    """(term, pos) of each distinct word of a text, with its places in order."""

    def runs(sorted_words: Column) -> Column:
        at = lambda i: F.get(sorted_words, i)
        begins = F.filter(F.sequence(F.lit(0), F.size(sorted_words) - 1), lambda i: (i == 0) | (at(i)["w"] != at(i - 1)["w"]))

        def terms(begins: Column) -> Column:
            end = lambda k: F.coalesce(F.get(begins, k + 1), F.size(sorted_words))
            return F.transform(begins, lambda b, k: F.struct(at(b)["w"].alias("term"), F.transform(F.slice(sorted_words, b + 1, end(k) - b), lambda x: x["i"]).alias("pos")))

        return let(begins, terms)

    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.when(F.size(words) > 0, let(placed, runs))


def write_index(texts: DataFrame, doc: str, text: str, path: str, block_docs: int = BLOCK_DOCS) -> TextIndex:
    """Writes the index of ``texts`` to ``path`` and opens it.

    Null texts count as documents without words. ``doc`` names documents: of repeated rows
    each counts as one, with its own postings. The words of a block of documents meet in
    one task, so that a frequent term is spread over its blocks; the number of tasks follows
    the text, so that none holds more than it can sort in memory.
    """
    spark = texts.sparkSession
    plain = folded(F.coalesce(F.col(text), F.lit("")))
    rows = texts.select(F.col(doc).alias("doc"), F.monotonically_increasing_id().alias("row"), plain.alias("plain"))
    facts = rows.agg(F.count("*").alias("n"), F.avg(F.regexp_count("plain", F.lit(WORD))).alias("avg_len"), F.sum(F.length("plain")).alias("size"))
    facts.select("n", F.coalesce("avg_len", F.lit(1.0)).alias("avg_len"), F.greatest(F.ceil(F.col("n") / block_docs), F.lit(1)).alias("blocks"), F.coalesce("size", F.lit(0)).alias("size")).write.mode("overwrite").parquet(f"{path}/facts")
    told = spark.read.parquet(f"{path}/facts").first()
    block = F.pmod(F.xxhash64("row"), F.lit(told.blocks)).cast("int")
    # one shuffle, of texts and not of their words: the grouping below keeps to the blocks, and so do the files
    tasks = max(1, -(-int(told["size"]) // TASK_TEXT))
    dealt = rows.withColumn("block", block).repartition(tasks, "block").withColumn("words", F.regexp_extract_all("plain", F.lit(WORD), F.lit(0)))
    each = dealt.select("doc", "row", F.size("words").alias("len"), "block", F.explode(_places(F.col("words"))).alias("t"))
    placed = each.select("doc", "row", "len", "block", "t.term", "t.pos")
    made = placed.groupBy("term", "block").agg(F.collect_list(F.struct("doc", "row", "len", "pos")).alias("p"), F.max(F.size("pos")).alias("max_tf"), F.min("len").alias("min_len"), F.count("*").cast("int").alias("n"))
    # an array for each field takes half the room of an array of postings
    made = made.select("term", "block", "p.doc", "p.row", "p.len", "p.pos", "max_tf", "min_len", "n")
    made = made.withColumn("lead", _lead(F.col("term")))
    made.sortWithinPartitions("lead", "term", "block").write.mode("overwrite").partitionBy("lead").option("compression", "zstd").parquet(f"{path}/postings")
    return TextIndex(spark, path, texts.schema[doc].dataType.simpleString())


@dataclass
class TextIndex:
    """An index that :func:`write_index` has written."""

    spark: SparkSession
    path: str
    doc_type: str = "bigint"

    def postings(self, phrases: list[tuple[list[str], bool]]) -> DataFrame:
        """The rows of a query's terms; folders of other first characters and files of other terms are not read."""
        exact = sorted({w for ws, prefix in phrases for w in (ws[:-1] if prefix else ws)})
        begun = sorted({ws[-1] for ws, prefix in phrases if prefix})
        term = F.lit(False)
        if exact:
            term = F.col("term").isin(exact)
        for w in begun:
            term = term | F.col("term").startswith(w)
        leads = sorted({ord(w[0]) % LEADS for w in [*exact, *begun]})
        return self._all().where(F.col("lead").isin(leads) & term)

    def _all(self) -> DataFrame:
        schema = f"term string, block int, doc array<{self.doc_type}>, row array<bigint>, len array<int>, pos array<array<int>>, max_tf int, min_len int, n int, lead int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings")

    def search(self, query: str, limit: int = 50) -> DataFrame:
        """(doc, score): the documents with every phrase of ``query``, best first, as :func:`tidemark.operators.search.bm25` gives them.

        Blocks are first judged by their bounds: one that lacks a phrase's word is left
        out, and once a few blocks have given ``limit`` hits, one that cannot reach the last
        hit's score is not read.
        """
        limit = min(max(limit, 1), 200)
        phrases = parse_query(query)
        facts = self.spark.read.parquet(f"{self.path}/facts").first()
        if not phrases or not facts.n:
            return self._none()
        rows = self.postings(phrases)
        bounds = materialise(self._bounds(rows, phrases))
        found = self._documents_of_phrases(rows, bounds, phrases)
        idf = [max(math.log((facts.n - df + 0.5) / (df + 0.5)), 1e-6) for df in found]
        average = float(facts.avg_len or 1.0)

        def score(tf: Column, size: Column) -> Column:
            total = F.lit(0.0)
            for i, weight in enumerate(idf):
                total = total - weight * tf[i] * (K1 + 1) / (tf[i] + K1 * (1 - B + B * size / F.lit(average)))
            return F.round(total, 9)

        best = bounds.where(F.forall("tf", lambda t: t > 0)).select("block", score(F.col("tf"), F.col("min_len")).alias("bound"))
        first = [r.block for r in best.orderBy("bound", "block").limit(FIRST_BLOCKS).collect()]
        hits = materialise(self._hits(rows.where(F.col("block").isin(first)), phrases, score).orderBy("score", "doc").limit(limit))
        needed = hits.agg(F.count("*").alias("n"), F.max("score").alias("worst")).first()
        rest = best.where(~F.col("block").isin(first))
        if needed.n >= limit:
            rest = rest.where(F.col("bound") <= needed.worst + 1e-9)
        others = self._hits(rows.join(rest.select("block"), "block", "left_semi"), phrases, score)
        return hits.unionByName(others).orderBy("score", "doc").limit(limit)

    def _none(self) -> DataFrame:
        return self._all().select(F.explode("doc").alias("doc")).select("doc", F.lit(0.0).alias("score")).limit(0)

    def _bounds(self, rows: DataFrame, phrases: list[tuple[list[str], bool]]) -> DataFrame:
        """(block, min_len, tf): of each block the least length and the most times that each phrase can occur in a document; no postings are read."""
        most = []
        for words, prefix in phrases:
            each = []
            for k, w in enumerate(words):
                fits = F.col("term").startswith(w) if prefix and k == len(words) - 1 else F.col("term") == w
                each.append(F.sum(F.when(fits, F.col("max_tf")).otherwise(0)))
            most.append(F.least(*each) if len(each) > 1 else each[0])
        return rows.groupBy("block").agg(F.array(*most).alias("tf"), F.min("min_len").alias("min_len"))

    def _documents_of_phrases(self, rows: DataFrame, bounds: DataFrame, phrases: list[tuple[list[str], bool]]) -> list[int]:
        """How many documents hold each phrase: of single words from the rows' counts, of others from their postings."""
        out: dict[int, int] = {}
        single = {i: ws[0] for i, (ws, prefix) in enumerate(phrases) if len(ws) == 1 and not prefix}
        if single:
            counts = rows.agg(*[F.sum(F.when(F.col("term") == w, F.col("n")).otherwise(0)).alias(f"n{i}") for i, w in single.items()]).first()
            out |= {i: counts[f"n{i}"] or 0 for i in single}
        others = [i for i in range(len(phrases)) if i not in single]
        if others:
            own = [phrases[i] for i in others]
            held = self._occurrences(self.postings(own), own)
            counts = held.agg(*[F.count_if(F.col("tf")[k] > 0).alias(f"n{i}") for k, i in enumerate(others)]).first()
            out |= {i: counts[f"n{i}"] or 0 for i in others}
        return [out[i] for i in range(len(phrases))]

    def _occurrences(self, rows: DataFrame, phrases: list[tuple[list[str], bool]]) -> DataFrame:
        """(block, row, doc, len, tf): how often each document of ``rows`` holds each phrase."""
        each = rows.select("block", "term", F.explode(F.arrays_zip("doc", "row", "len", "pos")).alias("p")).select("block", "term", "p.*")
        placed = F.transform("pos", lambda i: F.struct(i.alias("i"), F.col("term").alias("w")))
        docs = each.select("block", "row", "doc", "len", placed.alias("hs")).groupBy("block", "row", "doc", "len").agg(F.array_sort(F.flatten(F.collect_list("hs"))).alias("hs"))
        return docs.select("block", "row", "doc", "len", F.array(*[_count(F.col("hs"), ws, prefix) for ws, prefix in phrases]).alias("tf"))

    def _hits(self, rows: DataFrame, phrases: list[tuple[list[str], bool]], score) -> DataFrame:
        held = self._occurrences(rows, phrases).where(F.forall("tf", lambda t: t > 0))
        return held.select("doc", score(F.col("tf"), F.col("len")).alias("score"))


def _count(places: Column, words: list[str], prefix: bool) -> Column:
    """How often the words stand consecutively among a document's (place, word) pairs in order."""

    def fits(word: Column, k: int) -> Column:
        return word.startswith(words[k]) if prefix and k == len(words) - 1 else word == words[k]

    def begins(h: Column, at: Column) -> Column:
        ok = fits(h["w"], 0)
        for k in range(1, len(words)):
            then = F.get(places, at + k)
            ok = ok & fits(then["w"], k) & (then["i"] == h["i"] + k)
        return F.coalesce(ok, F.lit(False))

    return F.size(F.filter(places, begins))
