"""Operator 5: benchmark decontamination by item-sized SimHash windows (DataFrame functions only).

A window of a document has as many words as a benchmark item. Every start of every
item length is considered; a window is left out only where it holds too few shingles
of that length's items for any of them to reach the similarity, whatever their order,
so none that could match is lost. Each window and each item has a 128-bit SimHash of
its shingles, the occurrences of one numbered; 32 blocks of four bits index the fingerprints, so all pairs
within a Hamming distance of 31 share a block and are found. Candidates are verified
by the exact weighted Jaccard similarity of their shingles, a shingle weighing as
often as it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.native import let, lower_ascii
from tidemark.session import discard, materialise

WIDTH = 5
PERCENT = 80
BLOCKS = 32
RADIUS = BLOCKS - 1
#: Rows of the item index up to which it is broadcast; beyond it the joins shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def shingles_of(words: Column, width: int = WIDTH) -> Column:
    """Hashes of the word shingles in order; a shorter text is one shingle, a wordless one has none."""

    def body(ws: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))
        short = F.array(F.xxhash64(F.array_join(ws, " "), F.size(ws)))
        return F.when(F.size(ws) >= width, each).when(F.size(ws) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(words, body)


def _lanes() -> list[Column]:
    """Per block, two sums of two bits each in two 32-bit lanes, over rows of (h, g, times)."""
    out = []
    for k in range(BLOCKS):
        for half in range(2):
            bits = F.shiftright("h" if k < 16 else "g", 4 * (k % 16) + 2 * half)
            spread = bits.bitwiseAND(F.lit(1).cast("long")).bitwiseOR(F.shiftleft(bits.bitwiseAND(F.lit(2).cast("long")), 31))
            out.append(F.sum(spread).alias(f"lane{k}_{half}"))
    return out


def _nibbles() -> Column:
    """The 32 blocks of a fingerprint: a bit is set if more than half of the weight has it."""
    blocks = []
    for k in range(BLOCKS):
        value = F.lit(0)
        for j in range(4):
            count = F.shiftrightunsigned(f"lane{k}_{j // 2}", 32 * (j % 2)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
            value = value + F.when(2 * count > F.col("weight"), 1 << j).otherwise(0)
        blocks.append(value)
    return F.array(*blocks)


def fingerprints(occurrences: DataFrame, *keys: str) -> DataFrame:
    """(keys, blocks) from rows (keys, h): one for each occurrence of a shingle."""
    rows = occurrences.withColumn("g", F.xxhash64("h"))
    return rows.groupBy(*keys).agg(F.count("*").alias("weight"), *_lanes()).select(*keys, _nibbles().alias("blocks"))


def numbered_shingles(hs: Column) -> Column:
    """Sorted shingles with repeats made distinct: the k-th of equal ones gets a hash of its own.

    As sets, two of these are as similar as the shingles are by weight, so that repeats move
    a fingerprint no further than their share.
    """

    def body(xs: Column) -> Column:
        again = lambda x, i: F.xxhash64(x, i - F.array_position(xs, x).cast("int"))
        return F.transform(xs, lambda x, i: F.when(F.get(xs, i - 1) == x, again(x, i)).otherwise(x))

    return let(hs, body)


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, m, hs): each item's words in number and its shingle hashes; equal texts share the smallest id."""
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words")).where("item_id is not null and size(words) > 0")
    return words.groupBy("words").agg(F.min("item_id").alias("item_id")).select("item_id", F.size("words").alias("m"), shingles_of(F.col("words")).alias("hs"))


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _least(percent: int, own: Column, size: Column) -> Column:
    """The shingles that a window of ``own`` shingles must share with an item of ``size`` to reach ``percent``."""
    return F.ceil(percent * (own + size) / F.lit(100 + percent)).cast("int")


def _starts(places: Column, size: Column, percent: int) -> Column:
    """(start, whole) of every window of ``size`` shingles that can match, from the sorted places of items' shingles.

    At a text's ends a window may be cut to ``percent`` percent; ``whole`` says that it
    holds enough of the places for one that is not cut. Each start is given once, by
    the first place in its window.
    """
    least = F.ceil(percent * size / F.lit(100)).cast("int")
    full = _least(percent, size, size)

    def of(first: Column, i: Column) -> Column:
        low = F.greatest(F.get(places, i + least - 1) - size + 1, F.coalesce(F.get(places, i - 1) + 1, -size))
        each = lambda start: F.struct(start.alias("start"), F.coalesce(F.get(places, i + full - 1) < start + size, F.lit(False)).alias("whole"))
        return F.when(low <= first, F.transform(F.sequence(low, first), each)).otherwise(F.array().cast("array<struct<start:int,whole:boolean>>"))

    return F.flatten(F.transform(F.slice(places, F.lit(1), F.greatest(F.size(places) - least + 1, F.lit(0))), of))


def contaminations(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, same, item_id, n_windows, first_word, similarity): documents that hold an item.

    One row for each document and item with a window of at least ``percent`` percent
    similarity: how many windows, the most similar one's first word (the earliest of
    equals), and its similarity. ``same`` is the text's hash: with doc_id it names
    the row.

    * null, empty or wordless texts and items match nothing; an item of fewer words
      than a shingle matches windows with exactly its words only where a text is
      that short itself;
    * windows are cut at a text's ends; a null doc_id is kept; rows equal in doc_id
      and text are one document; other columns are ignored; empty tables give no rows.
    """
    items = materialise(items_of(benchmark))
    index = items.select("m", F.explode("hs").alias("h")).distinct()
    small = index.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    text = F.col("text").cast("string")
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), shingles_of(words_of(text), width).alias("hs"))

    # windows: every start with enough shingles of a length's items, in any order
    placed = hashed.select("doc_id", "same", F.posexplode_outer("hs").alias("p", "h")).where("h is not null")  # outer: no filter that computes hs again
    size = F.greatest(F.col("m") - width + 1, F.lit(1))
    held = placed.join(hint(index), "h").groupBy("doc_id", "same", "m").agg(F.collect_set("p").alias("ps")).where(100 * F.size("ps") >= percent * size)
    windows = held.select("doc_id", "same", "m", let(F.array_sort("ps"), lambda ps: _starts(ps, size, percent)).alias("starts"))
    windows = materialise(windows.where("size(starts) > 0"))
    owners = windows.select(F.col("doc_id").alias("d"), F.col("same").alias("s")).distinct()
    owners = F.broadcast(owners) if windows.count() <= BROADCAST_ROWS else owners
    its = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("same") == F.col("s"))
    # the texts are chosen before their shingles are made again
    theirs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("same")).join(owners, its, "left_semi")
    own = windows.groupBy(F.col("doc_id").alias("d"), F.col("same").alias("s")).agg(F.collect_list(F.struct("m", "starts")).alias("wanted"))

    def slices_of(hs: Column) -> Column:
        def each(w: Column) -> Column:
            size = F.greatest(w["m"] - width + 1, F.lit(1))
            fit = F.filter(w["starts"], lambda x: x["whole"] | (x["start"] < 0) | (x["start"] + size > F.size(hs)))

            def one(x: Column) -> Column:
                first, last = F.greatest(x["start"], F.lit(0)), F.least(x["start"] + size, F.size(hs))
                return F.struct(w["m"].alias("m"), x["start"].alias("start"), F.array_sort(F.slice(hs, first + 1, last - first)).alias("ws"))

            return F.transform(fit, one)

        return F.flatten(F.transform("wanted", each))

    cut = theirs.join(own, its).select("doc_id", "same", F.explode(let(shingles_of(words_of(F.col("text")), width), slices_of)).alias("w"))
    cut = materialise(cut.select("doc_id", "same", "w.start", "w.m", "w.ws"))

    # equal windows share one fingerprint, one search and one verification
    shapes = materialise(cut.select("m", "ws").distinct().withColumn("shape", F.xxhash64("m", "ws")))
    # written, so that the long expressions of the fingerprints stand in one small plan each
    prints = materialise(fingerprints(shapes.select("m", "shape", F.explode(numbered_shingles(F.col("ws"))).alias("h")), "m", "shape"))
    item_prints = materialise(fingerprints(items.select("m", "item_id", F.explode(numbered_shingles(F.array_sort("hs"))).alias("h")), "m", "item_id"))
    left = prints.select("m", "shape", "blocks", F.posexplode("blocks").alias("k", "value"))
    right = item_prints.select("m", "item_id", F.col("blocks").alias("item_blocks"), F.posexplode("blocks").alias("k", "value"))
    near = left.join(hint(right), ["m", "k", "value"]).where(_distance(F.col("blocks"), F.col("item_blocks")) <= RADIUS).select("m", "shape", "item_id").distinct()
    both = near.join(shapes, ["m", "shape"]).join(hint(items.select("item_id", F.array_sort("hs").alias("is"))), "item_id")
    common = _weighted_overlap(F.col("ws"), F.col("is")).cast("long")
    union = F.size("ws") + F.size("is") - common
    hits = both.where(100 * common >= percent * union).select("m", "ws", "item_id", (common / union).alias("similarity"))
    found = cut.join(hits, ["m", "ws"])
    out = found.groupBy("doc_id", "same", "item_id").agg(F.count_distinct("start").alias("n_windows"), F.max(F.struct("similarity", (-F.greatest("start", F.lit(0))).alias("back"))).alias("best"))
    out = materialise(out.select("doc_id", "same", "item_id", "n_windows", (-F.col("best.back")).cast("long").alias("first_word"), F.col("best.similarity").alias("similarity")))
    discard(items, windows, cut, shapes, prints, item_prints)
    return out


def _weighted_overlap(a: Column, b: Column) -> Column:
    """The sum of the smaller multiplicities of the shingles that ``a`` and ``b`` share."""
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, v: s + F.least(times(a, v), times(b, v)))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    bad = contaminations(docs, benchmark).select(F.col("doc_id").alias("_bad_id"), F.col("same").alias("_bad_text")).distinct()
    fits = F.xxhash64(docs["text"].cast("string")) == F.col("_bad_text")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("_bad_id")) & fits, "left_anti")
