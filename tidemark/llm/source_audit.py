"""Operator 12: how far the sources of a language lie apart in their words.

Counts by (lang, source, term) are made in tasks before anything is shuffled. The
distances of all pairs of sources of a language are sums over its terms. Each term has its
postings, the sources that hold it: terms with many are laid out as dense tiles, terms by
sources, and all pairs of columns are taken at once; terms with few are corrections to the
pair's value for a term that neither source holds, from single postings and from pairs of
postings of one term. Both are whole numbers, so their sum is exact in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.textkit import LOWER, buffers, slices, word_spans
from tidemark.session import discard, materialise

#: Documents of its language that a term is in at least.
LEAST_DOCS = 10
#: Ranks of the part ``term``.
TOP = 10
SCALE = 1_000_000_000
#: Terms in at least this share of a language's sources are heavy.
HEAVY_SHARE = 0.25
#: Postings that a tile has on average at least.
TILE_ROWS = 8192
#: Sources on each side of a tile.
BLOCK = 512

#: All ASCII but letters: what separates terms.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) in each piece of a partition; the term '' counts documents."""
    for batch in batches:
        for part in slices(batch, "text", 2 << 20, "source_audit"):
            data, offsets = buffers(part.column("text"))
            starts, ends, row = word_spans(data, offsets, SEPARATOR)
            letters = LOWER[data[~SEPARATOR[data]]]
            edge = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(letters)])
            folded = words.dictionary_encode()
            places = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"])
            place = pa.array([f"{len(a)} {a}{b}" for a, b in zip(*(x.to_pylist() for x in places.flatten()), strict=True)]).dictionary_encode()
            group = np.asarray(place.indices).astype(np.int64)
            n_groups, n_terms = len(place.dictionary), len(folded.dictionary)
            width = n_terms + 1
            keys, n = np.unique(row * width + np.asarray(folded.indices).astype(np.int64), return_counts=True)
            in_group = group[keys // width] * width + keys % width
            keys = np.concatenate((in_group, group * width + n_terms))
            n = np.concatenate((n, np.zeros(len(group), np.int64)))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            at, term = np.divmod(keys[first], width)
            shown = np.unique(group, return_index=True)[1][at]
            terms = pa.concat_arrays([folded.dictionary, pa.array([""], pa.large_utf8())])
            assert n_groups == at.max() + 1
            docs = np.diff(np.concatenate((first, [len(keys)])))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang").take(pa.array(shown)), part.column("source").take(pa.array(shown)), terms.take(pa.array(term)).cast(pa.string()), pa.array(np.add.reduceat(n, first)), pa.array(docs.astype(np.int64))],
                names=["lang", "source", "term", "n", "docs"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents it is in; the term '' has 0 and all documents."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """p = 1 + floor(SCALE * (n + 2) / (total + 2 * kept)), beyond 64 bits on the way."""
    wide = "decimal(38,0)"
    return (F.lit(1) + F.call_function("div", (n + 2).cast("decimal(20,0)").cast(wide) * F.lit(SCALE).cast("decimal(10,0)"), (total + 2 * kept).cast("decimal(20,0)"))).cast("long")


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares; the square stays below 2^63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _tile(cell: pa.Table, block: int) -> pa.Table:
    """Of one tile's terms and two blocks of sources: how much more each pair has than for terms that neither source holds.

    Rows without a term tell each source's share ``p`` of a term that it does not hold.
    """
    lang = cell.column("lang")[0].as_py()
    left, right = cell.column("left")[0].as_py(), cell.column("right")[0].as_py()
    source, p = np.asarray(cell.column("number")).astype(np.int64), np.asarray(cell.column("p")).astype(np.int64)
    term = cell.column("term").combine_chunks().dictionary_encode()
    held = np.asarray(pc.is_valid(term))
    numbers = np.sort(source[~held])
    m = len(numbers)
    absent = p[~held][np.argsort(source[~held])]
    heavy = np.asarray(pc.fill_null(cell.column("heavy"), False)).astype(bool)[held]
    code = np.asarray(pc.fill_null(term.indices, 0)).astype(np.int64)[held]
    place, p = np.searchsorted(numbers, source[held]), p[held]
    none = _f(absent[:, None], absent[None, :])
    more = np.zeros((m, m), np.int64)
    # dense tile: a row for each heavy term, a column for each source
    own, at = np.unique(code[heavy], return_inverse=True)
    if len(own):
        tile = np.repeat(absent[None, :], len(own), 0)
        tile[at, place[heavy]] = p[heavy]
        columns = np.ascontiguousarray(tile.T)
        for a in range(m - 1):
            more[a, a + 1 :] += _f(columns[a], columns[a + 1 :]).sum(1) - len(own) * none[a, a + 1 :]
    # light terms: what one posting changes against every other source
    code, place, p = code[~heavy], place[~heavy], p[~heavy]
    for a in np.unique(place).tolist():
        value, times = np.unique(p[place == a], return_counts=True)
        change = (times[:, None] * (_f(value[:, None], absent[None, :]) - none[a][None, :])).sum(0)
        more[a, :] += change
        more[:, a] += change
    # and what two postings of one term change against both alone
    order = np.lexsort((place, code))
    code, place, p = code[order], place[order], p[order]
    apart = 1
    while apart < len(code):
        i = np.flatnonzero(code[apart:] == code[:-apart])
        if not len(i):
            break
        a, b, x, y = place[i], place[i + apart], p[i], p[i + apart]
        np.add.at(more, (a, b), _f(x, y) - _f(x, absent[b]) - _f(absent[a], y) + none[a, b])
        apart += 1
    a, b = np.nonzero(np.triu(more, 1))
    if left != right:  # pairs within one block are the other cells' work
        across = (numbers[a] // block) != (numbers[b] // block)
        a, b = a[across], b[across]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": numbers[a], "b": numbers[b], "more": more[a, b]})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs(doc_id, text, lang, source)``.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language
    keeps those in at least ``least_docs`` of its documents. Part ``pair``: every other source
    of the language with the sum of (p - q)^2 / (p + q) over its kept terms, p and q being
    the sources' smoothed shares. Part ``term``: the ``top`` kept terms whose share in the
    group most exceeds the language's. Ranks go by value, then the item's UTF-8 bytes.

    Null text, lang and source are ''; empty texts count as documents, so a group without
    terms has all its pairs; repeated rows count each; a null doc_id counts; an empty table
    gives no rows; other columns are ignored. A language with one source has no pairs, one
    without kept terms has pairs of value 0.
    """
    block = BLOCK
    counts = materialise(term_counts(docs))
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("in_docs"), F.count("*").alias("sources")).where(F.col("in_docs") >= least_docs).drop("in_docs")
    postings = materialise(counts.where("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "sources"))
    # a row for each source and language: as many as the result has pairs' sides
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    vocabulary = postings.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "rows", "kept", "lang_total"])
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    known = F.col("kept") > 0
    groups = groups.withColumn("number", number).withColumn("absent", F.when(known, _share(F.lit(0), F.col("total"), F.col("kept"))))
    groups = materialise(groups)
    discard(counts)

    # tiles: about as many postings in each as a tile can emit pairs
    lang = groups.groupBy("lang").agg(F.count("*").alias("n_sources"), F.sum("rows").alias("n_rows"))
    size = F.greatest(F.lit(TILE_ROWS), 2 * F.least(F.col("n_sources"), F.lit(2 * block)) * F.least(F.col("n_sources"), F.lit(2 * block)))
    lang = lang.select("lang", "n_sources", F.ceil(F.col("n_rows") / size).cast("int").alias("tiles"))
    blocks = F.ceil(F.col("n_sources") / block).cast("int")
    own = F.floor(F.col("number") / block).cast("int")
    sides = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("left"), F.greatest(own, k).alias("right")))).alias("cell")
    numbered = groups.select("lang", "source", "number", "total", "kept", "absent", "lang_total").join(lang, "lang")
    shares = postings.join(numbered, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))
    held = shares.select("lang", "n_sources", "number", "term", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int").alias("tile"), "p", (F.col("sources") >= HEAVY_SHARE * F.col("n_sources")).alias("heavy"))
    absent = numbered.where("tiles > 0").select("lang", "n_sources", "number", F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("absent").alias("p"), F.lit(False).alias("heavy"))
    cells = held.unionByName(absent).where("n_sources > 1").select("lang", "tile", "number", "term", "p", "heavy", sides).select("lang", "tile", "cell.left", "cell.right", "number", "term", "p", "heavy")
    more = cells.groupBy("lang", "tile", "left", "right").applyInArrow(lambda cell: _tile(cell, block), "lang string, a long, b long, more long").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))

    side = groups.select("lang", "number", "source", "absent", "kept")
    a, b = (side.select("lang", F.col("number").cast("long").alias(k), F.col("source").alias(f"{k}_source"), F.col("absent").alias(f"{k}_absent"), *(["kept"] if k == "a" else [])) for k in "ab")
    pairs = a.join(b, "lang").where("a < b").join(more, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("kept") * _apart(F.col("a_absent"), F.col("b_absent")), F.lit(0)) + F.coalesce("more", F.lit(0))
    both = F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"))))
    pairs = pairs.select("lang", value.alias("value"), both.alias("s")).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = shares.withColumn("q", q).where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
