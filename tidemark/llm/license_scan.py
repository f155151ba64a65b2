"""Operator 4: licence scan with a positional rare-token index (DataFrame functions only).

Templates are word sequences with a label and a mandatory key phrase. One pass over the
texts keeps the positions of licence words in files that hold all words of a key
phrase, and which licence words each file holds, for their document frequencies. Each
key phrase is then indexed by its word of highest inverse document frequency: a file's
positions of that word give the places where the template could start, the postings of
all its words are intersected there by relative position, and the key phrase is
verified. Base phrases must match in full; the method's own templates may miss words
outside the key phrase.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.native import let, lower_ascii
from tidemark.session import materialise

#: Words of a lower-cased text: ASCII letters and digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: The method's own templates: label, words, mandatory key phrase inside them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl-2", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("mpl-2", "mozilla public license version 2", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)
#: The share of a template's weight that a partial match needs.
LEAST = 0.7


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    exact: bool


def templates() -> list[Template]:
    base = [Template(label, tuple(p.split()), tuple(p.split()), True) for p, label in BASE]
    return base + [Template(label, tuple(p.split()), tuple(k.split()), False) for label, p, k in TEMPLATES]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are
    the smallest and largest word number at which one starts. ``score`` is 1 with a
    base place, else the best weight share of a template whose key phrase stands
    there and that reaches ``LEAST``, else 0. A null or empty text has no words and
    no label (empty strings); a null doc_id is kept; repeated rows are scanned each;
    other columns are ignored; an empty table gives no rows. A ``spans`` column keeps
    (label, base, start word, share) of everything found.
    """
    all_templates = templates()
    vocabulary = sorted({w for t in all_templates for w in t.words})
    posting = "array<struct<w:string,i:int>>"

    def postings(ws: Column) -> Column:
        own = F.array_intersect(ws, _literal(vocabulary))

        def told(seen: Column) -> Column:
            could = F.lit(False)
            for key in sorted({t.key for t in all_templates}):
                could = could | (F.size(F.array_except(_literal(sorted(set(key))), seen)) == 0)
            placed = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: p["w"].isin(vocabulary))
            return F.struct(F.size(ws).cast("long").alias("n_words"), seen.alias("seen"), F.when(could, placed).otherwise(F.array().cast(posting)).alias("ps"))

        return let(own, told)

    files = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(words_of(F.col("text")), postings).alias("r"))
    # the only pass over the texts; what follows reads words of licences
    files = materialise(files.select(F.monotonically_increasing_id().alias("row"), "doc_id", "r.*"))
    counts = {r.word: r.n for r in files.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    n = files.count()
    idf = {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 0.01 for w in vocabulary}
    found = _matches(files.where("size(ps) > 0").select("row", F.explode("ps").alias("p")).select("row", "p.*"), all_templates, idf)
    spans = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "base", "start", "share"))).alias("spans"))
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")
    row = files.select("row", "doc_id", "n_words").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", none))
    places = F.filter("spans", lambda h: h["base"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda h: h["label"]))), ",")
    starts = F.transform(places, lambda h: h["start"])
    best = F.array_max(F.transform("spans", lambda h: h["share"]))
    return row.select("doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(places).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.least(F.coalesce(best, F.lit(0.0)), F.lit(1.0)).alias("score"), "spans")


def _literal(words) -> Column:
    return F.array(*map(F.lit, words))


def _matches(words: DataFrame, all_templates: list[Template], idf: dict[str, float]) -> DataFrame:
    """(row, label, base, start, share) from the postings ``words(row, w, i)`` of licence words."""
    index = []
    for number, t in enumerate(all_templates):
        at = next(j for j in range(len(t.words)) if t.words[j : j + len(t.key)] == t.key)
        whole = sum(idf[w] for w in t.words)
        rarest = max(range(at, at + len(t.key)), key=lambda j: (idf[t.words[j]], -j))
        index += [(number, t.label, t.exact, w, j, len(t.key), at <= j < at + len(t.key), j == rarest, idf[w] / whole) for j, w in enumerate(t.words)]
    table = words.sparkSession.createDataFrame(index, "template int, label string, base boolean, w string, offset int, key_size int, in_key boolean, rarest boolean, weight double")
    # the index holds the templates' words only
    anchors = words.join(F.broadcast(table.where("rarest").select("template", "w", "offset")), "w").select("row", "template", (F.col("i") - F.col("offset")).alias("start")).where("start >= 0")
    met = words.join(F.broadcast(table), "w").withColumn("start", F.col("i") - F.col("offset"))
    sums = met.join(anchors, ["row", "template", "start"]).groupBy("row", "template", "start").agg(F.first("label").alias("label"), F.first("base").alias("base"), F.first("key_size").alias("key_size"), F.count_if("in_key").alias("keyed"), F.sum("weight").alias("share"))
    kept = sums.where((F.col("keyed") == F.col("key_size")) & (F.col("base") | (F.col("share") >= LEAST)))
    return kept.select("row", "label", "base", F.col("start").cast("long").alias("start"), F.when(F.col("base"), 1.0).otherwise(F.col("share")).alias("share"))
